"""Registered queries: each pairs a Spark builder ``(spark, sf_dir) -> DataFrame``
with, where the operator is SQL-expressible, the equivalent DuckDB SQL over
the same parquet tables (the correctness oracle).

Every query reads the given tables (or frames Spark derives from them) in
full. Output columns carry the same names and types on both sides; money
uses ``money`` / ``money_sql`` and ratios ``rnd`` / ``rnd_sql`` so both
engines show the same digits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import EMA_SPANS, LAGS, MODEL_FEATURES, PipelineConfig
from tidemark.functions.money import money_times_sql
from tidemark.functions.numeric import exact_total, money, rnd, total
from tidemark.functions.numeric import money_sql as M
from tidemark.functions.numeric import rnd_sql as R
from tidemark.functions.numeric import total_sql as T
from tidemark.operators import (anomaly, eda, evaluation, explain, iforest, ledger, profile, series,
                                stl, throttle, treeshap)
from tidemark.operators import forecast as _fc
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans import pipeline
from tidemark.operators.profile import NUMERIC_TEXT
from tidemark.plans import series_sql as S
from tidemark.session import ensure_checkpoint_dir, written
from tidemark.sources import store
from tidemark.sources.binding import canonical_frame, normalise_name, rejected_rows
from tidemark.sources.csv_folder import FolderRead, read_transactions_folder
from tidemark.sources.csv_source import prepare
from tidemark.sources.monthly_store import MonthlyStore
from tidemark.sources.tables import (RAW_HEADERS, raw_transactions, raw_transactions_sql,
                                     read_table, sales_fact, sales_fact_sql)

CFG = PipelineConfig()


@dataclass(frozen=True)
class QuerySpec:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str  # SURVEY operator ids covered


CATALOG: dict[str, QuerySpec] = {}


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn):
        CATALOG[name] = QuerySpec(fn, sql, ops)
        return fn
    return deco


def fact(roles) -> str:
    return sales_fact_sql(roles)


# --------------------------------------------------------------------- EDA

@register("monthly_sales", "A6 C3 C4 K1", f"""
SELECT strftime(order_date, '%Y-%m') AS period, {M(T('sales'))} AS sales
FROM {fact(['order_date', 'sales'])} f
GROUP BY 1""")
def q_monthly_sales(spark, sf_dir):
    return eda.monthly_sales(sales_fact(spark, sf_dir, ["order_date", "sales"]))


@register("kpi_summary", "A1 A2 A3 A4 A5", f"""
WITH a AS (
  SELECT {T('sales')} AS s, COUNT(DISTINCT order_id) AS n,
         MIN(order_date) AS dmin, MAX(order_date) AS dmax
  FROM {fact(['order_date', 'sales', 'order_id'])} f)
SELECT {M('s')} AS total_sales, CAST(n AS BIGINT) AS total_orders,
       {R('COALESCE(s / NULLIF(n, 0), 0.0)', 2)} AS avg_order_value,
       {money_times_sql('s', CFG.profit_rate_estimate)} AS total_profit,
       CASE WHEN s > 0 THEN {R(f's * CAST({CFG.profit_rate_estimate!r} AS DOUBLE) / s * 100.0', 2)}
            ELSE 0.0 END AS profit_margin_pct,
       strftime(dmin, '%Y-%m-%d') AS date_min, strftime(dmax, '%Y-%m-%d') AS date_max,
       TRUE AS profit_is_estimated
FROM a""")
def q_kpi_summary(spark, sf_dir):
    return eda.kpi_summary(sales_fact(spark, sf_dir, ["order_date", "sales", "order_id"]))


@register("category_breakdown", "A8", f"""
WITH f AS {fact(['order_date', 'sales', 'category'])},
     t AS (SELECT {T('sales')} AS total FROM f),
     g AS (SELECT CAST(category AS VARCHAR) AS category, {T('sales')} AS s
           FROM f WHERE category IS NOT NULL GROUP BY 1)
SELECT category, {M('s')} AS sales, {money_times_sql('s', CFG.profit_rate_estimate)} AS profit,
       {R('s / NULLIF((SELECT total FROM t), 0) * 100.0', 2)} AS pct,
       TRUE AS profit_is_estimated
FROM g""")
def q_category_breakdown(spark, sf_dir):
    return eda.category_breakdown(sales_fact(spark, sf_dir, ["order_date", "sales", "category"]))


def _share_sql(key: str) -> str:
    return f"""
WITH f AS {fact(['order_date', 'sales', key])},
     t AS (SELECT {T('sales')} AS total FROM f),
     g AS (SELECT CAST({key} AS VARCHAR) AS {key}, {T('sales')} AS s
           FROM f WHERE {key} IS NOT NULL GROUP BY 1)
SELECT {key}, {R('s / NULLIF((SELECT total FROM t), 0) * 100.0', 2)} AS pct FROM g"""


@register("segment_breakdown", "A9", _share_sql("segment"))
def q_segment_breakdown(spark, sf_dir):
    return eda.share_breakdown(sales_fact(spark, sf_dir, ["order_date", "sales", "segment"]), "segment")


@register("region_breakdown", "A10", _share_sql("region"))
def q_region_breakdown(spark, sf_dir):
    return eda.share_breakdown(sales_fact(spark, sf_dir, ["order_date", "sales", "region"]), "region")


@register("ship_lead_times", "A11 C5 C8", f"""
WITH g AS (
  SELECT CAST(ship_mode AS VARCHAR) AS ship_mode,
         AVG(CAST(floor(date_diff('microsecond', order_date, ship_date) / 86400000000.0) AS BIGINT)) AS a
  FROM {fact(['order_date', 'sales', 'ship_date', 'ship_mode'])} f
  WHERE ship_mode IS NOT NULL GROUP BY 1)
SELECT ship_mode, {R('a', 1)} AS avg_lead_days FROM g WHERE a IS NOT NULL""")
def q_ship_lead_times(spark, sf_dir):
    return eda.ship_lead_times(sales_fact(spark, sf_dir, ["order_date", "sales", "ship_date", "ship_mode"]))


def _top_sql(kind: str, col: str, k: int) -> str:
    return f"""
SELECT '{kind}' AS kind, CAST(row_number() OVER (ORDER BY s DESC, name ASC) AS BIGINT) AS rank,
       name, {M('s')} AS sales
FROM (SELECT CAST({col} AS VARCHAR) AS name, {T('sales')} AS s
      FROM {fact(['order_date', 'sales', col])} f WHERE {col} IS NOT NULL GROUP BY 1
      ORDER BY s DESC, name ASC LIMIT {k}) t"""


@register("top_entities", "K2", " UNION ALL ".join([
    f"({_top_sql('products', 'product_name', 10)})",
    f"({_top_sql('customers', 'customer_name', 5)})",
    f"({_top_sql('states', 'state', 5)})",
]))
def q_top_entities(spark, sf_dir):
    roles = ["order_date", "sales", "product_name", "product_id", "customer_name", "customer_id", "state"]
    return eda.top_entities_report(sales_fact(spark, sf_dir, roles))


def _hist_sql(bins: int = CFG.hist_bins) -> str:
    b = float(bins)
    def edge(i):
        return f"(CASE WHEN {i} >= {bins} THEN s.hi ELSE s.lo + CAST({i} AS DOUBLE) * ((s.hi - s.lo) / {b!r}) END)"
    return f"""
WITH x AS (SELECT ln(1 + sales) AS x FROM {fact(['order_date', 'sales'])} f WHERE sales > -1),
     s0 AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM x),
     s AS (SELECT CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
                  CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM s0),
     i0 AS (SELECT x.x, s.lo, s.hi,
                   LEAST(CAST(floor((x.x - s.lo) * ({b!r} / (s.hi - s.lo))) AS INTEGER), {bins - 1}) AS i0
            FROM x, s),
     i1 AS (SELECT *, i0 - CASE WHEN x < {edge('i0').replace('s.', '')} THEN 1 ELSE 0 END AS i1 FROM i0),
     i2 AS (SELECT i1 + CASE WHEN x >= {edge('(i1 + 1)').replace('s.', '')} AND i1 <> {bins - 1}
                             THEN 1 ELSE 0 END AS bin FROM i1),
     c AS (SELECT bin, COUNT(*) AS n FROM i2 GROUP BY 1),
     spine AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT spine.bin AS bin, CAST(COALESCE(c.n, 0) AS BIGINT) AS count,
       {R('exp(' + edge('spine.bin') + ') - 1', 2)} AS lower,
       {R('exp(' + edge('(spine.bin + 1)') + ') - 1', 2)} AS upper
FROM spine CROSS JOIN s LEFT JOIN c ON spine.bin = c.bin
WHERE s.lo IS NOT NULL"""


@register("sales_histogram", "A12", _hist_sql())
def q_sales_histogram(spark, sf_dir):
    return eda.sales_histogram(sales_fact(spark, sf_dir, ["order_date", "sales"]))


# ----------------------------------------------------------------- profile

def _profile_sql() -> str:
    parts = []
    for i, h in enumerate(RAW_HEADERS):
        n = normalise_name(h)
        is_string = h not in ("Sales", "Quantity", "Discount")
        null_test = f'"{h}" IS NULL' + (f' OR isnan("{h}")' if not is_string else "")
        text = (f'COUNT(*) FILTER (WHERE "{h}" IS NOT NULL AND NOT regexp_matches("{h}", \'{NUMERIC_TEXT}\')) > 0'
                if is_string else "FALSE")
        parts.append(f"""SELECT {i} AS position, '{h}' AS name, '{n}' AS "column",
       CAST(COUNT(*) FILTER (WHERE {null_test}) AS BIGINT) AS null_count,
       CAST(COUNT(DISTINCT "{h}") AS BIGINT) AS unique_count, {text} AS is_string,
       COUNT(*) AS n_rows FROM r""")
    body = "\nUNION ALL ".join(parts)
    return f"""
WITH r AS {raw_transactions_sql()}, p AS ({body})
SELECT position, name, "column", null_count,
       {R('CAST(null_count AS DOUBLE) / NULLIF(n_rows, 0)', 4)} AS null_rate, unique_count,
       CASE WHEN contains("column", 'date') OR contains("column", 'time') THEN 'time'
            WHEN "column" IN ('sales', 'profit', 'discount', 'quantity') THEN 'numeric_feature'
            WHEN unique_count < {CFG.categorical_max_distinct} THEN 'categorical_feature'
            WHEN unique_count > {CFG.high_cardinality_min_distinct} AND is_string THEN 'high_cardinality_string'
            ELSE 'identifier' END AS role
FROM p"""


@register("profile_columns", "P1 P2 P3 S2", _profile_sql())
def q_profile_columns(spark, sf_dir):
    return profile.profile_columns(raw_transactions(spark, sf_dir))


@register("profile_table", "P4", f"""
SELECT COUNT(*) AS n_rows, CAST(15 AS BIGINT) AS n_columns FROM {raw_transactions_sql()} r""")
def q_profile_table(spark, sf_dir):
    return profile.profile_table(raw_transactions(spark, sf_dir))


# ------------------------------------------------------------------ series

@register("monthly_txn", "A7 J1", f"""
SELECT strftime(order_date, '%Y-%m') AS period, {M(T('sales'))} AS sales,
       COUNT(DISTINCT order_id) AS n_orders, COUNT(DISTINCT product_id) AS n_products,
       COUNT(DISTINCT customer_id) AS n_customers, {R('AVG(sales)', 2)} AS avg_txn_sale
FROM {fact(['order_date', 'sales', 'order_id', 'product_id', 'customer_id'])} f
GROUP BY 1""")
def q_monthly_txn(spark, sf_dir):
    txn = sales_fact(spark, sf_dir, ["order_date", "sales", "order_id", "product_id", "customer_id"])
    m = series.monthly_series(txn)
    return m.select(F.col("period_label").alias("period"), money("sales").alias("sales"),
                    "n_orders", "n_products", "n_customers",
                    rnd("avg_txn_sale", 2).alias("avg_txn_sale"))


# ------------------------------------------------- series features & stats




def feature_frame(spark, sf_dir, key: str | None):
    roles = ["order_date", "sales"] + ([key] if key else [])
    m = series.monthly_series(sales_fact(spark, sf_dir, roles), key, with_counts=False)
    return series.add_features(m)


def present_features(fe):
    return fe.select(
        "series_key", F.col("period_label").alias("period"), money("sales").alias("sales"),
        *[money(f"lag{k}").alias(f"lag{k}") for k in LAGS],
        money("roll3_mean", 2, 4).alias("roll3_mean"), money("roll6_mean", 2, 5).alias("roll6_mean"),
        money("roll12_mean", 2, 6).alias("roll12_mean"), rnd("roll3_std", 2).alias("roll3_std"),
        rnd("roll6_std", 2).alias("roll6_std"), rnd("ema3", 2).alias("ema3"),
        rnd("ema6", 2).alias("ema6"), rnd("ema12", 2).alias("ema12"),
        "month", "quarter", "year", "is_q4", rnd("mom_pct", 2).alias("mom_pct"),
        rnd("yoy_pct", 2).alias("yoy_pct"), money("dev_roll3", 2, 4).alias("dev_roll3"))


@register("series_features_all", "W1 W2 W3 W4 W5 W6 W7 C6 (key ALL)",
          S.chain(None) + "\n" + S.features_select())
def q_series_features_all(spark, sf_dir):
    return present_features(feature_frame(spark, sf_dir, None))


@register("series_features_region", "W1 W2 W3 W4 W5 W6 W7 C6 (key region)",
          S.chain("region") + "\n" + S.features_select())
def q_series_features_region(spark, sf_dir):
    return present_features(feature_frame(spark, sf_dir, "region"))


@register("series_features_segment", "W1-W7 C6 (key segment)",
          S.chain("segment") + "\n" + S.features_select())
def q_series_features_segment(spark, sf_dir):
    return present_features(feature_frame(spark, sf_dir, "segment"))


@register("anomaly_stats", "A13 A14 W8 AN1 AN6", S.chain("region", "stats") + f"""
SELECT series_key, strftime(period, '%Y-%m') AS period, {M('sales')} AS sales,
       {M('q1', 2, 6)} AS q1, {M('q3', 2, 6)} AS q3, {M('iqr_lo', 2, 7)} AS iqr_lo,
       {M('iqr_hi', 2, 7)} AS iqr_hi, {R('z_score', 3)} AS z_score, stat_flag, direction
FROM st""")
def q_anomaly_stats(spark, sf_dir):
    st = anomaly.stat_flags(feature_frame(spark, sf_dir, "region"))
    return st.select("series_key", F.col("period_label").alias("period"), money("sales").alias("sales"),
                     money("q1", 2, 6).alias("q1"), money("q3", 2, 6).alias("q3"),
                     money("iqr_lo", 2, 7).alias("iqr_lo"), money("iqr_hi", 2, 7).alias("iqr_hi"),
                     rnd("z_score", 3).alias("z_score"), "stat_flag", "direction")


def _naive(spark, sf_dir, key="region"):
    fe = feature_frame(spark, sf_dir, key)
    pred = evaluation.seasonal_naive(evaluation.holdout_split(fe))
    return fe, pred, evaluation.forecast_metrics(pred)


@register("forecast_metrics_naive", "F3 F7", S.chain("region", "naive") + """
SELECT series_key, n_test, mape, rmse, r2, mase FROM mt""")
def q_forecast_metrics_naive(spark, sf_dir):
    return _naive(spark, sf_dir)[2].drop("rmse_raw")


@register("backtest_naive", "F3 F8", S.chain("region", "naive") + f"""
SELECT series_key, strftime(period, '%Y-%m') AS period, {M('actual')} AS actual,
       {M('predicted')} AS predicted FROM pr WHERE is_test""")
def q_backtest_naive(spark, sf_dir):
    _, pred, _ = _naive(spark, sf_dir)
    return evaluation.backtest_rows(pred).select(
        "series_key", F.col("period_label").alias("period"), "actual", "predicted")


def _bands(spark, sf_dir):
    fe, pred, met = _naive(spark, sf_dir)
    return evaluation.forecast_bands(evaluation.seasonal_naive_projection(fe), met), met


@register("forecast_bands_naive", "F10 K5", S.chain("region", "naive", "bands") + """
SELECT series_key, period, step, forecast, lower_90, upper_90 FROM bd""")
def q_forecast_bands_naive(spark, sf_dir):
    return _bands(spark, sf_dir)[0]


@register("future_risks_naive", "AN8 K5", S.chain("region", "naive", "bands") + f"""
SELECT bd.series_key, bd.period, bd.forecast, '{anomaly.RISK_TYPE}' AS risk_type,
       '{anomaly.RISK_DESCRIPTION}' AS description
FROM bd JOIN mt ON bd.series_key = mt.series_key
WHERE bd.step <= {CFG.risk_steps} AND (bd.upper_90 - bd.lower_90) > mt.rmse * {S._dbl(CFG.risk_k)}""")
def q_future_risks_naive(spark, sf_dir):
    bands, met = _bands(spark, sf_dir)
    return anomaly.future_risks(bands, met)


def _voted(spark, sf_dir):
    fe, pred, met = _naive(spark, sf_dir)
    st = anomaly.stat_flags(fe)
    rf = anomaly.residual_flags(pred.where(F.col("is_test")), met)
    return anomaly.vote(anomaly.attach_flags(st, rf, "resid_flag"), ["stat_flag", "resid_flag"])


_VOTES = S.chain("region", "stats", "naive", "votes")


@register("anomaly_scores_naive", "AN4 AN5 AN7 J2", _VOTES + f"""
SELECT series_key, strftime(period, '%Y-%m') AS period, {M('sales')} AS sales,
       {R('z_score', 3)} AS z_score, votes, severity, is_anomaly FROM vs""")
def q_anomaly_scores_naive(spark, sf_dir):
    return anomaly.monthly_scores(_voted(spark, sf_dir))


@register("anomaly_confirmed_naive", "C7 AN5 AN6", _VOTES + f"""
SELECT series_key, strftime(period, '%Y-%m') AS period, {M('sales')} AS sales, severity,
       direction, votes, {R('z_score', 3)} AS z_score FROM vs WHERE votes >= 2""")
def q_anomaly_confirmed_naive(spark, sf_dir):
    return anomaly.confirmed(_voted(spark, sf_dir))


@register("anomaly_summary_naive", "A16", _VOTES + f"""
SELECT series_key, COUNT(*) AS total_months, COUNT(*) FILTER (WHERE is_anomaly) AS total_anomalies,
       COUNT(*) FILTER (WHERE votes >= 3) AS critical, COUNT(*) FILTER (WHERE votes = 2) AS high,
       COUNT(*) FILTER (WHERE is_anomaly AND direction = 'spike') AS spikes,
       COUNT(*) FILTER (WHERE is_anomaly AND direction = 'drop') AS drops,
       {R('COALESCE(COUNT(*) FILTER (WHERE is_anomaly) * 100.0 / NULLIF(COUNT(*), 0), 0.0)', 2)} AS anomaly_rate_pct
FROM vs GROUP BY series_key""")
def q_anomaly_summary_naive(spark, sf_dir):
    return anomaly.anomaly_summary(_voted(spark, sf_dir))


#: A third detector by rule: months that change by more than this percentage.
MOM_LIMIT = 12.0
_THREE = _VOTES + f""",
v3 AS (SELECT * EXCLUDE (votes, is_anomaly, severity),
              votes + CAST(COALESCE(abs(mom_pct) > {S._dbl(MOM_LIMIT)}, FALSE) AS BIGINT) AS votes FROM vs)"""


def _voted_three(spark, sf_dir):
    two = _voted(spark, sf_dir).withColumn(
        "mom_flag", F.coalesce(F.abs("mom_pct") > F.lit(MOM_LIMIT), F.lit(False)))
    return anomaly.vote(two.drop("votes", "is_anomaly", "severity"), ["stat_flag", "resid_flag", "mom_flag"])


@register("anomaly_scores_three", "AN5 AN7 (three detectors)", _THREE + f"""
SELECT series_key, strftime(period, '%Y-%m') AS period, {M('sales')} AS sales, {R('z_score', 3)} AS z_score, votes,
       CASE WHEN votes >= 3 THEN 'critical' WHEN votes = 2 THEN 'high' ELSE 'normal' END AS severity,
       votes >= 2 AS is_anomaly FROM v3""")
def q_anomaly_scores_three(spark, sf_dir):
    return anomaly.monthly_scores(_voted_three(spark, sf_dir))


# ------------------------------------------------------------- explanation


# The 16 model features with a SQL form (the two STL features have none).
SQL_FEATURES = ("lag1", "lag2", "lag3", "lag6", "lag12", "roll3_mean", "roll3_std", "roll6_mean",
                "roll6_std", "roll12_mean", "ema3", "ema6", "ema12", "month", "quarter", "is_q4")
# Fixture importances by rule: weight (n - i) for the i-th feature, normalised to sum 1.
FIXTURE_IMPORTANCES = tuple(
    (f, (len(SQL_FEATURES) - i) / (len(SQL_FEATURES) * (len(SQL_FEATURES) + 1) / 2))
    for i, f in enumerate(SQL_FEATURES))


def _importances(spark):
    return spark.createDataFrame(list(FIXTURE_IMPORTANCES), "feature string, importance double")


def _deviation(spark, sf_dir):
    fe = feature_frame(spark, sf_dir, "region")
    return explain.deviation_scores(fe, _importances(spark), SQL_FEATURES)


def _deviation_sql() -> str:
    casts = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in SQL_FEATURES)
    imp = ", ".join(f"('{f}', {S._dbl(v)}, {i + 1})" for i, (f, v) in enumerate(FIXTURE_IMPORTANCES))
    contrib = (f"(value - med) / (CASE WHEN sd = 0 THEN 1.0 ELSE sd END) * "
               f"COALESCE(importance, {S._dbl(CFG.default_importance)}) * {S._dbl(CFG.explain_scale)}")
    return S.chain("region") + f""",
lf AS (UNPIVOT (SELECT series_key, period, {casts} FROM fe) ON {', '.join(SQL_FEATURES)}
       INTO NAME feature VALUE value),
sc AS (SELECT *, median(value) OVER (PARTITION BY series_key, feature) AS med,
              stddev_samp(value) OVER (PARTITION BY series_key, feature) AS sd FROM lf),
imp AS (SELECT * FROM (VALUES {imp}) t(feature, importance, pos)),
cb AS (SELECT sc.series_key, sc.period, sc.feature, imp.pos, {R('value', 2)} AS value,
              {R(contrib, 4)} AS contribution
       FROM sc LEFT JOIN imp ON sc.feature = imp.feature)"""


@register("explain_deviation_top", "X3 X4 A15 J3 W9 K4", _deviation_sql() + """
SELECT series_key, strftime(period, '%Y-%m') AS period, rank, feature, value, contribution
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY series_key, period
                                       ORDER BY abs(contribution) DESC, pos ASC) AS BIGINT) AS rank
      FROM cb) t WHERE rank <= 6""")
def q_explain_deviation_top(spark, sf_dir):
    top = explain.top_contributions(_deviation(spark, sf_dir), CFG.top_contrib)
    return top.select("series_key", F.col("period_label").alias("period"), "rank", "feature",
                      "value", "contribution")


@register("explain_deviation_all", "X3 (every feature of a month, sorted)", _deviation_sql() + """
SELECT series_key, strftime(period, '%Y-%m') AS period,
       CAST(row_number() OVER (PARTITION BY series_key, period ORDER BY abs(contribution) DESC, pos ASC) AS BIGINT) AS rank,
       feature, value, contribution FROM cb""")
def q_explain_deviation_all(spark, sf_dir):
    every = explain.top_contributions(_deviation(spark, sf_dir), len(SQL_FEATURES))
    return every.select("series_key", F.col("period_label").alias("period"), "rank", "feature",
                        "value", "contribution")


@register("explain_global_scaled", "X2 (importance: a feature's share of the correlations with sales)",
          S.chain("region") + f""",
lf AS (UNPIVOT (SELECT CAST(sales AS DOUBLE) AS target, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in SQL_FEATURES)}
                FROM fe) ON {', '.join(SQL_FEATURES)} INTO NAME feature VALUE value),
c AS (SELECT feature, abs(corr(value, target)) AS r FROM lf GROUP BY feature)
SELECT feature, {R(f'r / (SELECT SUM(r) FROM c) * {S._dbl(CFG.explain_scale)}', 4)} AS shap FROM c""")
def q_explain_global_scaled(spark, sf_dir):
    fe = feature_frame(spark, sf_dir, "region")
    r = explain.long_features(fe, SQL_FEATURES, ("series_key", "period", "sales")).groupBy("feature").agg(
        F.abs(F.corr("value", "sales")).alias("r"))
    every = Window.partitionBy()  # over one row per feature
    return explain.global_importance(r.select("feature", (F.col("r") / F.sum("r").over(every)).alias("importance")))


@register("explain_global_mean_abs", "A17", _deviation_sql() + f"""
SELECT feature, {R('AVG(abs(contribution))', 4)} AS mean_abs_contribution FROM cb GROUP BY feature""")
def q_explain_global_mean_abs(spark, sf_dir):
    sc = _deviation(spark, sf_dir).withColumn("contribution", rnd("contribution", 4))
    return sc.groupBy("feature").agg(rnd(F.avg(F.abs("contribution")), 4).alias("mean_abs_contribution"))


# ------------------------------------------------------------------ ingest

@register("bind_clean_monthly", "S2 S3 S4 C1 C2 A6", f"""
SELECT strftime(strptime("Order Date", '%d/%m/%Y'), '%Y-%m') AS period, {M(T('"Sales"'))} AS sales
FROM {raw_transactions_sql()} r GROUP BY 1""")
def q_bind_clean_monthly(spark, sf_dir):
    return eda.monthly_sales(prepare(raw_transactions(spark, sf_dir))[1])


def _spoiled(raw: DataFrame) -> DataFrame:
    """Raw rows with unreadable dates and amounts, by a rule on the order id."""
    number = F.col("Order ID").cast("long")
    return (raw.withColumn("Order Date", F.when(number % 97 == 0, "no date").otherwise(F.col("Order Date")))
               .withColumn("Sales", F.when(number % 89 == 0, "N/A").otherwise(F.col("Sales").cast("string"))))


@register("rejected_counts", "C2 (rows left out, by reason)", f"""
WITH r AS (SELECT CAST("Order ID" AS BIGINT) AS id, "Sales" AS s, "Order Date" AS d FROM {raw_transactions_sql()} x),
     b AS (SELECT id % 97 = 0 OR d IS NULL AS bad_d, id % 89 = 0 OR s IS NULL AS bad_s FROM r)
SELECT COUNT(*) FILTER (WHERE bad_d) AS bad_date, COUNT(*) FILTER (WHERE bad_s) AS bad_sales,
       COUNT(*) FILTER (WHERE bad_d OR bad_s) AS rejected, COUNT(*) AS n_rows FROM b""")
def q_rejected_counts(spark, sf_dir):
    normalised, _, binding = prepare(_spoiled(raw_transactions(spark, sf_dir)))
    return rejected_rows(canonical_frame(normalised, binding))


def _three_styles(spark, sf_dir) -> FolderRead:
    """The transactions, some of them spoiled, as CSV files of three header
    styles and date orders, by order id, read back as one folder."""
    raw = written(_spoiled(raw_transactions(spark, sf_dir)).select("Order Date", "Sales", "Order ID"), "raw")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    number, date = F.col("Order ID").cast("long"), F.to_date(F.try_to_timestamp(F.substring("Order Date", 1, 10), F.lit("dd/MM/yyyy")))
    when = lambda f: F.coalesce(F.date_format(date, f), F.col("Order Date"))
    styles = (("iso", ("Order Date", "Sales", "Order ID"), "yyyy-MM-dd"), ("days", (" orderdate", "Revenue", "ID"), "d/M/yyyy"),
              ("months", ("DATE", "amount", "Order-Id"), "M/d/yyyy"))
    for i, (name, heads, pattern) in enumerate(styles):
        columns = (when(pattern), F.col("Sales"), F.col("Order ID"))
        (raw.where(F.pmod(number, F.lit(3)) == i).select(*[c.alias(h) for c, h in zip(columns, heads)])
         .write.option("header", True).csv(f"{base}/{name}"))
    return read_transactions_folder(spark, base)


@register("csv_folder_monthly", "S1 S2 S3 S4 C1 C2 (CSV files of three header styles in one job)", f"""
SELECT strftime(order_date, '%Y-%m') AS period, {M(T('sales'))} AS sales, COUNT(DISTINCT order_id) AS n_orders
FROM {fact(['order_date', 'sales', 'order_id'])} f WHERE order_id % 97 <> 0 AND order_id % 89 <> 0 GROUP BY 1""")
def q_csv_folder_monthly(spark, sf_dir):
    txn = _three_styles(spark, sf_dir).transactions
    m = series.monthly_series(txn.select("order_date", "sales", F.col("order_id").cast("long").alias("order_id")))
    return m.select(F.col("period_label").alias("period"), money("sales").alias("sales"), "n_orders")


@register("csv_quarantine", "C2 S1 (rejected rows with file and reason)", f"""
SELECT CASE order_id % 3 WHEN 0 THEN 'iso' WHEN 1 THEN 'days' ELSE 'months' END AS style, order_id % 97 = 0 AS bad_date,
       order_id % 89 = 0 AS bad_sales, COUNT(*) AS n, COUNT(DISTINCT order_id) AS n_orders
FROM {fact(['order_date', 'sales', 'order_id'])} f WHERE order_id % 97 = 0 OR order_id % 89 = 0 GROUP BY 1, 2, 3""")
def q_csv_quarantine(spark, sf_dir):
    kept = _three_styles(spark, sf_dir).quarantine
    order = F.coalesce(*[F.get_json_object("row", f"$['{h}']") for h in ("Order ID", "ID", "Order-Id")])
    return kept.groupBy(F.regexp_extract("source_file", "/(iso|days|months)/[^/]*$", 1).alias("style"), "bad_date", "bad_sales").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(order).alias("n_orders"))


@register("store_roundtrip", "S6 S7 S13", f"""
WITH m AS (SELECT strftime(order_date, '%Y-%m') AS period, {M(T('sales'))} AS sales
           FROM {fact(['order_date', 'sales'])} f GROUP BY 1)
SELECT 'first' AS run_id, period, sales FROM m WHERE right(period, 2) <= '06'
UNION ALL SELECT 'second', period, sales FROM m""")
def q_store_roundtrip(spark, sf_dir):
    months = written(eda.monthly_sales(sales_fact(spark, sf_dir, ["order_date", "sales"])), "months")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    half = months.where(F.substring("period", 6, 2) <= "06")
    for run, rows in (("first", months), ("second", months), ("first", half)):  # the last one replaces its run
        store.save_run_results(run, {"trend": store.to_json_rows(rows)}, base)
    back = [store.from_json_rows(store.get_run_results(spark, base, run, ["trend"], marker="trend")["trend"], months.schema)
            .select(F.lit(run).alias("run_id"), "period", "sales") for run in ("first", "second")]
    return back[0].unionByName(back[1])


@register("store_commit", "S6 S7 E1 (a rerun that fails half-way leaves the committed run)", f"""
WITH m AS (SELECT region, strftime(order_date, '%Y-%m') AS period, {T('sales')} AS s
           FROM {fact(['order_date', 'sales', 'region'])} f GROUP BY 1, 2),
r(run_id, first, last) AS (VALUES ('kept', '01', '12'), ('replaced', '01', '06')),
d AS (SELECT run_id, 'trend' AS document, period AS item, {M('SUM(s)')} AS sales FROM m, r
      WHERE right(period, 2) BETWEEN first AND last GROUP BY run_id, period
      UNION ALL SELECT run_id, 'regions', region, {M('SUM(s)')} FROM m, r
      WHERE right(period, 2) BETWEEN first AND last GROUP BY run_id, region)
SELECT run_id, document, item, sales FROM d""")
def q_store_commit(spark, sf_dir):
    """Two runs are committed whole; then one is replaced on half of the
    months, and the other fails after its first document on the same half."""
    txn = sales_fact(spark, sf_dir, ["order_date", "sales", "region"])
    cells = written(txn.groupBy("region", F.date_format("order_date", "yyyy-MM").alias("period")).agg(exact_total("sales").alias("s")), "cells")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"

    def documents(rows: DataFrame) -> dict:
        return {d: rows.groupBy(F.col(c).alias("item")).agg(money(F.sum("s").cast("double")).alias("sales"))
                for d, c in (("trend", "period"), ("regions", "region"))}

    half = cells.where(F.substring("period", 6, 2) <= "06")
    for run, rows in (("kept", cells), ("replaced", cells), ("replaced", half)):
        store.save_run_results(run, documents(rows), base)
    broken = documents(half)
    broken["regions"] = broken["regions"].withColumn("sales", F.when(F.col("sales").isNotNull(), F.raise_error(F.lit("no"))).cast("double"))
    try:
        store.save_run_results("kept", broken, base)
    except Exception as e:
        store.save_failure(spark, "kept", type(e).__name__, base)
    else:
        raise AssertionError("the save was to fail")
    back = [store.committed(spark, base, d).select("run_id", F.lit(d).alias("document"), "item", "sales") for d in broken]
    return back[0].unionByName(back[1])


# ------------------------------------------------------- ledger & messages

@register("chat_history_first5", "S12", """
SELECT conv_id, turn, sender, message FROM (
  SELECT conv_id, turn, role AS sender, text AS message,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn
  FROM conversations) t WHERE rn <= 5""")
def q_chat_history_first5(spark, sf_dir):
    msgs = read_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("sender"), F.col("text").alias("message"))
    w_order = F.struct("turn", "sender", "message")
    return ledger.first_messages(msgs.withColumn("_o", w_order), 5, key="conv_id", order="_o").drop("_o")


@register("events_latest_status", "S9 S10", """
SELECT user_id, event_type AS status, ts, first_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
         min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events) t WHERE rn = 1""")
def q_events_latest_status(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    cur = ledger.latest_status(ev, key="user_id", status="event_type", ts="ts", tie="event_id", keep=())
    return ledger.list_runs(cur.withColumnRenamed("event_type", "status"))


@register("messages_store_first3", "S11 S12", """
SELECT run_id, seq, sender, message FROM (
  SELECT CAST(conv_id AS VARCHAR) AS run_id, turn AS seq, role AS sender, text AS message,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) t WHERE rn <= 3""")
def q_messages_store_first3(spark, sf_dir):
    msgs = read_table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("sender"),
        F.col("text").alias("message"), F.lit(None).cast("timestamp").alias("ts"))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/chat-{uuid.uuid4().hex}"
    odd = F.col("seq") % 2 == 1
    for part in (msgs.where(odd), msgs.where(~odd)):  # two appends
        store.append_messages(part, base)
    return store.chat_history(spark, base, limit=3).drop("ts")


@register("ledger_store_current", "S8 S9 S10", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, ts, min(ts) OVER (PARTITION BY user_id) AS first_ts FROM events)
SELECT run_id, CASE WHEN max(ts) = first_ts THEN 'RUNNING' WHEN second(max(ts)) < 6 THEN 'FAILED' ELSE 'COMPLETED' END
       AS status, max(ts) AS ts, first_ts FROM e GROUP BY run_id, first_ts""")
def q_ledger_store_current(spark, sf_dir):
    """A user's first event registers a run, every later one is an outcome."""
    ev = read_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), "ts")
    first = ev.groupBy("run_id").agg(F.min("ts").alias("ts"))
    later = (ev.join(first.withColumnRenamed("ts", "_first"), "run_id").where(F.col("ts") > F.col("_first"))
             .withColumn("status", F.when(F.second("ts") < 6, ledger.FAILED).otherwise(ledger.COMPLETED)))
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    for log in (first.withColumn("status", F.lit(ledger.RUNNING)), later):
        store.append_log(log.select("run_id", F.lit(None).cast("string").alias("file_name"), "status", "ts"), base)
    return store.current_runs(spark, base).drop("file_name")


@register("ledger_compacted", "S8 S9 S10 (log folded while it grows)", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS run_id, CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'COMPLETED'
           ELSE 'FAILED' END AS status, date_trunc('minute', ts) AS ts FROM events)
SELECT run_id, arg_max(status, (ts, status <> 'RUNNING', status)) AS status, max(ts) AS ts, min(ts) AS first_ts FROM e GROUP BY run_id""")
def q_ledger_compacted(spark, sf_dir):
    """Every event is a status event of its user's run, times cut to minutes
    so that some tie; appended in ten parts under a tail of four files."""
    ev = read_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.lit(None).cast("string").alias("file_name"),
        F.when(F.col("event_type") == "click", ledger.RUNNING).when(F.col("event_type") == "view", ledger.COMPLETED)
        .otherwise(ledger.FAILED).alias("status"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "event_id")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    for part in range(10):
        store.append_log(ev.where(F.pmod("event_id", F.lit(10)) == part), base, tail_files=4)
    log = store.status_log(base, 4)
    if log.files(spark) > 4 + log.tail_files:  # bounded by the tail and the state, whatever was appended
        raise AssertionError("the log was not folded")
    return log.state(spark).drop("file_name")


# ---------------------------------------------------------------- throttle

def _throttle_query(capacity: float, rate: float):
    def build(spark, sf_dir):
        ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
        out = throttle.token_bucket(ev, "user_id", "ts", "event_id", capacity, rate)
        return out.select("event_id", "user_id", "allowed", rnd("tokens", 6).alias("tokens"))
    sql = throttle.token_bucket_sql(capacity, rate) + f"""
SELECT tie AS event_id, k AS user_id, allowed, {R('tok', 6)} AS tokens FROM tb"""
    return build, sql


_b, _s = _throttle_query(2.0, 1.0 / 3600.0)
register("events_throttle_tight", "T2 (2 tokens, 1 per hour)", _s)(_b)
_b, _s = _throttle_query(CFG.bucket_capacity, CFG.bucket_rate_per_sec)
register("events_throttle_default", "T2 (10 tokens, 1 per 5 s)", _s)(_b)


# ------------------------------------------- model-based (no SQL oracle)



@register("stl_decompose", "M1")
def q_stl_decompose(spark, sf_dir):
    m = series.monthly_series(sales_fact(spark, sf_dir, ["order_date", "sales", "region"]), "region",
                              with_counts=False)
    d = stl.decompose(m)
    return d.select("series_key", F.date_format("period", "yyyy-MM").alias("period"),
                    rnd("stl_trend", 2).alias("stl_trend"), rnd("stl_seasonal", 2).alias("stl_seasonal"),
                    rnd("stl_resid", 2).alias("stl_resid"))


def _model_features(spark, sf_dir, key="region"):
    roles = ["order_date", "sales"] + ([key] if key else [])
    return pipeline.build_features(sales_fact(spark, sf_dir, roles), key, CFG)


def _model_frames(spark, sf_dir, key="region"):
    """(monthly, feature rows of model-length series, backtest rows)."""
    roles = ["order_date", "sales"] + ([key] if key else [])
    m = pipeline.build_monthly(sales_fact(spark, sf_dir, roles), key, CFG).cache()
    fe = pipeline.features_from_monthly(m).cache()
    return m, pipeline.model_rows(fe, CFG), pipeline.backtest_rows(m, fe, CFG)


@register("isolation_flags", "AN2 AN3")
def q_isolation_flags(spark, sf_dir):
    iso = iforest.isolation_flags(_model_features(spark, sf_dir))
    return iso.select("series_key", F.date_format("period", "yyyy-MM").alias("period"),
                      rnd("iso_score", 4).alias("iso_score"), "iso_flag")


@register("forecast_model_metrics", "F1 F2 F3 F4 F5 F6 F7 F8")
def q_forecast_model_metrics(spark, sf_dir):
    _, _, bt = _model_frames(spark, sf_dir)
    return _fc.backtest(bt, CFG)[1].drop("rmse_raw")


@register("forecast_future", "F9 F10 (model)")
def q_forecast_future(spark, sf_dir):
    roles = ["order_date", "sales", "region"]
    m = pipeline.build_monthly(sales_fact(spark, sf_dir, roles), "region", CFG).cache()
    fe = pipeline.features_from_monthly(m).cache()
    mf, _, metrics, models = pipeline.fit_backtest_and_final(m, fe, CFG)
    return _fc.recursive_forecast(mf, models, metrics, CFG, m)


@register("feature_importance", "F11 K3")
def q_feature_importance(spark, sf_dir):
    _, mf, _ = _model_frames(spark, sf_dir)
    return _fc.feature_importances(_fc.fit_forest(mf, CFG), spark=spark)


@register("anomaly_confirmed_full", "AN1-AN7 E1 (three detectors)")
def q_anomaly_confirmed_full(spark, sf_dir):
    txn = sales_fact(spark, sf_dir, ["order_date", "sales", "region"])
    return pipeline.run_pipeline(txn, CFG, key="region")["anomaly_confirmed"]


@register("tree_shap_top", "X1 K4 (Tree SHAP of the fitted forest)")
def q_tree_shap_top(spark, sf_dir):
    _, mf, _ = _model_frames(spark, sf_dir)
    rf = _fc.fit_forest(mf, CFG)
    top = explain.top_contributions(treeshap.shap_scores(mf, rf, MODEL_FEATURES), CFG.top_contrib)
    return top.select("series_key", F.col("period_label").alias("period"), "rank", "feature",
                      "value", "contribution")


# ------------------------------------------------- many series at once

@register("series_features_customer", "W1-W7 C6 (one series per customer)",
          S.chain("customer_id") + "\n" + S.features_select())
def q_series_features_customer(spark, sf_dir):
    return present_features(feature_frame(spark, sf_dir, "customer_id"))


@register("sales_quartiles", "A13 A15 (exact quantiles of transactions, no buffer of a group)", f"""
SELECT category, segment, COUNT(sales) AS n, {R('quantile_cont(sales, 0.25)', 2)} AS q1, {R('quantile_cont(sales, 0.5)', 2)} AS median,
       {R('quantile_cont(sales, 0.75)', 2)} AS q3, {R('quantile_cont(sales, 0.99)', 2)} AS p99
FROM {fact(['order_date', 'sales', 'category', 'segment'])} f WHERE sales IS NOT NULL GROUP BY 1, 2""")
def q_sales_quartiles(spark, sf_dir):
    txn = written(sales_fact(spark, sf_dir, ["order_date", "sales", "category", "segment"]), "txn")
    q = exact_quantiles(txn, ["category", "segment"], "sales", [0.25, 0.5, 0.75, 0.99], bins=256, leaf=200)
    return q.select("category", "segment", "n", *[rnd(f"q{i}", 2).alias(c) for i, c in enumerate(("q1", "median", "q3", "p99"))])


@register("ema_daily_region", "W4 (long series: one value a day)", f"""
WITH d AS (SELECT region AS series_key, CAST(order_date AS DATE) AS period, {T('sales')} AS sales
           FROM {fact(['order_date', 'sales', 'region'])} f WHERE region IS NOT NULL GROUP BY 1, 2),
h AS (SELECT *, list(sales) OVER (PARTITION BY series_key ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist FROM d)
SELECT series_key, period, """ + ", ".join(
    R(f"CASE WHEN len(hist) > 0 THEN list_reduce(hist, lambda acc, x: CAST('{1 - 2 / (s + 1)!r}' AS DOUBLE) * acc + "
      f"CAST('{2 / (s + 1)!r}' AS DOUBLE) * x) END", 2) + f" AS ema{s}" for s in EMA_SPANS) + " FROM h")
def q_ema_daily_region(spark, sf_dir):
    txn = sales_fact(spark, sf_dir, ["order_date", "sales", "region"]).where(F.col("region").isNotNull())
    daily = txn.groupBy(F.col("region").alias("series_key"), F.to_date("order_date").alias("period")).agg(total("sales").alias("sales"))
    return series.add_emas(daily).select("series_key", "period", *[rnd(f"ema{s}", 2).alias(f"ema{s}") for s in EMA_SPANS])


@register("monthly_txn_region", "A7 J1 (per region)", S.monthly_counts_cte("region"))
def q_monthly_txn_region(spark, sf_dir):
    roles = ["order_date", "sales", "order_id", "product_id", "customer_id", "region"]
    m = series.monthly_series(sales_fact(spark, sf_dir, roles), "region")
    return m.select("series_key", F.col("period_label").alias("period"), money("sales").alias("sales"),
                    "n_orders", "n_products", "n_customers", rnd("avg_txn_sale", 2).alias("avg_txn_sale"))


@register("monthly_gapfill_customer", "SN10 calendar spine per series (C3 A6)",
          S.gapfill_sql("customer_id"))
def q_monthly_gapfill_customer(spark, sf_dir):
    m = series.monthly_series(sales_fact(spark, sf_dir, ["order_date", "sales", "customer_id"]),
                              "customer_id", with_counts=False)
    filled = series.fill_month_gaps(m.drop("period_label"))
    return filled.select("series_key", F.date_format("period", "yyyy-MM").alias("period"),
                         money("sales").alias("sales"))


@register("monthly_incremental", "A6 A7 J1 T1 (months merged file by file)", S.monthly_counts_cte("region"))
def q_monthly_incremental(spark, sf_dir):
    """The transactions come as five files: by year's half and part of the
    orders, one of them twice; every file rewrites its own months only."""
    roles = ["order_date", "sales", "order_id", "product_id", "customer_id", "region"]
    txn = written(sales_fact(spark, sf_dir, roles), "txn")
    store_ = MonthlyStore(f"{ensure_checkpoint_dir(spark).rstrip('/')}/monthly-{uuid.uuid4().hex}", "region")
    late = F.month("order_date") > 6
    part = F.pmod("order_id", F.lit(3))
    files = {"early-0": txn.where(~late & (part == 0)), "early-1": txn.where(~late & (part > 0)),
             "late-0": txn.where(late & (part < 2)), "late-1": txn.where(late & (part == 2))}
    for name in ("early-0", "late-0", "early-1", "late-0", "late-1"):
        store_.add(files[name], name)
    m = store_.series(spark)
    return m.select("series_key", F.col("period_label").alias("period"), money("sales").alias("sales"),
                    "n_orders", "n_products", "n_customers", rnd("avg_txn_sale", 2).alias("avg_txn_sale"))


def _throttle_keyed(capacity: float, rate: float, key: str | None):
    """Token bucket per ``key`` of ``events``; ``None`` = ONE global bucket
    (the source's upload limiter), every event on the same key."""
    def build(spark, sf_dir):
        ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
        ev = ev.withColumn("bucket_key", F.lit("ALL") if key is None else F.col(key).cast("string"))
        out = throttle.token_bucket(ev.drop("event_type"), "bucket_key", "ts", "event_id", capacity, rate)
        return out.select("event_id", "bucket_key", "allowed", rnd("tokens", 6).alias("tokens"))
    k = "'ALL'" if key is None else f"CAST({key} AS VARCHAR)"
    table = f"(SELECT event_id, ts, {k} AS bucket_key FROM events) e0"
    sql = throttle.token_bucket_sql(capacity, rate, table=table, key="bucket_key") + f"""
SELECT tie AS event_id, k AS bucket_key, allowed, {R('tok', 6)} AS tokens FROM tb"""
    return build, sql


_b, _s = _throttle_keyed(CFG.bucket_capacity, CFG.bucket_rate_per_sec, None)
register("events_throttle_global", "T2 one global bucket (10 tokens, 1 per 5 s)", _s)(_b)
_b, _s = _throttle_keyed(2.0, 1.0 / 3600.0, "event_type")
register("events_throttle_by_type", "T2 per event type: few hot keys (2 tokens, 1 per hour)", _s)(_b)


@register("forecast_rolling_cv", "F12 rolling-origin evaluation (3 cut-offs)")
def q_forecast_rolling_cv(spark, sf_dir):
    _, mf, _ = _model_frames(spark, sf_dir)
    cv = _fc.rolling_origin_cv(mf, CFG, folds=3)
    return cv.select("series_key", "fold", "n_test", "mape", "rmse", "r2", "mase")


# ------------------------- what SQL can check of the model operators:
# components add up, keys, actuals, band arithmetic, of the production fit.


@register("stl_components_sum", "M1 (trend + seasonal + residual = sales)", "WITH " + S.monthly_cte("region") + f"""
SELECT series_key, strftime(period, '%Y-%m') AS period, {M('sales')} AS sales FROM m""")
def q_stl_components_sum(spark, sf_dir):
    m = series.monthly_series(sales_fact(spark, sf_dir, ["order_date", "sales", "region"]), "region", with_counts=False)
    whole = F.col("stl_trend") + F.col("stl_seasonal") + F.col("stl_resid")
    return stl.decompose(m).select("series_key", F.date_format("period", "yyyy-MM").alias("period"), money(whole).alias("sales"))


@register("forecast_backtest_actuals", "F3 F8 (months and actuals of the fitted backtest)", S.chain("region", "naive") + f"""
SELECT series_key, strftime(period, '%Y-%m') AS period, {M('actual')} AS actual, TRUE AS has_prediction FROM pr WHERE is_test""")
def q_forecast_backtest_actuals(spark, sf_dir):
    pred = _fc.backtest(_model_frames(spark, sf_dir)[2], CFG)[0]
    return evaluation.backtest_rows(pred).select(
        "series_key", F.col("period_label").alias("period"), "actual", F.col("predicted").isNotNull().alias("has_prediction"))


@register("forecast_steps", "F9 F10 (months ahead; bands from the forecast and its RMSE)", S.chain("region") + f"""
SELECT series_key, strftime(max(period) + to_months(CAST(s AS INTEGER)), '%Y-%m') AS period, CAST(s AS INTEGER) AS step,
       TRUE AS band_holds FROM fe, range(1, {CFG.horizon + 1}) r(s) GROUP BY series_key, s""")
def q_forecast_steps(spark, sf_dir):
    m = pipeline.build_monthly(sales_fact(spark, sf_dir, ["order_date", "sales", "region"]), "region", CFG).cache()
    mf, _, metrics, models = pipeline.fit_backtest_and_final(m, pipeline.features_from_monthly(m).cache(), CFG)
    fc = _fc.recursive_forecast(mf, models, metrics, CFG, m)
    # shown values: cents on both, so the width is known to a few cents
    width = F.col("rmse") * F.lit(CFG.z_band) * F.sqrt(F.col("step").cast("double"))
    lower = F.greatest(F.col("forecast") - width, F.lit(0.0))
    holds = (F.abs(F.col("upper_90") - F.col("forecast") - width) < 0.05) & (F.abs(F.col("lower_90") - lower) < 0.05)
    return fc.join(metrics.select("series_key", "rmse"), "series_key").select(
        "series_key", "period", "step", holds.alias("band_holds"))


@register("forecast_cv_folds", "F12 (rows of each fold)", S.chain("region", "naive") + f"""
SELECT series_key, CAST(k AS INTEGER) AS fold, COUNT(*) AS n_test FROM sp, range(1, 4) r(k)
WHERE rd > (k - 1) * {CFG.holdout} AND rd <= k * {CFG.holdout} GROUP BY series_key, k""")
def q_forecast_cv_folds(spark, sf_dir):
    return _fc.rolling_origin_cv(_model_frames(spark, sf_dir)[1], CFG, folds=3).select("series_key", "fold", "n_test")
