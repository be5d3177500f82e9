"""Hand-computed cases: binding, parsing, windows, EDA edges."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import eda, profile, series
from tidemark.sources.binding import SchemaError, bind_roles, normalise_headers
from tidemark.sources.csv_source import prepare, read_transactions_csv


def _csv(tmp_path, text, name="t.csv"):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_alias_headers_and_day_first(spark, tmp_path):
    path = _csv(tmp_path, "OrderDate,Revenue,Prod-Cat\n08/11/2017,10.5,A\n2017-02-03,4,B\nbad,3,A\n01/02/2017,,B\n")
    raw = read_transactions_csv(spark, path)
    norm, txn, binding = prepare(raw)
    assert binding.roles["order_date"] == "orderdate"
    assert binding.roles["sales"] == "revenue"
    assert binding.roles["category"] == "prod_cat"
    rows = sorted(txn.select(F.to_date("order_date").alias("d"), "sales").collect())
    # day-first for d/m/y, ISO stays ISO; bad date and null sales dropped
    assert [r.d for r in rows] == [dt.date(2017, 2, 3), dt.date(2017, 11, 8)]


def test_required_missing_and_collision(spark):
    with pytest.raises(SchemaError):
        bind_roles(["order_date", "profit"])
    df = spark.createDataFrame([(1, 2)], "`Order Date` int, `order-date` int")
    with pytest.raises(SchemaError):
        normalise_headers(df)


def test_ema_and_rolling(spark):
    rows = [("k", dt.date(2020, m, 1), float(v)) for m, v in zip(range(1, 5), [10, 20, 40, 80])]
    m = spark.createDataFrame(rows, "series_key string, period date, sales double")
    f = series.add_features(m, drop_incomplete=False).orderBy("period").collect()
    assert f[0].ema3 is None
    assert f[1].ema3 == 10.0
    assert f[3].ema3 == pytest.approx(27.5)
    assert f[2].roll3_mean is None and f[3].roll3_mean == pytest.approx(70 / 3)
    assert f[1].mom_pct == pytest.approx(100.0)


def test_growth_zero_is_null(spark):
    rows = [("k", dt.date(2020, 1, 1), 0.0), ("k", dt.date(2020, 2, 1), 5.0)]
    m = spark.createDataFrame(rows, "series_key string, period date, sales double")
    f = series.add_features(m, drop_incomplete=False).orderBy("period").collect()
    assert f[1].mom_pct is None


def test_lead_days_floor(spark):
    from tidemark.functions.dates import lead_days
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 2, 23, 0), dt.datetime(2020, 1, 2, 0, 0)),
         (dt.datetime(2020, 1, 1, 23, 0), dt.datetime(2020, 1, 2, 1, 0))], "o timestamp, s timestamp")
    assert [r.d for r in df.select(lead_days("o", "s").alias("d")).collect()] == [-1, 0]


def test_null_group_in_total_not_in_groups(spark):
    txn = spark.createDataFrame([(dt.datetime(2020, 1, 1), 50.0, "A"), (dt.datetime(2020, 1, 1), 50.0, None)],
                                "order_date timestamp, sales double, region string")
    r = eda.share_breakdown(txn, "region").collect()
    assert [(x.region, x.pct) for x in r] == [("A", 50.0)]


def test_histogram_constant_range(spark):
    txn = spark.createDataFrame([(dt.datetime(2020, 1, 1), 9.0)] * 3, "order_date timestamp, sales double")
    h = eda.sales_histogram(txn).orderBy("bin").collect()
    assert len(h) == 15 and sum(r["count"] for r in h) == 3 and h[7]["count"] == 3


def test_top_k_tie_break_and_missing_column(spark):
    txn = spark.createDataFrame([(dt.datetime(2020, 1, 1), 5.0, "b"), (dt.datetime(2020, 1, 1), 5.0, "a")],
                                "order_date timestamp, sales double, state string")
    t = eda.top_entities(txn, "state", 1).collect()
    assert t[0].name == "a"
    assert eda.top_entities(txn, "city", 5).count() == 0


def test_profile_roles(spark):
    df = spark.createDataFrame([(f"2020-01-{i % 28 + 1:02d}", float(i), f"id{i}", "x") for i in range(120)],
                               "`Order Date` string, Sales double, `Customer ID` string, Seg string")
    p = {r.column: r.role for r in profile.profile_columns(df).collect()}
    assert p == {"order_date": "time", "sales": "numeric_feature",
                 "customer_id": "high_cardinality_string", "seg": "categorical_feature"}


def test_kpis_with_profit_and_estimate(spark):
    txn = spark.createDataFrame([(dt.datetime(2020, 1, 1), 100.0, 10.0, "o1"),
                                 (dt.datetime(2020, 2, 3), 300.0, 30.0, "o2")],
                                "order_date timestamp, sales double, profit double, order_id string")
    k = eda.kpi_summary(txn).first()
    assert (k.total_sales, k.total_orders, k.avg_order_value, k.total_profit, k.profit_margin_pct) == \
        (400.0, 2, 200.0, 40.0, 10.0)
    assert k.profit_is_estimated is False and k.date_min == "2020-01-01"
    k2 = eda.kpi_summary(txn.drop("profit")).first()
    assert k2.total_profit == 60.0 and k2.profit_is_estimated is True


def test_money_rounding_is_order_independent(spark):
    from tidemark.functions.numeric import money
    # 0.145 has no exact binary form; both engines must show 0.15
    assert spark.range(1).select(money(F.lit(0.145)).alias("m")).first().m == 0.15


def test_constant_series_not_flagged(spark):
    from tidemark.operators import anomaly
    rows = [("k", dt.date(2020 + i // 12, i % 12 + 1, 1), 5.0) for i in range(20)]
    m = spark.createDataFrame(rows, "series_key string, period date, sales double")
    st = anomaly.stat_flags(m).collect()
    assert all(r.z_score is None and r.stat_flag is False and r.direction == "pattern" for r in st)


def test_missing_optional_columns(spark):
    txn = spark.createDataFrame([(dt.datetime(2020, 1, 1), 5.0)], "order_date timestamp, sales double")
    assert eda.category_breakdown(txn).count() == 0
    assert eda.share_breakdown(txn, "segment").count() == 0
    assert eda.ship_lead_times(txn).count() == 0
    assert eda.top_entities_report(txn).count() == 0
    k = eda.kpi_summary(txn).first()
    assert k.total_orders == 1 and k.profit_is_estimated
    k_old = eda.kpi_summary(txn, id_fallback="sales").first()
    assert k_old.total_orders == 1


def test_messages_store_first_n(spark, tmp_path):
    from tidemark.sources import store
    base = str(tmp_path / "s")
    msgs = spark.createDataFrame([("r1", i, "user" if i % 2 else "bot", f"m{i}") for i in range(10)]
                                 + [("r2", 0, "user", "hello")],
                                 "run_id string, seq long, sender string, message string") \
                .withColumn("ts", F.current_timestamp())
    store.append_messages(msgs, base)
    got = store.chat_history(spark, base, "r1", limit=3).orderBy("seq").collect()
    assert [r.message for r in got] == ["m0", "m1", "m2"]
    assert store.chat_history(spark, base, limit=3).count() == 4


def test_csv_round_trip_matches_parquet_path(spark, tmp_path):
    """S1-S4 + C1/C2 on the real tables: the fact written as a CSV with
    display headers and day-first dates gives the same KPIs after binding."""
    from tests.conftest import SF_SMALL
    from tidemark.sources.tables import raw_transactions, sales_fact
    out = str(tmp_path / "csv")
    raw_transactions(spark, SF_SMALL).coalesce(2).write.option("header", True).csv(out)
    _, txn_csv, binding = prepare(read_transactions_csv(spark, out))
    assert binding.roles["order_date"] == "order_date" and binding.roles["product_id"] == "product_id"
    a = eda.kpi_summary(txn_csv).drop("profit_is_estimated").first()
    b = eda.kpi_summary(sales_fact(spark, SF_SMALL, ["order_date", "sales", "order_id"])) \
           .drop("profit_is_estimated").first()
    assert a == b


def test_materialized_fact_prunes_partitions(spark, tmp_path):
    from tests.conftest import SF_SMALL
    from tidemark.sources.tables import materialize_fact
    fact = materialize_fact(spark, SF_SMALL, str(tmp_path / "fact"), ["order_date", "sales", "region"])
    q = fact.where(F.col("order_month") == "1996-03")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "1996-03" in plan
    assert q.count() > 0


def test_fill_gaps_spine_shifts_lags(spark):
    from tidemark.config import PipelineConfig
    txn = spark.createDataFrame([(dt.datetime(2020, 1, 5), 10.0), (dt.datetime(2020, 3, 5), 30.0)],
                                "order_date timestamp, sales double")
    plain = series.monthly_series(txn, with_counts=False).orderBy("period").collect()
    filled = series.monthly_series(txn, cfg=PipelineConfig(fill_gaps=True)).orderBy("period").collect()
    assert [r.sales for r in plain] == [10.0, 30.0]
    assert [(r.period_label, r.sales, r.n_orders) for r in filled] == \
        [("2020-01", 10.0, 1), ("2020-02", 0.0, 0), ("2020-03", 30.0, 1)]


def test_forecast_step_features_legacy_and_default(spark):
    from tidemark.operators.forecast import step_features
    st = spark.createDataFrame([("k", dt.date(2020, 12, 1), [1.0, 2.0, 3.0, 4.0, 5.0, 6.0],
                                 [10.0, 12.0], [0.5] * 12)],
                               "series_key string, last_period date, hist array<double>, "
                               "trend_hist array<double>, season_hist array<double>")
    new = step_features(st).first()
    old = step_features(st, legacy_features=True).first()
    assert (new.lag1, new.lag3, new.lag12) == (6.0, 4.0, 6.0)   # lag beyond history -> lag1
    assert new.roll3_mean == pytest.approx(5.0)
    assert new.roll3_std == pytest.approx(1.0) and old.roll3_std == pytest.approx((2 / 3) ** 0.5)
    assert old.ema3 == pytest.approx(5.0) and new.ema3 == pytest.approx(5.03125)
    assert (new.month, new.quarter, new.is_q4, new.stl_trend, new.stl_seasonal) == (1, 1, 0, 14.0, 0.5)


def test_histogram_matches_numpy(spark):
    import numpy as np
    from tests.conftest import SF_MID
    from tidemark.sources.tables import sales_fact
    txn = sales_fact(spark, SF_MID, ["order_date", "sales"])
    sales = np.array([r.sales for r in txn.select("sales").collect()])
    counts, edges = np.histogram(np.log1p(sales), bins=15)
    got = eda.sales_histogram(txn).orderBy("bin").collect()
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.lower for r in got] == [round(float(np.expm1(e)), 2) for e in edges[:-1]]


def test_money_sums_are_exact_at_any_size_and_layout(spark):
    from tidemark.functions.numeric import exact_total
    rows = spark.range(20_000).select(
        (F.lit(3_000_000_000_000.0) + F.col("id") * 0.01 + 0.0001).alias("sales"))
    expected = {exact for parts in (1, 7, 64)
                for exact, in rows.repartition(parts).agg(exact_total("sales")).collect()}
    assert len(expected) == 1
    assert abs(float(expected.pop()) - (20_000 * 3e12 + 0.01 * 19_999 * 10_000)) < 64


def test_money_sum_leaves_out_nan(spark):
    from tidemark.functions.numeric import total
    df = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "sales double")
    assert df.agg(total("sales")).first()[0] == 1.5
