"""Monthly series for many keys at once (A6/A7, C3, SN10) and their
window features (W1-W8, C6).

A series is identified by ``series_key`` (a string; ``'ALL'`` reproduces
the single series of the source pipeline). Every window is
``partitionBy("series_key").orderBy("period")``: the shuffle is on the
key, and a window partition holds one row per month of one key, so its
size is bounded by the calendar span, not by the data volume, even when a
single key carries a third of all transactions (those rows are combined
map-side by the monthly aggregation before any shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EMA_SPANS, LAGS, MODEL_FEATURES, ROLL_MEANS, ROLL_STDS, PipelineConfig
from tidemark.functions.dates import month_label, month_start
from tidemark.functions.numeric import pct, ratio, total
from tidemark.operators import distinct

CFG = PipelineConfig()
#: Rows of a series that one EMA is folded over at a time.
EMA_BLOCK = 128
#: Roles whose distinct values are counted, and the counts' names.
ID_ROLES = {"order_id": "n_orders", "product_id": "n_products", "customer_id": "n_customers"}


def _w():
    return Window.partitionBy("series_key").orderBy("period")


def series_key_expr(key: str | None) -> Column:
    if key is None:
        return F.lit("ALL")
    return F.col(key).cast("string")


def _distinct(txn: DataFrame, role: str, exact: bool, id_fallback: str):
    if role in txn.columns:
        return F.countDistinct(role) if exact else F.approx_count_distinct(role)
    if id_fallback == "sales":
        return F.countDistinct("sales") if exact else F.approx_count_distinct("sales")
    return F.count(F.lit(1))


def _counted_series(src: DataFrame, key: str | None, roles: list[str]) -> DataFrame:
    """Sales and exact distinct counts from one scan; roles that are not
    there count rows."""
    src, ids = distinct.with_ids(src, roles)
    by = {"series_key": series_key_expr(key), "period": month_start("order_date")}
    missing = [r for r in ID_ROLES if r not in roles]
    parts = distinct.states(src, by, [ids[r] for r in roles], with_rows=bool(missing))
    m = distinct.counted(parts, list(by), [ID_ROLES[r] for r in roles])
    if missing:  # rows without a date are no month then
        m = m.where(F.col("period").isNotNull()).withColumns({ID_ROLES[r]: F.col("rows") for r in missing})
    return m.select(*by, "sales", *ID_ROLES.values(), F.col("mean_amount").alias("avg_txn_sale"))


def monthly_series(txn: DataFrame, key: str | None = None, cfg: PipelineConfig = CFG,
                   id_fallback: str = "rows", with_counts: bool = True) -> DataFrame:
    """One row per (series_key, month with data): sales and transaction counts.

    ``sales`` is an exact decimal sum, so every feature computed from it is
    the same on every run. Rows with a NULL key form no series."""
    src = txn.where(F.col(key).isNotNull()) if key is not None else txn
    roles = [r for r in ID_ROLES if r in src.columns]
    if with_counts and cfg.exact_distinct and roles and (len(roles) == len(ID_ROLES) or id_fallback == "rows"):
        m = _counted_series(src, key, roles)
        return (fill_month_gaps(m) if cfg.fill_gaps else m).withColumn("period_label", month_label("period"))
    aggs = [total("sales").alias("sales")]
    if with_counts:
        aggs += [
            _distinct(src, "order_id", cfg.exact_distinct, id_fallback).cast("long").alias("n_orders"),
            _distinct(src, "product_id", cfg.exact_distinct, id_fallback).cast("long").alias("n_products"),
            _distinct(src, "customer_id", cfg.exact_distinct, id_fallback).cast("long").alias("n_customers"),
            F.avg("sales").alias("avg_txn_sale"),
        ]
    m = (src.groupBy(series_key_expr(key).alias("series_key"),
                     month_start("order_date").alias("period"))
            .agg(*aggs))
    if cfg.fill_gaps:
        m = fill_month_gaps(m)
    return m.withColumn("period_label", month_label("period"))


def fill_month_gaps(m: DataFrame) -> DataFrame:
    """SN10: a calendar spine per series from its first to its last month;
    months without sales get 0 sales and 0 counts."""
    bounds = m.groupBy("series_key").agg(F.min("period").alias("_a"), F.max("period").alias("_b"))
    spine = bounds.select("series_key", F.explode(
        F.sequence("_a", "_b", F.expr("INTERVAL 1 MONTH"))).alias("period"))
    filled = spine.join(m, ["series_key", "period"], "left")
    zero_cols = {c: F.coalesce(F.col(c), F.lit(0).cast(m.schema[c].dataType)).alias(c)
                 for c in m.columns if c not in ("series_key", "period", "avg_txn_sale")}
    return filled.select("series_key", "period",
                         *[zero_cols.get(c, F.col(c)) for c in m.columns
                           if c not in ("series_key", "period")])


def _guarded(agg_fn, k: int) -> Column:
    """Trailing k-row statistic over the rows BEFORE the current one; NULL
    until k such rows exist (pandas ``shift(1).rolling(k)``)."""
    frame = _w().rowsBetween(-k, -1)
    return F.when(F.count("sales").over(frame) == k, agg_fn("sales").over(frame))


def ema_of_previous(hist: Column, span: int, start: Column | None = None) -> Column:
    """Unadjusted EMA (alpha = 2/(span+1)) of the previous values, seeded
    with the first one, or going on from ``start``. ``hist`` is the array of
    previous values in order."""
    a = 2.0 / (span + 1.0)
    return F.aggregate(hist, F.lit(None).cast("double") if start is None else start,
                       lambda acc, x: F.coalesce(F.lit(1.0 - a) * acc + F.lit(a) * x, x))


def _through(pairs: Column, span: int, start: Column) -> Column:
    """``start`` taken through blocks in order: a block of (n values, own
    EMA from zero) turns y into (1 - alpha)^n * y + own."""
    a = 2.0 / (span + 1.0)
    return F.aggregate(pairs, start, lambda y, p: F.coalesce(
        F.pow(F.lit(1.0 - a), p["n"]) * y + p[f"own{span}"], p[f"own{span}"]))


def add_emas(m: DataFrame, spans=EMA_SPANS, value: str = "sales", order: str = "period", block: int = EMA_BLOCK) -> DataFrame:
    """``ema<span>`` of the rows before each row, as a segmented scan.

    An EMA step is y -> decay * y + own, and such steps compose to one of
    their kind. So rows are folded inside blocks of ``block`` rows, blocks
    inside groups of ``block`` blocks, and groups over the series: no array
    is longer than ``block`` up to block^3 rows, and the work grows with the
    rows, not with their square. A series within one block is folded value by
    value, as without blocks."""
    key = "series_key"
    rows = m.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    rows = rows.withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_g", F.floor(F.col("_i") / (block * block)))
    before = lambda *by: Window.partitionBy(key, *by).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_hist", F.collect_list(value).over(before("_g", "_b")))
    # what a block, seen at its last row, does to an EMA that goes through it; the first block has none before it
    whole = F.concat("_hist", F.array(F.col(value).cast("double")))
    whole = F.filter(whole, lambda x: x.isNotNull())
    zero = F.lit(0.0)
    seen = F.count(value).over(before()) - F.size("_hist")  # values before the block
    rows = rows.withColumn("_seen", seen)
    own = [F.when(F.col("_seen") == 0, ema_of_previous(whole, s)).otherwise(ema_of_previous(whole, s, zero)).alias(f"own{s}") for s in spans]
    ends = F.floor((F.col("_i") + 1) / block) > F.col("_b")
    rows = rows.withColumn("_pair", F.when(ends, F.struct(F.size(whole).cast("double").alias("n"), *own)))
    rows = rows.withColumn("_blocks", F.collect_list("_pair").over(before("_g")))
    rows = rows.withColumn("_seen", F.col("_seen") - F.aggregate("_blocks", zero, lambda acc, p: acc + p["n"]))  # and before the group
    blocks = F.when(F.col("_pair").isNotNull(), F.concat("_blocks", F.array("_pair"))).otherwise(F.col("_blocks"))
    none = F.lit(None).cast("double")
    n = F.aggregate(blocks, zero, lambda acc, p: acc + p["n"])
    group = [_through(blocks, s, F.when(F.col("_seen") == 0, none).otherwise(zero)).alias(f"own{s}") for s in spans]
    closes = F.floor((F.col("_i") + 1) / (block * block)) > F.col("_g")
    rows = rows.withColumn("_group", F.when(closes, F.struct(n.alias("n"), *group)))
    rows = rows.withColumn("_groups", F.collect_list("_group").over(before()))
    found = [ema_of_previous(F.col("_hist"), s, _through(F.col("_blocks"), s, _through(F.col("_groups"), s, none))).alias(f"ema{s}")
             for s in spans]
    return rows.select(*m.columns, *found)


def add_features(m: DataFrame, drop_incomplete: bool = True, extra_required=()) -> DataFrame:
    """W1-W8 on a monthly series frame; C6 drops rows missing a model feature.

    Lags count ROWS, not calendar months (no spine unless ``fill_gaps``)."""
    cols = [F.col(c) for c in m.columns]
    for k in LAGS:
        cols.append(F.lag("sales", k).over(_w()).alias(f"lag{k}"))
    for k in ROLL_MEANS:
        cols.append(_guarded(F.avg, k).alias(f"roll{k}_mean"))
    for k in ROLL_STDS:
        cols.append(_guarded(F.stddev_samp, k).alias(f"roll{k}_std"))
    f = add_emas(m.select(*cols))
    f = f.select(
        "*",
        F.month("period").alias("month"),
        F.quarter("period").alias("quarter"),
        F.year("period").alias("year"),
        (F.month("period") >= 10).cast("int").alias("is_q4"),
        pct(F.col("sales") - F.col("lag1"), "lag1").alias("mom_pct"),
        pct(F.col("sales") - F.col("lag12"), "lag12").alias("yoy_pct"),
        (F.col("sales") - F.col("roll3_mean")).alias("dev_roll3"),
    )
    if drop_incomplete:
        required = [c for c in MODEL_FEATURES if c in f.columns] + list(extra_required)
        f = f.dropna(subset=required)
    return f


def zscore(col: str = "sales") -> Column:
    """Z-score over the whole series (sample std); NULL if std is 0."""
    p = Window.partitionBy("series_key")
    return ratio(F.col(col) - F.avg(col).over(p), F.stddev_samp(col).over(p))
