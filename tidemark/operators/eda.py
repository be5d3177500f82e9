"""Exploratory report over the canonical transaction frame.

Each function returns a DataFrame (lazy). The total that a share needs is
the sum of the group rows (one for each category, segment or region), so
the transactions are read and aggregated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig
from tidemark.functions.dates import lead_days, month_label
from tidemark.functions.money import money_times
from tidemark.functions.numeric import exact_total, money, pct, ratio, rnd, total

CFG = PipelineConfig()


def _orders_expr(txn: DataFrame, exact: bool = True, id_fallback: str = "rows"):
    """Distinct orders; without an id column: row count (default) or the
    source pipeline's distinct sales values (``id_fallback="sales"``)."""
    if "order_id" in txn.columns:
        c = "order_id"
    elif id_fallback == "sales":
        c = "sales"
    else:
        return F.count(F.lit(1))
    return F.countDistinct(c) if exact else F.approx_count_distinct(c)


def kpi_summary(txn: DataFrame, cfg: PipelineConfig = CFG, id_fallback: str = "rows",
                group_cols=()) -> DataFrame:
    """A1-A5: totals, orders, average order value, profit, margin, date range.

    ``group_cols`` computes the same KPIs per group (e.g. per ``run_id`` for
    several landed files in one micro-batch)."""
    has_profit = "profit" in txn.columns
    agg = txn.groupBy(*group_cols).agg(
        total("sales").alias("_sales"),
        _orders_expr(txn, cfg.exact_distinct, id_fallback).alias("total_orders"),
        (total("profit") if has_profit else F.lit(None).cast("double")).alias("_profit"),
        F.min("order_date").alias("_dmin"),
        F.max("order_date").alias("_dmax"),
    )
    profit_raw = F.col("_profit") if has_profit else F.col("_sales") * F.lit(cfg.profit_rate_estimate)
    total_profit = (money("_profit") if has_profit
                    else money_times("_sales", cfg.profit_rate_estimate))
    return agg.select(
        *group_cols,
        money("_sales").alias("total_sales"),
        F.col("total_orders").cast("long").alias("total_orders"),
        rnd(F.coalesce(ratio("_sales", "total_orders"), F.lit(0.0)), 2).alias("avg_order_value"),
        total_profit.alias("total_profit"),
        F.when(F.col("_sales") > 0, rnd(pct(profit_raw, "_sales"), 2))
         .otherwise(F.lit(0.0)).alias("profit_margin_pct"),
        F.date_format("_dmin", "yyyy-MM-dd").alias("date_min"),
        F.date_format("_dmax", "yyyy-MM-dd").alias("date_max"),
        F.lit(not has_profit).alias("profit_is_estimated"),
    )


def monthly_sales(txn: DataFrame) -> DataFrame:
    """Sales per calendar month, YYYY-MM label, rounded to cents."""
    return (txn.groupBy(month_label("order_date").alias("period"))
               .agg(money(total("sales")).alias("sales")))


def _grouped(txn: DataFrame, key: str, *aggs) -> DataFrame:
    """One row per named value of ``key`` with _s (exact sales) and _total
    (over all groups, the rows without a name among them)."""
    g = txn.groupBy(F.col(key).cast("string").alias(key)).agg(exact_total("sales").alias("_d"), *aggs)
    every = F.sum("_d").over(Window.partitionBy())  # over one row per group
    return (g.withColumn("_total", every.cast("double")).withColumn("_s", F.col("_d").cast("double"))
             .where(F.col(key).isNotNull()).drop("_d"))


def category_breakdown(txn: DataFrame, cfg: PipelineConfig = CFG, key: str = "category") -> DataFrame:
    """Sales, profit and share of total per category.

    The total is over ALL usable rows, while rows with a NULL key form no
    group (as in the source), so shares can sum to less than 100."""
    if key not in txn.columns:
        return _empty_breakdown(txn, key, with_profit=True)
    has_profit = "profit" in txn.columns
    g = _grouped(txn, key, (total("profit") if has_profit else F.lit(None).cast("double")).alias("_p"))
    profit = money("_p") if has_profit else money_times("_s", cfg.profit_rate_estimate)
    return g.select(key, money("_s").alias("sales"), profit.alias("profit"),
                    rnd(pct("_s", "_total"), 2).alias("pct"),
                    F.lit(not has_profit).alias("profit_is_estimated"))


def share_breakdown(txn: DataFrame, key: str) -> DataFrame:
    """Percent of total sales per value of ``key`` (segment, region)."""
    if key not in txn.columns:
        return _empty_breakdown(txn, key, with_profit=False)
    return _grouped(txn, key).select(key, rnd(pct("_s", "_total"), 2).alias("pct"))


def _empty_breakdown(txn: DataFrame, key: str, with_profit: bool) -> DataFrame:
    spark = txn.sparkSession
    schema = (f"{key} string, sales double, profit double, pct double, profit_is_estimated boolean"
              if with_profit else f"{key} string, pct double")
    return spark.createDataFrame([], schema)


def ship_lead_times(txn: DataFrame) -> DataFrame:
    """A11 + C5 + C8: mean whole-day lead time per ship mode, 1 decimal.
    Modes whose lead times are all NULL are skipped."""
    if "ship_date" not in txn.columns or "ship_mode" not in txn.columns:
        return txn.sparkSession.createDataFrame([], "ship_mode string, avg_lead_days double")
    g = (txn.where(F.col("ship_mode").isNotNull())
            .groupBy(F.col("ship_mode").cast("string").alias("ship_mode"))
            .agg(F.avg(lead_days("order_date", "ship_date")).alias("_avg")))
    return g.where(F.col("_avg").isNotNull()).select(
        "ship_mode", rnd("_avg", 1).alias("avg_lead_days"))


# Fixed values: (output kind, preferred column, fallback column, k).
TOP_ENTITY_SPECS = (
    ("products", "product_name", "product_id", 10),
    ("customers", "customer_name", "customer_id", 5),
    ("states", "state", None, 5),
    ("cities", "city", None, 5),
)


def top_entities(txn: DataFrame, column: str, k: int, kind: str | None = None) -> DataFrame:
    """K2: the k names with the largest summed sales.

    ``orderBy(...).limit(k)`` plans as TakeOrderedAndProject: every
    partition keeps its own top k, only k rows per partition move. Ties on
    sales are broken by name (the source leaves them unordered)."""
    kind = kind or column
    if column not in txn.columns:
        return txn.sparkSession.createDataFrame([], "kind string, rank bigint, name string, sales double")
    g = (txn.where(F.col(column).isNotNull())
            .groupBy(F.col(column).cast("string").alias("name"))
            .agg(total("sales").alias("_s")))
    top = g.orderBy(F.desc("_s"), F.asc("name")).limit(k)
    w = Window.orderBy(F.desc("_s"), F.asc("name"))  # over at most k rows
    return top.select(F.lit(kind).alias("kind"), F.row_number().over(w).cast("long").alias("rank"),
                      "name", money("_s").alias("sales"))


def top_entities_report(txn: DataFrame, specs=TOP_ENTITY_SPECS) -> DataFrame:
    """All top-k lists of the report in ONE pass over the transactions.

    ``groupingSets`` aggregates sales per product, customer and state in a
    single scan and shuffle; ``row_number() <= max k`` per list is planned
    as a per-partition group limit before the final exchange, so each map
    task sends at most k rows per list whatever the number of names."""
    chosen = []
    for kind, col, fallback, k in specs:
        use = col if col in txn.columns else (fallback if fallback and fallback in txn.columns else None)
        if use is not None:
            chosen.append((kind, use, k))
    if not chosen:
        return txn.sparkSession.createDataFrame([], "kind string, rank bigint, name string, sales double")
    cols = [F.col(use).cast("string").alias(f"_n{i}") for i, (_, use, _) in enumerate(chosen)]
    names = [f"_n{i}" for i in range(len(chosen))]
    base = txn.select("sales", *cols)
    g = base.groupingSets([[n] for n in names], *names).agg(
        total("sales").alias("_s"), F.grouping_id().alias("_gid"))
    # exactly one name column is set per grouping set; its grouping id tells which
    nbits = len(names)
    kind_of = F.lit(None).cast("string")
    name_of = F.lit(None).cast("string")
    k_of = F.lit(0)
    for i, (kind, _, k) in enumerate(chosen):
        gid = (1 << nbits) - 1 - (1 << (nbits - 1 - i))
        hit = F.col("_gid") == gid
        kind_of = F.when(hit, F.lit(kind)).otherwise(kind_of)
        name_of = F.when(hit, F.col(names[i])).otherwise(name_of)
        k_of = F.when(hit, F.lit(k)).otherwise(k_of)
    g = g.select(kind_of.alias("kind"), name_of.alias("name"), "_s", k_of.alias("_k")) \
         .where(F.col("name").isNotNull())
    w = Window.partitionBy("kind").orderBy(F.desc("_s"), F.asc("name"))
    kmax = max(k for _, _, k in chosen)
    ranked = g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kmax)
    return ranked.where(F.col("rank") <= F.col("_k")).select(
        "kind", F.col("rank").cast("long").alias("rank"), "name", money("_s").alias("sales"))


def sales_histogram(txn: DataFrame, bins: int = CFG.hist_bins) -> DataFrame:
    """Equal-width histogram of log1p(sales), edges mapped back by expm1.

    Values <= -1 have no log1p and are left out (counted by
    ``histogram_rejects``). A constant range is widened by +-0.5, and the
    maximum lands in the last bin, as in numpy."""
    spark = txn.sparkSession
    x = txn.select(F.log1p("sales").alias("x")).where(F.col("x").isNotNull())
    stats = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    stats = stats.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    lo = stats.select("lo").scalar()
    hi = stats.select("hi").scalar()
    step = (hi - lo) / F.lit(float(bins))
    edge = lambda i: F.when(i >= F.lit(bins), hi).otherwise(lo + i.cast("double") * step)
    # numpy's rule: index from (x - lo) * (bins / (hi - lo)), then corrected
    # against the actual edges so that edge[i] <= x < edge[i + 1]
    x_ = F.col("x")
    i0 = F.floor((x_ - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    i0 = F.when(i0 >= bins, F.lit(bins - 1)).otherwise(i0)
    i1 = i0 - F.when(x_ < edge(i0), 1).otherwise(0)
    i2 = i1 + F.when((x_ >= edge(i1 + 1)) & (i1 != bins - 1), 1).otherwise(0)
    counts = x.select(i2.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spine = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (spine.join(counts, "bin", "left")
                 .select("bin",
                         F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                         rnd(F.expm1(edge(F.col("bin"))), 2).alias("lower"),
                         rnd(F.expm1(edge(F.col("bin") + 1)), 2).alias("upper"))
                 .where(lo.isNotNull()))


def histogram_rejects(txn: DataFrame) -> DataFrame:
    return txn.agg(F.count_if(F.col("sales") <= -1).alias("rejected_log1p"))


def eda_report(txn: DataFrame, cfg: PipelineConfig = CFG) -> dict:
    """The full EDA document as a dict of lazy DataFrames."""
    return {
        "summary": kpi_summary(txn, cfg),
        "monthly_trend": monthly_sales(txn),
        "category_breakdown": category_breakdown(txn, cfg),
        "segment_breakdown": share_breakdown(txn, "segment"),
        "regional_breakdown": share_breakdown(txn, "region"),
        "shipping_lead_times": ship_lead_times(txn),
        "top_entities": top_entities_report(txn),
        "sales_distribution": sales_histogram(txn, cfg.hist_bins),
    }
