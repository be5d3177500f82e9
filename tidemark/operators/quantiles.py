"""Exact quantiles of groups of any size by histogram refinement.

``percentile`` holds every value of a group in one buffer. Here a group's
values are counted in bins, map-side, and only the bins that hold the wanted
ranks are counted again, finer; bins that have become small are ranked by a
window. No task holds more than the bins of a group or LEAF values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import written

BINS = 4096  # of a cell in each pass
LEAF = 10_000  # values of a cell that a window ranks


def _counted(values: DataFrame, cells: DataFrame, bins: int) -> DataFrame:
    """_key, cell, lo, hi, n of each bin of the cells: its own least and
    largest value and its count; cell numbers a key's cells."""
    inside = values.join(cells, "_key").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    # halves, as hi - lo may be beyond the largest double
    share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    at = F.least(F.floor(share * bins), F.lit(bins - 1))
    return inside.groupBy("_key", "cell", at.alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, by: list[str], value: str, probabilities: list[float], bins: int = BINS, leaf: int = LEAF) -> DataFrame:
    """by, n and one column ``q<i>`` for each probability: linear between the
    neighbouring values, as ``percentile``. Null and NaN values are left out,
    groups without any other have no row; null group columns are a group. A
    pass over ``df`` for each refinement: three for 10^10 values spread
    evenly."""
    spark: SparkSession = df.sparkSession
    key = F.struct(*by).alias("_key")
    # a struct of nulls joins like any value
    values = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key, F.col(value).cast("double").alias("v"))
    groups = written(values.groupBy("_key").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")), "groups")
    ranks = sorted({x for i in range(len(probabilities)) for x in ((i, 0), (i, 1))})
    position = lambda i: (F.col("n") - 1) * F.lit(float(probabilities[i]))
    wanted = groups.select("*", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(up).alias("up"), (F.ceil if up else F.floor)(position(i)).alias("rank")) for i, up in ranks])).alias("w"))
    wanted = wanted.select("_key", "w.*", "lo", "hi", F.col("n").alias("left"))
    found = None
    while True:
        value_at = F.when((F.col("lo") == F.col("hi")) | (F.col("rank") == 0), F.col("lo")).when(F.col("rank") == F.col("left") - 1, F.col("hi"))
        wanted = written(wanted.withColumn("value", value_at), "wanted")
        done = wanted.where("value is not null").select("_key", "i", "up", "value")
        found = done if found is None else found.unionByName(done)
        open_ = wanted.where("value is null").drop("value")
        cell = F.dense_rank().over(Window.partitionBy("_key").orderBy("lo", "hi"))
        open_ = written(open_.withColumn("cell", cell), "open")
        if open_.isEmpty():
            break
        small = open_.where(F.col("left") <= leaf)
        if not small.isEmpty():
            cells = small.select("_key", "cell", "lo", "hi").distinct()
            rows = values.join(cells, "_key").where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
            placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("_key", "cell").orderBy("v")) - 1)
            found = found.unionByName(written(small.join(placed.select("_key", "cell", "rank", F.col("v").alias("value")), ["_key", "cell", "rank"])
                                              .select("_key", "i", "up", "value"), "ranked"))
        open_ = open_.where(F.col("left") > leaf)
        if open_.isEmpty():
            break
        counts = _counted(values, open_.select("_key", "cell", "lo", "hi").distinct(), bins)
        upto = F.sum("n").over(Window.partitionBy("_key", "cell").orderBy("bin"))
        counts = counts.withColumn("before", upto - F.col("n")).withColumnRenamed("n", "count")
        wanted = (open_.drop("lo", "hi", "left").join(counts, ["_key", "cell"])
                  .where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("count")))
                  .select("_key", "i", "up", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi", F.col("count").alias("left")))
    ends = found.groupBy("_key").agg(*[F.max(F.when((F.col("i") == i) & (F.col("up") == up), F.col("value"))).alias(f"_{i}_{up}") for i, up in ranks])
    share = [position(i) - F.floor(position(i)) for i in range(len(probabilities))]
    columns = [(F.col(f"_{i}_0") * (1 - share[i]) + F.col(f"_{i}_1") * share[i]).alias(f"q{i}") for i in range(len(probabilities))]
    return groups.join(ends, "_key").select("_key.*", "n", *columns)
