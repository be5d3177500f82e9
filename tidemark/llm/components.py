"""Connected components of a link table by alternating large-star and
small-star rounds (Kiveris et al. 2014), each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(low, "u").where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. Only nodes of some
    link appear, roots included; links of a node to itself are ignored.
    Columns of ``links``: u, v (long). An empty table gives none."""
    links = (links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
             .where("u > v").distinct())
    links = written(spark, links, "links")
    before = _state(links)
    while before[0]:
        links = written(spark, _small_star(_large_star(links)), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    members = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
