"""Exact distinct counts that merge: 64 ids to a word of bits.

``countDistinct`` of several columns in one aggregate expands every row once
for each column and shuffles the distinct values themselves. Here an id is a
bit of the word ``id >> 6``; the words of a group are or-ed in the hash
aggregate, map-side too, and counted at the end. Words of different inputs can
be or-ed later, so they are also the stored partial state of a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tidemark.functions.numeric import MONEY_TYPE

WHOLE = (ByteType, ShortType, IntegerType, LongType)
#: States that one task merges, on average: about 100 MB of hash tables.
TASK_STATES = 200_000
#: Columns of a state beside its grouping columns.
STATE = ("kind", "word", "bits", "sales", "amount", "n")


def number_values(df: DataFrame, column: str) -> DataFrame:
    """(value, id): the distinct non-null values of a column with ids from 0
    without gaps, in ascending order. Values are sorted over all tasks; only
    one count for each task is added up in one place."""
    ranged = (df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
              .repartitionByRange("value").select("value", F.spark_partition_id().alias("part")))
    ranged = ranged.withColumn("j", F.row_number().over(Window.partitionBy("part").orderBy("value")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.max("j").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranged.join(F.broadcast(starts), "part").select("value", (F.col("start") + F.col("j") - 1).alias("id"))


def with_ids(df: DataFrame, roles: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a whole-number id for each role; columns that are no
    whole numbers are joined to their dictionary."""
    ids = {}
    for role in roles:
        if isinstance(df.schema[role].dataType, WHOLE):
            ids[role] = F.col(role).cast("long")
            continue
        numbers = number_values(df, role).select(F.col("value").alias(f"_{role}"), F.col("id").alias(f"_{role}_id"))
        df = df.join(numbers, df[role] == numbers[f"_{role}"], "left").drop(f"_{role}")
        ids[role] = F.col(f"_{role}_id")
    return df, ids


def _bit(kind: int, at: Column) -> Column:
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return F.struct(F.lit(kind).alias("kind"), F.shiftright(at, 6).alias("word"), F.coalesce(one, F.lit(0).cast("long")).alias("bits"))


def states(df: DataFrame, by: dict[str, Column], ids: list[Column], amount: str = "sales", with_rows: bool = False) -> DataFrame:
    """Partial states of ``df``: by, kind (which of ``ids``, or -1 without
    any), word, bits, and on kind's first the exact sum, the sum and count
    of ``amount`` (``with_rows``: also the count of all rows). Null ids are
    no bit; their rows count for the amount."""
    first = -1 if not ids else 0
    parts = [_bit(k, c) for k, c in enumerate(ids)] or [_bit(-1, F.lit(None).cast("long"))]
    rows = df.select(*[c.alias(n) for n, c in by.items()], F.col(amount).alias("_amount"), F.explode(F.array(*parts)).alias("_bit"))
    mine = F.when(F.col("kind") == first, F.col("_amount"))
    return (rows.select(*by, "_amount", "_bit.*").groupBy(*by, "kind", "word")
            .agg(F.bit_or("bits").alias("bits"), F.sum(mine.try_cast(MONEY_TYPE)).alias("sales"),
                 F.sum(mine.cast("double")).alias("amount"), F.count(mine).alias("n"),
                 *([F.count_if(F.col("kind") == first).alias("rows")] if with_rows else [])))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """States of several inputs as one. Few of them meet, so that a hash table
    map-side would hold nearly all states of a split, which are a few bytes
    each in its file: they are cut into even ranges of ``by`` from its last
    column on, as many as their number asks for, and only then merged."""
    ranges = [*reversed(by), "kind", "word"]
    tasks = 1 + parts.count() // TASK_STATES
    return parts.repartitionByRange(tasks, *ranges).groupBy(*by, "kind", "word").agg(
        F.bit_or("bits").alias("bits"), F.sum("sales").cast("decimal(38,4)").alias("sales"), F.sum("amount").alias("amount"), F.sum("n").alias("n"))


def counted(parts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by, sales (the exact sum as a double), ``names`` (the distinct ids of
    each kind) and mean amount of merged or unmerged states of one input;
    also rows, if the states have them."""
    counts = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.bit_count("bits").cast("long"))), F.lit(0)).alias(n) for k, n in enumerate(names)]
    return parts.groupBy(*by).agg(F.sum("sales").cast("double").alias("sales"), *counts,
                                  F.try_divide(F.sum("amount"), F.sum("n")).alias("mean_amount"),
                                  *([F.sum("rows").alias("rows")] if "rows" in parts.columns else []))
