"""Per-key token bucket on event time (T2, batch form).

A bucket of ``capacity`` tokens refills at ``rate`` tokens per second of
EVENT time (elapsed = ts - previous ts of the same key) and an event is
allowed when at least one token is left, which it then spends. With one
constant key this is the single global upload limiter of the source
(burst of 10, then one per 5 s).

The recurrence is sequential per key (a denied event does not spend),
so it has no closed form as a window expression. The plan: cut every key's
events at full-refill points into independent segments
(``refill_segments``), cut segments of many events into blocks of time
(``BLOCK_EVENTS``), hash-partition on (key, segment, block), sort inside
partitions, then one streaming pass per partition in ``mapInPandas`` with
O(1) state carried across Arrow batches. The bucket's level where a block
begins comes from a pass over the times alone, the first blocks of all long
segments at once, then their second ones, and so on (``block_starts``): that
is sequential by nature, but no task sorts or holds more than a few blocks.
A block is made of whole refill widths (capacity / rate seconds), so that a
single width's events stay together.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tidemark.session import written

#: Events of a segment beyond which it is cut into blocks of about so many.
BLOCK_EVENTS = 500_000
#: What a block's events carry of the bucket where the block begins.
START = ("_level", "_since")


def spend(micros: np.ndarray, capacity: float, rate: float, level: float, since: int) -> tuple[np.ndarray, np.ndarray]:
    """(allowed, tokens left) for one key's events in time order, from a
    bucket that held ``level`` tokens at ``since``."""
    refill = np.diff(micros, prepend=since) / 1000000.0 * rate
    left, allowed = np.empty(len(micros)), np.empty(len(micros), bool)
    for i, more in enumerate(refill.tolist()):
        level = min(capacity, level + more)
        allowed[i] = level >= 1.0
        level -= allowed[i]
        left[i] = level
    return allowed, left


def _groups(columns: list) -> list[tuple[int, int, tuple]]:
    """(first row, end, values) of the runs of equal values in a batch."""
    rows = list(zip(*columns))
    starts = [i for i in range(len(rows)) if i == 0 or rows[i] != rows[i - 1]]
    return [(a, z, rows[a]) for a, z in zip(starts, [*starts[1:], len(rows)])]


def _scan(by: list[str], ts_us: str, capacity: float, rate: float, blocks: bool):
    def run(batches):
        held = None  # (group, level, time) after the last event of the batch before
        for pdf in batches:
            micros = pdf[ts_us].to_numpy(dtype=np.int64)
            starts = [pdf[c].to_numpy() for c in START] if blocks else None
            allowed, left = np.empty(len(pdf), bool), np.empty(len(pdf))
            for a, z, group in _groups([pdf[c].to_numpy() for c in by]):
                if held and held[0] == group:
                    level, since = held[1:]
                else:
                    level, since = (float(starts[0][a]), int(starts[1][a])) if blocks else (capacity, micros[a])
                allowed[a:z], left[a:z] = spend(micros[a:z], capacity, rate, level, since)
                held = group, float(left[z - 1]), micros[z - 1]
            yield pdf.assign(allowed=allowed, tokens=left).drop(columns=[*by[1:], ts_us, *(START if blocks else ())])
    return run


def _ends(by: list[str], ts_us: str, capacity: float, rate: float):
    """The last event of each group with the level after it."""
    def run(batches):
        held = None
        for pdf in batches:
            micros, starts = pdf[ts_us].to_numpy(dtype=np.int64), [pdf[c].to_numpy() for c in START]
            for a, z, group in _groups([pdf[c].to_numpy() for c in by]):
                if held and held[0] == group:
                    level, since = held[1:3]
                else:
                    if held:
                        yield held[3]
                    level, since = float(starts[0][a]), int(starts[1][a])
                left = float(spend(micros[a:z], capacity, rate, level, since)[1][-1])
                held = group, left, micros[z - 1], pdf.iloc[z - 1:z][by].assign(_level=left, _since=micros[z - 1])
        if held:
            yield held[3]
    return run


def _epoch_micros(ts: str):
    """Wall-clock microseconds since 1970 (time-zone independent)."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                            F.col(ts).cast("timestamp_ntz"))


def refill_segments(events: DataFrame, key: str, ts_us: str, tie: str,
                    capacity: float, rate: float) -> DataFrame:
    """Adds ``_seg``: events of a key split where the bucket is provably full.

    After a gap g with g * rate >= capacity the bucket holds ``capacity``
    tokens whatever happened before, so the events from there on form an
    independent segment. Events are put in buckets of width capacity / rate;
    only the first event of a bucket can start a segment, and its exact
    predecessor is the last event of the previous occupied bucket, found
    with ``lag`` over ONE ROW PER OCCUPIED BUCKET (bounded by the time span,
    not by the number of events). The test uses the same floating-point
    expression as the scan, so segment starts are exact."""
    ev = _bucketed(events, ts_us, capacity, rate)
    return ev.join(_segments(ev, key, ts_us, capacity, rate).select(key, "_bucket", "_seg"), [key, "_bucket"]).drop("_bucket")


def _bucketed(events: DataFrame, ts_us: str, capacity: float, rate: float) -> DataFrame:
    return events.withColumn("_bucket", F.floor(F.col(ts_us) / F.lit(capacity / rate * 1_000_000.0)).cast("long"))


def _segments(ev: DataFrame, key: str, ts_us: str, capacity: float, rate: float) -> DataFrame:
    """Per occupied bucket its segment, and its block in the segment: the
    next one whenever ``BLOCK_EVENTS`` more events have come before."""
    g = ev.groupBy(key, "_bucket").agg(F.min(ts_us).alias("_first"), F.max(ts_us).alias("_last"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy("_bucket")
    prev = F.lag("_last").over(w)
    reset = prev.isNull() | ((F.col("_first") - prev) / F.lit(1000000.0) * F.lit(rate) >= F.lit(capacity))
    g = g.withColumn("_reset", reset)
    g = g.withColumn("_seg", F.max(F.when(F.col("_reset"), F.col("_bucket"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    mine = Window.partitionBy(key, "_seg")
    before = F.sum("_n").over(mine.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("_block", F.floor(F.coalesce(before, F.lit(0)) / F.lit(BLOCK_EVENTS)))
    block = F.dense_rank().over(mine.orderBy("_block")) - 1  # a large bucket skips numbers
    return g.select(key, "_bucket", "_seg", block.cast("long").alias("_block"))


def block_starts(ev: DataFrame, g: DataFrame, key: str, ts_us: str, capacity: float, rate: float) -> DataFrame:
    """key, _seg, _block, _level, _since: the bucket after the last event
    before each block but a segment's first. Only segments of more than one
    block are read, only their times, and one block of each at a time."""
    spark, by = ev.sparkSession, [key, "_seg", "_block"]
    long = g.where("_block > 0").select(key, "_seg").distinct()
    mine = ev.select(key, "_bucket", ts_us).join(g.join(long, [key, "_seg"]), [key, "_bucket"]).drop("_bucket")
    times = written(mine.repartition(*by).sortWithinPartitions("_block"), "blocks")
    state = StructType([*times.select(*by).schema.fields, StructField("_level", DoubleType()), StructField("_since", LongType())])
    ends, now = [], spark.createDataFrame([], state)
    for block in sorted(r[0] for r in times.select("_block").distinct().collect()):
        rows = times.where(F.col("_block") == block).join(F.broadcast(now), by, "left")
        rows = rows.withColumns({"_level": F.coalesce("_level", F.lit(capacity)), "_since": F.coalesce("_since", F.col(ts_us))})
        found = rows.repartition(*by).sortWithinPartitions(*by, ts_us).mapInPandas(_ends(by, ts_us, capacity, rate), state)
        last = found.withColumn("_block", F.lit(block + 1).cast("long")).collect()  # a row for each long segment
        now, ends = spark.createDataFrame(last, state), ends + last
    return spark.createDataFrame(ends, state)


def token_bucket(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id",
                 capacity: float = 10.0, rate: float = 0.2, num_partitions: int | None = None,
                 split_segments: bool = True) -> DataFrame:
    """Adds ``allowed`` (bool) and ``tokens`` (left after the event).

    With ``split_segments`` (default) a key's events are cut at full-refill
    points into independent segments, which are hash-partitioned on
    (key, segment): a hot key with idle gaps is spread over many tasks.
    Within a segment the scan is sequential and exact."""
    src = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    out_fields = list(src.schema.fields) + [StructField("allowed", BooleanType()),
                                            StructField("tokens", DoubleType())]
    src = src.withColumn("_us", _epoch_micros(ts))
    by, blocks = [key, "_seg"], False
    if split_segments and rate > 0:
        capacity, rate = float(capacity), float(rate)
        ev = _bucketed(src, "_us", capacity, rate)
        g = written(_segments(ev, key, "_us", capacity, rate), "segments")
        blocks = not g.where("_block > 0").isEmpty()
        if blocks:
            by = [key, "_seg", "_block"]
            starts = F.broadcast(block_starts(ev, g, key, "_us", capacity, rate))
            src = ev.join(g, [key, "_bucket"]).join(starts, by, "left")
            src = src.withColumns({"_level": F.coalesce("_level", F.lit(capacity)), "_since": F.coalesce("_since", F.col("_us"))})
        else:
            src = ev.join(g.drop("_block"), [key, "_bucket"])
        src = src.drop("_bucket")
    else:
        src = src.withColumn("_seg", F.lit(0).cast("long"))
    parts = src.repartition(num_partitions, *by) if num_partitions else src.repartition(*by)
    parts = parts.sortWithinPartitions(*by, "_us", tie)
    return parts.mapInPandas(_scan(by, "_us", float(capacity), float(rate), blocks), StructType(out_fields))


def token_bucket_sql(capacity: float, rate: float, table: str = "events", key: str = "user_id",
                     ts: str = "ts", tie: str = "event_id") -> str:
    """Oracle: the same recurrence as a recursive CTE (DuckDB)."""
    cap = f"CAST('{capacity!r}' AS DOUBLE)"
    r = f"CAST('{rate!r}' AS DOUBLE)"
    refill = f"LEAST({cap}, tb.tok + (date_diff('microsecond', tb.ts, e.ts) / 1000000.0) * {r})"
    return f"""WITH RECURSIVE ev AS (
  SELECT {key} AS k, {tie} AS tie, {ts} AS ts,
         row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {tie}) AS rn
  FROM {table} WHERE {key} IS NOT NULL AND {ts} IS NOT NULL),
tb(k, rn, tie, ts, tok, allowed) AS (
  SELECT k, rn, tie, ts, CASE WHEN {cap} >= 1.0 THEN {cap} - 1.0 ELSE {cap} END, {cap} >= 1.0
  FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.tie, e.ts,
         CASE WHEN {refill} >= 1.0 THEN {refill} - 1.0 ELSE {refill} END,
         {refill} >= 1.0
  FROM tb JOIN ev e ON e.k = tb.k AND e.rn = tb.rn + 1)"""
