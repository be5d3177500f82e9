"""Per-key token bucket on an event stream (T2, streaming form).

``groupBy(key).applyInPandasWithState`` keeps (tokens, last event time)
per key in the state store. Inside a micro-batch a key's new rows are
sorted by (ts, tie); rows older than the key's last processed event are
late and dropped, and so are rows behind the watermark. A key's state
expires once the watermark has passed the time by which its bucket is full
again: a later event finds a full bucket with or without the state. Fed in
event-time order, the stream gives the same rows as the batch operator.
The rows of one key and micro-batch are held together, so the trigger
(files or offsets per batch) bounds the memory.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType, TimestampNTZType

from tidemark.operators.throttle import _epoch_micros, spend

STATE_SCHEMA = "tokens double, last_us long"


def _fn(key: str, ts: str, tie: str, capacity: float, rate: float):
    full_ms = math.ceil(capacity / rate * 1000.0) + 1 if rate > 0 else None

    def run(k, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs)).sort_values(["_us", tie])
        level, since = state.get if state.exists else (capacity, int(pdf["_us"].iloc[0]))
        pdf = pdf[pdf["_us"] >= since]
        if pdf.empty:  # all late
            return
        micros = pdf["_us"].to_numpy(dtype=np.int64)
        allowed, left = spend(micros, capacity, rate, level, since)
        state.update((float(left[-1]), int(micros[-1])))
        if full_ms is not None:
            state.setTimeoutTimestamp(max(int(pdf["_ms"].max()) + full_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: pdf[key].to_numpy(), tie: pdf[tie].to_numpy(), ts: pdf["_wall"].to_numpy(),
                            "allowed": allowed, "tokens": left})
    return run


def throttle_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id",
                    capacity: float = 10.0, rate: float = 0.2, watermark: str = "1 hour") -> DataFrame:
    """(key, tie, ts, allowed, tokens) for every event that is not late."""
    # elapsed time comes from wall-clock microseconds (time-zone independent);
    # the watermark needs an instant type, so it runs on a cast copy
    src = (events.withColumn("_us", _epoch_micros(ts))
                 .withColumn("_wall", F.col(ts).cast("timestamp_ntz"))
                 .withColumn(ts, F.col(ts).cast("timestamp"))
                 .withColumn("_ms", F.unix_millis(ts))
                 .withWatermark(ts, watermark).select(key, tie, ts, "_us", "_ms", "_wall"))
    out = StructType([events.schema[key], events.schema[tie], StructField(ts, TimestampNTZType()),
                      StructField("allowed", BooleanType()), StructField("tokens", DoubleType())])
    return src.groupBy(key).applyInPandasWithState(
        _fn(key, ts, tie, float(capacity), float(rate)), out, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)
