"""Run ledger and message log as DataFrame operators.

The ledger is an append-only status log ``(run_id, file_name, status, ts)``;
the current state of a run is its latest event. Latest-per-key is a
``max_by`` aggregate, which Spark combines map-side, so a key with many
events sends one partial row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Run states.
RUNNING, COMPLETED, FAILED = "RUNNING", "COMPLETED", "FAILED"

LEDGER_SCHEMA = "run_id string, file_name string, status string, ts timestamp"
MESSAGE_SCHEMA = "run_id string, seq long, sender string, message string, ts timestamp"


def status_event(spark: SparkSession, run_id: str, file_name: str | None, status: str) -> DataFrame:
    """One status event row (registration is the RUNNING event)."""
    return spark.createDataFrame([(run_id, file_name, status)],
                                 "run_id string, file_name string, status string") \
                .withColumn("ts", F.current_timestamp())


def latest_status(log: DataFrame, key: str = "run_id", status: str = "status", ts: str = "ts",
                  tie: str | None = None, keep=("file_name",)) -> DataFrame:
    """Current state per key: the status of the latest event (ties by ``tie``)."""
    order = F.struct(F.col(ts), F.col(tie)) if tie else F.col(ts)
    keep = [c for c in keep if c in log.columns]
    return log.groupBy(key).agg(
        F.max_by(F.col(status), order).alias(status),
        *[F.max_by(F.col(c), order).alias(c) for c in keep],
        F.max(ts).alias(ts),
        F.min(ts).alias("first_ts"))


def list_runs(current: DataFrame, ts: str = "ts") -> DataFrame:
    """Runs, newest first."""
    return current.orderBy(F.desc(ts))


def first_messages(msgs: DataFrame, limit: int = 20, key: str = "run_id", order: str = "seq") -> DataFrame:
    """The first ``limit`` messages of EVERY conversation, oldest first.

    ``row_number() <= limit`` is planned with a per-partition group limit
    before the shuffle, so a huge conversation sends at most ``limit`` rows
    per map task."""
    w = Window.partitionBy(key).orderBy(F.asc(order))
    return msgs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit).drop("_rn")
