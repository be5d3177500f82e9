"""Result store on parquet.

* Results: every save of a run is an attempt with folders of its own,
  ``base/<document>/run_id=<run>/attempt=<attempt>``. Its last step is one row
  in the manifest, which names the attempt's documents and their schemas; a
  run's results are those of the last attempt there (S6, S7). A save that
  fails between documents has no row and is never read.
* Ledger: status events in a compacted log under ``base/_ledger``; the
  current state of a run is its latest event (S8-S10).
* Messages: append-only under ``base/_messages`` (S11).
* JSON edge: row-wise ``to_json`` / ``from_json``; NaN is nulled first
  since JSON has no NaN (S13).
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

from tidemark.operators import ledger
from tidemark.sources.logs import CompactedLog, Folder, latest_by

MANIFEST = ("run_id string,status string,number long,attempt string,committed_at timestamp,reason string,"
            "documents map<string,string>")
LEDGER = "run_id string,file_name string,status string,ts timestamp,first_ts timestamp"
#: Documents' folders beside which the store keeps its own.
OWN = ("_manifest", "_ledger", "_messages")


def _path(base: str, name: str) -> str:
    return f"{base.rstrip('/')}/{name}"


def _attempt_path(spark: SparkSession, base: str, name: str, run_id: str, attempt: str) -> str:
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
    return f"{_path(base, name)}/run_id={escaped}/attempt={attempt}"


def manifest(base: str) -> CompactedLog:
    """The last row of each run and status."""
    merge = latest_by(["run_id", "status"], ["number", "committed_at", "attempt"], MANIFEST)
    return CompactedLog(_path(base, "_manifest"), MANIFEST, "run_id", merge)


def _outcomes(spark: SparkSession, base: str, run_id: str) -> dict[str, Row]:
    """The manifest's last row of a run for each status, at most one each."""
    rows = manifest(base).state(spark).where(F.col("run_id") == run_id).collect()
    return {r.status: r for r in sorted(rows, key=lambda r: r.number)}


def _save(spark: SparkSession, base: str, run_id: str, status: str, docs: dict, reason: str | None = None) -> str:
    """Write documents as a new attempt and commit it; then delete what it
    takes the place of: earlier failures, and results if it has results."""
    attempt = uuid.uuid4().hex
    for name, df in docs.items():
        if name in OWN:
            raise ValueError(f"a document can't be called {name}")
        df.write.parquet(_attempt_path(spark, base, name, run_id, attempt))
    before = _outcomes(spark, base, run_id)
    number = max((r.number for r in before.values()), default=0) + 1
    schemas = {n: df.schema.json() for n, df in docs.items()}
    row = (run_id, status, number, attempt, datetime.now(timezone.utc), reason, schemas)
    manifest(base).append(spark.createDataFrame([row], MANIFEST).coalesce(1))
    for old in before.values():
        if old.status in (status, ledger.FAILED):
            for name in old.documents:
                Folder(spark, _attempt_path(spark, base, name, run_id, old.attempt)).delete()
    return attempt


def save_run_results(run_id: str, docs: dict, base: str) -> str:
    """Write every result DataFrame of a run, then commit them together;
    returns the attempt. What is stored of the run is replaced by the commit
    as a whole, also with documents that are empty or no longer there."""
    return _save(next(iter(docs.values())).sparkSession, base, run_id, ledger.COMPLETED, docs)


def save_failure(spark: SparkSession, run_id: str, reason: str, base: str) -> None:
    """The reason why a run has no results, also as its document ``failure``;
    results committed before stay, a later commit takes the failure's place."""
    _save(spark, base, run_id, ledger.FAILED, {"failure": spark.range(1).select(F.lit(reason).alias("reason"))}, reason)


def failure(spark: SparkSession, base: str, run_id: str) -> str | None:
    """The reason, if the run's last outcome is a failure."""
    last = max(_outcomes(spark, base, run_id).values(), key=lambda r: r.number, default=None)
    return last.reason if last and last.status == ledger.FAILED else None


def get_run_results(spark: SparkSession, base: str, run_id: str, names=None, marker: str | None = None) -> dict | None:
    """The documents of the run's last committed attempt (all, or those
    of ``names`` that it has); None without one, or if it has no document
    ``marker``. A document that was empty comes back empty with its columns."""
    row = _outcomes(spark, base, run_id).get(ledger.COMPLETED)
    if row is None or marker is not None and marker not in row.documents:
        return None
    wanted = row.documents if names is None else [n for n in names if n in row.documents]
    return {n: spark.read.schema(StructType.fromJson(json.loads(row.documents[n])))
            .parquet(_attempt_path(spark, base, n, run_id, row.attempt)).withColumn("run_id", F.lit(run_id)) for n in wanted}


def committed(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One document of all runs, each from its last committed attempt. The
    runs' folders are partitions, so that others' files are not read."""
    last = manifest(base).state(spark).where(F.col("status") == ledger.COMPLETED)
    last = last.where(F.map_contains_key("documents", name)).select("run_id", "attempt")
    stored = spark.read.option("basePath", _path(base, name)).parquet(_path(base, name))
    stored = stored.withColumn("run_id", F.col("run_id").cast("string")).withColumn("attempt", F.col("attempt").cast("string"))
    return stored.join(last, ["run_id", "attempt"], "left_semi").drop("attempt")


def vacuum(spark: SparkSession, base: str, older_than_s: float = 7 * 86400.0) -> int:
    """Delete the folders of attempts that were never committed (their save
    died) and have not changed for ``older_than_s``; returns how many."""
    kept = {r.attempt for r in manifest(base).state(spark).select("attempt").toLocalIterator()}
    limit, n = (time.time() - older_than_s) * 1000, 0
    for name, document, is_folder, _ in Folder(spark, base).list():
        if not is_folder or name in OWN:
            continue
        for _, run, is_run, _ in Folder(spark, document).list():
            for attempt, _, _, changed in Folder(spark, run).list() if is_run else ():
                if attempt.startswith("attempt=") and attempt.removeprefix("attempt=") not in kept and changed <= limit:
                    Folder(spark, run).delete(attempt)
                    n += 1
    return n


def status_log(base: str, tail_files: int = 64) -> CompactedLog:
    """Current state of each run: its latest event (of events at one time an
    outcome before RUNNING) and the time of its first."""
    def merge(rows: DataFrame) -> DataFrame:
        order = F.struct(F.col("ts"), F.col("status") != ledger.RUNNING, F.col("status"))
        return rows.groupBy("run_id").agg(
            F.max_by("file_name", order).alias("file_name"), F.max_by("status", order).alias("status"),
            F.max("ts").alias("ts"), F.min("first_ts").alias("first_ts"))
    return CompactedLog(_path(base, "_ledger"), LEDGER, "run_id", merge, tail_files)


def append_status(spark: SparkSession, base: str, run_id: str, status: str,
                  file_name: str | None = None) -> None:
    """S8 (status RUNNING) / S9 (COMPLETED, FAILED): append a status event."""
    append_log(ledger.status_event(spark, run_id, file_name, status).coalesce(1), base)


def append_log(events: DataFrame, base: str, tail_files: int = 64) -> None:
    """S8/S9 for many runs at once: append status events ``(run_id,
    file_name, status, ts)``, and fold the log once its tail is long."""
    status_log(base, tail_files).append(events.select("run_id", "file_name", "status", "ts", F.col("ts").alias("first_ts")))


def current_runs(spark: SparkSession, base: str) -> DataFrame:
    """Current status per run, newest first."""
    return ledger.list_runs(status_log(base).state(spark).select("run_id", "status", "file_name", "ts", "first_ts"))


def append_messages(msgs: DataFrame, base: str) -> None:
    """Messages ``(run_id, seq, sender, message, ts)``."""
    msgs.write.mode("append").parquet(_path(base, "_messages"))


def chat_history(spark: SparkSession, base: str, run_id: str | None = None, limit: int = 20) -> DataFrame:
    """S12 over the stored messages (all runs, or one)."""
    m = spark.read.parquet(_path(base, "_messages"))
    if run_id is not None:
        m = m.where(F.col("run_id") == run_id)
    return ledger.first_messages(m, limit)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON text per row; NaN -> null."""
    cols = [F.when(F.isnan(c.name), F.lit(None)).otherwise(F.col(c.name)).alias(c.name)
            if isinstance(c.dataType, (DoubleType, FloatType)) else F.col(c.name)
            for c in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def from_json_rows(js: DataFrame, schema) -> DataFrame:
    return js.select(F.from_json("json", schema).alias("r")).select("r.*")
