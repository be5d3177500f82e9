"""Landing-folder ingest (T1), Structured Streaming.

The stream only discovers the paths of new CSV files; each is then read
with its own header, so columns are bound by name in any order (S2, S3). The
path is the run id, so re-processing a file overwrites its results instead
of duplicating them. Each micro-batch (``foreachBatch``, one file by
default) runs ``plans.job.run_job`` per file:
RUNNING, the whole analysis, results written partitioned by run id, then
COMPLETED or FAILED. Progress and exactly-once bookkeeping live in the
stream checkpoint; a replayed batch rewrites the same run partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.csv_source import read_transactions_csv


def _process(base: str, key: str | None, cfg, with_models: bool):
    def run(batch: DataFrame, epoch_id: int) -> None:
        from tidemark.plans.job import run_job
        # one run per landed file; a micro-batch holds maxFilesPerTrigger paths
        for run_id in sorted(r.path for r in batch.collect()):
            raw = read_transactions_csv(batch.sparkSession, run_id)
            run_job(raw, base, run_id, run_id.rsplit("/", 1)[-1], key, cfg, with_models)
    return run


def start_landing_ingest(spark: SparkSession, landing_dir: str, base: str, checkpoint_location: str,
                         available_now: bool = True,
                         files_per_batch: int = 1, key: str | None = None, cfg=None,
                         with_models: bool = True):
    """Every new ``*.csv`` in ``landing_dir`` becomes one run: the whole
    analysis (with the models if ``with_models``) stored under its run id,
    with RUNNING then COMPLETED / FAILED in the ledger."""
    from tidemark.config import PipelineConfig
    cfg = cfg or PipelineConfig()
    stream = (spark.readStream.format("binaryFile").option("pathGlobFilter", "*.csv")
                   .option("maxFilesPerTrigger", files_per_batch)
                   .schema("path string, modificationTime timestamp, length long, content binary")
                   .load(landing_dir).select("path"))
    writer = (stream.writeStream.foreachBatch(_process(base, key, cfg, with_models))
                    .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
