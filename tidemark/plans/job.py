"""One analysis run over one input, as the source's upload lifecycle:
register RUNNING -> bind and clean -> whole analysis (E1) -> store and commit
all result documents under the run id (S6) -> COMPLETED, or FAILED with the
reason. A rerun that fails leaves what the run had committed before.

    from tidemark.plans.job import run_csv_job
    run_csv_job(spark, "s3://bucket/landing/train.csv", "s3://bucket/results")
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig
from tidemark.operators import ledger
from tidemark.plans.pipeline import run_pipeline
from tidemark.session import ship_package
from tidemark.sources import store
from tidemark.sources.binding import canonical_frame, rejected_rows
from tidemark.sources.csv_source import prepare, read_transactions_csv

CFG = PipelineConfig()


def run_job(raw: DataFrame, base: str, run_id: str, file_name: str | None = None,
            key: str | None = None, cfg: PipelineConfig = CFG, with_models: bool = True) -> str:
    """Runs the analysis on raw rows and stores it; returns the final status."""
    spark = raw.sparkSession
    ship_package(spark)  # the session need not be one of get_spark
    store.append_status(spark, base, run_id, ledger.RUNNING, file_name)
    docs: dict[str, DataFrame] = {}
    try:
        normalised, txn, binding = prepare(raw)
        rejected = rejected_rows(canonical_frame(normalised, binding)).persist()
        docs["rejected_rows"] = rejected
        counts = rejected.first()
        if counts.rejected == counts.n_rows:
            raise ValueError(f"no usable row: {counts.bad_date} without a date, {counts.bad_sales} without sales")
        docs |= run_pipeline(txn, cfg, key=key, raw=raw, with_models=with_models)
        store.save_run_results(run_id, docs, base)
        status = ledger.COMPLETED
    except Exception as e:
        status = ledger.FAILED
        store.save_failure(spark, run_id, f"{type(e).__name__}: {e}"[:2000], base)
    finally:
        for name in ("rejected_rows", "monthly", "features"):  # what this run persisted
            if name in docs:
                docs[name].unpersist()
    store.append_status(spark, base, run_id, status, file_name)
    return status


def run_csv_job(spark: SparkSession, path: str, base: str, run_id: str | None = None,
                key: str | None = None, cfg: PipelineConfig = CFG, with_models: bool = True) -> str:
    run_id = run_id or str(uuid.uuid4())
    return run_job(read_transactions_csv(spark, path), base, run_id, os.path.basename(path),
                   key, cfg, with_models)


RESULT_DOCS = ("schema_columns", "schema_table", "eda_summary", "eda_monthly_trend",
               "eda_category_breakdown", "eda_segment_breakdown", "eda_regional_breakdown",
               "eda_shipping_lead_times", "eda_top_entities", "eda_sales_distribution",
               "monthly", "features", "series_status", "rejected_rows",
               "forecast_metrics", "forecast_backtest", "forecast_future", "feature_importance",
               "explain_global", "explain_all", "explain_top", "explain_top_maps",
               "anomaly_monthly_scores", "anomaly_confirmed", "anomaly_summary", "anomaly_future_risks")


def get_run(spark: SparkSession, base: str, run_id: str, names=RESULT_DOCS) -> dict | None:
    """The stored documents of one run whose last outcome is COMPLETED;
    of a FAILED one the document ``failure`` with its reason; None of a run
    that is unknown or RUNNING. ``store.get_run_results`` gives what a run
    had committed before it was started again."""
    now = store.current_runs(spark, base).where(F.col("run_id") == run_id).first()
    if now is None or now.status == ledger.RUNNING:
        return None
    if now.status == ledger.FAILED:
        return {"failure": spark.createDataFrame([(store.failure(spark, base, run_id),)], "reason string")}
    return store.get_run_results(spark, base, run_id, names)


def main(argv=None) -> int:
    """python -m tidemark.plans.job INPUT.csv RESULTS_DIR [--run-id ID] [--key COL] [--no-models]"""
    import argparse

    from tidemark.session import get_spark

    ap = argparse.ArgumentParser(prog="tidemark.plans.job")
    ap.add_argument("input")
    ap.add_argument("results")
    ap.add_argument("--run-id")
    ap.add_argument("--key", help="series key column (role name), e.g. region")
    ap.add_argument("--no-models", action="store_true")
    a = ap.parse_args(argv)
    spark = get_spark()
    status = run_csv_job(spark, a.input, a.results, a.run_id, a.key, CFG, not a.no_models)
    print(status)
    return 0 if status == ledger.COMPLETED else 1


if __name__ == "__main__":
    raise SystemExit(main())
