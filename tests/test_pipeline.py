"""End to end on hand-written CSV input (FIXTURES F-A): binding, parsing,
rejected rows, the composed pipeline, planted anomalies, too-short series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import PipelineConfig
from tidemark.plans.pipeline import run_pipeline
from tidemark.sources.binding import rejected_rows
from tidemark.sources.csv_source import prepare, read_transactions_csv

CFG = PipelineConfig(gbt_iter=3, rf_trees=5, iso_trees=50)


def _month(i):
    return dt.date(2015 + i // 12, i % 12 + 1, 1)


def _write(tmp_path, long_months=40, short_months=10, spike=30, drop=33, skip=20):
    lines = ["Order ID,Order Date,Ship Date,Ship Mode,Sales,Region,Category,Customer ID,Product ID"]
    n = 0
    for region, months in (("East", long_months), ("West", short_months)):
        for i in range(months):
            if region == "East" and i == skip:
                continue  # a month without sales: lags count rows, not months
            base = 1000 + 300 * np.sin(2 * np.pi * i / 12) + 10 * i
            if region == "East" and i == spike:
                base *= 6
            if region == "East" and i == drop:
                base *= 0.05
            d = _month(i)
            for k in range(3):
                n += 1
                lines.append(f"o{n},{d.day + k:02d}/{d.month:02d}/{d.year},"
                             f"{d.day + k + 2:02d}/{d.month:02d}/{d.year},Std,{base / 3:.2f},"
                             f"{region},{'A' if k else 'B'},c{k},p{k}")
    lines.append("o-bad,not a date,,Std,10,East,A,c1,p1")
    lines.append("o-null,05/05/2016,,Std,,East,A,c1,p1")
    lines.append(f"o-nokey,05/05/2016,,Std,50,,A,c1,p1")
    p = tmp_path / "sales.csv"
    p.write_text("\n".join(lines) + "\n")
    return str(p)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = _write(tmp_path_factory.mktemp("fa"))
    raw = read_transactions_csv(spark, path)
    norm, txn, _ = prepare(raw)
    return raw, txn, run_pipeline(txn, CFG, key="region", raw=raw)


def test_rejected_rows_counted(spark, tmp_path):
    raw = read_transactions_csv(spark, _write(tmp_path))
    from tidemark.sources.binding import bind_roles, canonical_frame, normalise_headers
    norm = normalise_headers(raw)
    r = rejected_rows(canonical_frame(norm, bind_roles(norm.columns))).first()
    assert (r.bad_date, r.bad_sales, r.rejected) == (1, 1, 2)


def test_profile_runs_on_raw_rows(docs):
    raw, _, out = docs
    cols = {r.column: r for r in out["schema_columns"].collect()}
    assert cols["order_date"].role == "time" and cols["sales"].null_count == 1
    assert out["schema_table"].first().n_rows == raw.count()


def test_series_status_and_short_series(docs):
    _, _, out = docs
    st = {r.series_key: r.status for r in out["series_status"].collect()}
    assert st == {"East": "ok", "West": "too_short"}
    keys = {r.series_key for r in out["forecast_future"].collect()}
    assert keys == {"East"}
    assert out["forecast_future"].count() == 12


def test_planted_spike_and_drop_confirmed(docs):
    _, _, out = docs
    conf = {(r.period, r.direction) for r in out["anomaly_confirmed"].where("series_key = 'East'").collect()}
    spike = _month(30).strftime("%Y-%m")
    drop = _month(33).strftime("%Y-%m")
    assert (spike, "spike") in conf and (drop, "drop") in conf


def test_breakdown_shares_use_all_rows(docs):
    _, txn, out = docs
    reg = {r.region: r.pct for r in out["eda_regional_breakdown"].collect()}
    assert set(reg) == {"East", "West"} and sum(reg.values()) < 100.0


def test_explanations_and_importances(docs):
    _, _, out = docs
    imp = out["feature_importance"].collect()
    assert len(imp) == 18
    top = out["explain_top"].groupBy("series_key", "period").count().collect()
    assert top and all(r["count"] == 6 for r in top)
    maps = out["explain_top_maps"].first().top_features
    assert len(maps) == 6


def test_job_lifecycle_and_failure(spark, tmp_path):
    from tidemark.plans.job import get_run, run_csv_job
    from tidemark.sources import store
    base = str(tmp_path / "results")
    ok = run_csv_job(spark, _write(tmp_path), base, run_id="r-ok", key="region", cfg=CFG)
    bad_path = tmp_path / "bad.csv"
    bad_path.write_text("Foo,Bar\n1,2\n")
    bad = run_csv_job(spark, str(bad_path), base, run_id="r-bad", cfg=CFG)
    assert (ok, bad) == ("COMPLETED", "FAILED")
    st = {r.run_id: r.status for r in store.current_runs(spark, base).collect()}
    assert st == {"r-ok": "COMPLETED", "r-bad": "FAILED"}
    docs = get_run(spark, base, "r-ok")
    assert docs["eda_summary"].count() == 1 and docs["anomaly_summary"].count() == 1
    assert get_run(spark, base, "r-ok", ["forecast_future"])["forecast_future"].count() == 12
