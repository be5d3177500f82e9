"""Invariants for the operators without a SQL oracle."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_MID, SF_SMALL
from tidemark.config import PipelineConfig
from tidemark.operators import forecast, iforest, stl, throttle
from tidemark.operators.stl import stl as stl_np


def test_stl_recovers_planted_signal():
    t = np.arange(84)
    y = 1000 + 5 * t + 100 * np.sin(2 * np.pi * t / 12)
    y[40] += 800
    tr, se, re = stl_np(y, 12)
    assert np.abs(tr - (1000 + 5 * t))[6:-6].max() < 1.0
    assert np.abs(se - 100 * np.sin(2 * np.pi * t / 12))[6:-6].max() < 1.0
    assert re[40] > 700


def test_stl_per_series_distributed(spark):
    rows = [(k, dt.date(2000 + i // 12, i % 12 + 1, 1), float(100 + i + (k == "b") * 50 * np.sin(i)))
            for k in ("a", "b") for i in range(36)]
    m = spark.createDataFrame(rows, "series_key string, period date, sales double")
    d = stl.decompose(m).collect()
    assert len(d) == 72 and all(np.isfinite(r.stl_trend) for r in d)
    for r in d:
        assert r.stl_trend + r.stl_seasonal + r.stl_resid == pytest.approx(
            next(x[2] for x in rows if x[0] == r.series_key and x[1] == r.period))


def test_isolation_forest_flags_planted_outlier(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        v = [float(x) for x in rng.normal(0, 1, 6)]
        if i == 30:
            v = [12.0] * 6
        rows.append(("k", dt.date(2000 + i // 12, i % 12 + 1, 1), *v))
    cols = ["sales", "lag1", "lag2", "lag12", "roll3_mean", "roll3_std"]
    fe = spark.createDataFrame(rows, "series_key string, period date, " + ", ".join(f"{c} double" for c in cols))
    out = iforest.isolation_flags(fe).orderBy(F.desc("iso_score")).collect()
    assert out[0].period == dt.date(2002, 7, 1)
    share = sum(r.iso_flag for r in out) / len(out)
    assert 0.05 <= share <= 0.15


def test_recursive_forecast_shape_and_bands(spark):
    from tidemark.plans.pipeline import build_features
    from tidemark.sources.tables import sales_fact
    cfg = PipelineConfig(gbt_iter=3, rf_trees=5)
    fe = build_features(sales_fact(spark, SF_SMALL, ["order_date", "sales", "region"]), "region", cfg).cache()
    pred, metrics = forecast.backtest(fe, cfg)
    models = forecast.fit_models(fe, cfg)
    fc = forecast.recursive_forecast(fe, models, metrics, cfg).collect()
    n_series = fe.select("series_key").distinct().count()
    assert len(fc) == 12 * n_series
    for r in fc:
        assert r.lower_90 <= r.forecast <= r.upper_90 and r.forecast >= cfg.forecast_floor
    imp = forecast.feature_importances(models[1], spark=spark).collect()
    assert len(imp) == 18 and abs(sum(r.importance for r in imp) - 1.0) < 0.01


def _events(spark, sf):
    from tidemark.sources.tables import read_table
    return read_table(spark, sf, "events").select("event_id", "user_id", "ts")


def test_token_bucket_denies_with_tight_bucket(spark):
    out = throttle.token_bucket(_events(spark, SF_MID), capacity=2.0, rate=1.0 / 3600.0)
    agg = out.agg(F.count_if(~F.col("allowed")).alias("denied"), F.count("*").alias("n")).first()
    assert agg.n == 10000 and agg.denied > 0
    # the first two events of every user are always allowed
    w = __import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("user_id").orderBy("ts", "event_id")
    first2 = out.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    assert first2.where(~F.col("allowed")).count() == 0


@pytest.mark.parametrize("watermark", ["3650 days", "1 hour"])
def test_stream_equals_batch(spark, tmp_path, watermark):
    from tidemark.streaming.throttle_stream import throttle_stream
    ev = _events(spark, SF_SMALL)
    batch = {r.event_id: r.allowed for r in throttle.token_bucket(ev, capacity=2.0, rate=1 / 3600.0).collect()}
    # feed the events as three files in event-time order
    src = str(tmp_path / "src")
    pdf = ev.toPandas().sort_values(["ts", "event_id"])
    parts = np.array_split(pdf, 3)
    import os
    os.makedirs(src)
    schema = ev.schema
    stream = throttle_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                             .option("recursiveFileLookup", "true").parquet(src),
                             capacity=2.0, rate=1 / 3600.0, watermark=watermark)
    q = (stream.writeStream.format("memory").queryName("thr").outputMode("append")
               .option("checkpointLocation", str(tmp_path / "ck")).start())
    for i, p in enumerate(parts):
        spark.createDataFrame(p, schema).coalesce(1).write.parquet(f"{src}/part{i}")
        q.processAllAvailable()
    got = {r.event_id: r.allowed for r in spark.sql("SELECT * FROM thr").collect()}
    held = q.lastProgress.stateOperators[0].numRowsTotal
    q.stop()
    # with a short watermark, keys whose buckets are full again hold no state
    assert (held < pdf["user_id"].nunique()) == (watermark == "1 hour")
    missing = set(batch) - set(got)
    diff = [k for k in got if got[k] != batch.get(k)]
    assert not missing and not diff, (len(batch), len(got), len(missing), len(diff))


def test_store_roundtrip_and_ledger(spark, tmp_path):
    from tidemark.sources import store
    base = str(tmp_path / "store")
    df = spark.createDataFrame([("2020-01", 1.0)], "period string, sales double")
    store.save_run_results("r1", {"monthly": df}, base)
    store.save_run_results("r2", {"monthly": df}, base)
    store.save_run_results("r1", {"monthly": df.withColumn("sales", F.lit(2.0))}, base)
    got = store.get_run_results(spark, base, "r1", ["monthly"], marker="monthly")["monthly"].collect()
    assert [r.sales for r in got] == [2.0]
    assert store.get_run_results(spark, base, "r2", ["monthly"], marker="monthly")["monthly"].count() == 1
    assert store.get_run_results(spark, base, "r3", ["monthly"], marker="monthly") is None
    store.append_status(spark, base, "r1", "RUNNING", "a.csv")
    store.append_status(spark, base, "r1", "COMPLETED", "a.csv")
    cur = store.current_runs(spark, base).collect()
    assert [(r.run_id, r.status) for r in cur] == [("r1", "COMPLETED")]
    js = store.to_json_rows(df).first().json
    assert '"sales":1.0' in js


def test_empty_rerun_leaves_no_rows(spark, tmp_path):
    from tidemark.sources import store
    base = str(tmp_path / "out")
    df = spark.createDataFrame([("ALL", 1.0)], "series_key string, sales double")
    for run in ("a/b=1", "r2"):
        store.save_run_results(run, {"monthly": df}, base)
    store.save_run_results("a/b=1", {"monthly": df.limit(0)}, base)
    assert [r.run_id for r in spark.read.parquet(base + "/monthly").collect()] == ["r2"]


def test_naive_projection_has_every_step(spark):
    from tidemark.operators import evaluation
    months = [("S", i, float(i)) for i in range(5)] + [("L", i, float(i)) for i in range(20)]
    fe = spark.createDataFrame(months, "series_key string, i int, sales double").select(
        "series_key", F.expr("add_months(date'2020-01-01', i)").alias("period"), "sales")
    got = {}
    for r in evaluation.seasonal_naive_projection(fe, 18).orderBy("step").collect():
        got.setdefault(r.series_key, []).append(r.forecast_raw)
    assert got == {"S": [float(h % 5) for h in range(18)], "L": [8.0 + h % 12 for h in range(18)]}


def test_landing_ingest_stream(spark, tmp_path):
    from tidemark.sources import store
    from tidemark.streaming.landing import start_landing_ingest
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.csv").write_text("Order Date,Sales,Order ID\n01/02/2017,10,o1\n03/02/2017,5,o2\n")
    (land / "b.csv").write_text("Revenue,Order ID,Order Date\n7,o9,01/03/2017\nN/A,o8,01/03/2017\n2,o7,never\n")
    (land / "c.csv").write_text("Sales,Order Date\nN/A,01/03/2017\n")
    (land / "d.csv").write_text("Nothing\n1\n")
    (land / "skip.txt").write_text("not csv")
    base = str(tmp_path / "out")
    q = start_landing_ingest(spark, str(land), base, str(tmp_path / "ck"))
    q.awaitTermination(240)
    k = {r.run_id.rsplit("/", 1)[-1]: (r.total_sales, r.total_orders)
         for r in spark.read.parquet(base + "/eda_summary").collect()}
    assert k == {"a.csv": (15.0, 2), "b.csv": (7.0, 1)}
    st = {r.run_id.rsplit("/", 1)[-1]: r.status for r in store.current_runs(spark, base).collect()}
    assert st == {"a.csv": "COMPLETED", "b.csv": "COMPLETED", "c.csv": "FAILED", "d.csv": "FAILED"}
    why = {r.run_id.rsplit("/", 1)[-1]: r.reason for r in spark.read.parquet(base + "/failure").collect()}
    assert "no usable row" in why["c.csv"] and "order_date" in why["d.csv"]
    bad = {r.run_id.rsplit("/", 1)[-1]: (r.bad_date, r.bad_sales, r.n_rows)
           for r in spark.read.parquet(base + "/rejected_rows").collect()}
    assert bad == {"a.csv": (0, 0, 2), "b.csv": (1, 1, 3)}
    months = spark.read.parquet(base + "/eda_monthly_trend").where(F.col("run_id").endswith("a.csv")).count()
    assert months == 1


def test_tree_shap_additive_on_spark_forest(spark):
    from tidemark.config import MODEL_FEATURES
    from tidemark.operators import treeshap
    from tidemark.plans.pipeline import build_features
    from tidemark.sources.tables import sales_fact
    cfg = PipelineConfig(gbt_iter=2, rf_trees=8)
    fe = build_features(sales_fact(spark, SF_SMALL, ["order_date", "sales", "region"]), "region", cfg).cache()
    _, rf = forecast.fit_models(fe, cfg)
    scores = treeshap.shap_scores(fe, rf, MODEL_FEATURES)
    total = scores.groupBy("series_key", "period").agg(F.sum("contribution").alias("phi"))
    base = treeshap.expected_value(treeshap.forest_arrays(spark, rf))
    pred = rf.transform(forecast.assembler().transform(fe)).select("series_key", "period", F.col("p_rf").alias("prediction"))
    rows = total.join(pred, ["series_key", "period"]).collect()
    assert rows and all(abs(r.phi + base - r.prediction) < 1e-6 for r in rows)


def test_stl_train_only_has_no_look_ahead(spark):
    rows = [("k", dt.date(2000 + i // 12, i % 12 + 1, 1), float(100 + i + 20 * np.sin(i))) for i in range(48)]
    m = spark.createDataFrame(rows, "series_key string, period date, sales double")
    a = {r.period: r.stl_trend for r in stl.with_stl_train_only(m).collect()}
    changed = rows[:-1] + [(rows[-1][0], rows[-1][1], 99999.0)]
    b = {r.period: r.stl_trend for r in stl.with_stl_train_only(
        spark.createDataFrame(changed, "series_key string, period date, sales double")).collect()}
    assert a == b  # a holdout value never reaches the STL columns


def test_rolling_origin_cv(spark):
    from tidemark.plans.pipeline import build_features
    from tidemark.sources.tables import sales_fact
    cfg = PipelineConfig(gbt_iter=2, rf_trees=3)
    fe = build_features(sales_fact(spark, SF_SMALL, ["order_date", "sales"]), None, cfg).cache()
    cv = forecast.rolling_origin_cv(fe, cfg, folds=2).collect()
    assert sorted(r.fold for r in cv) == [1, 2] and all(r.n_test == 12 for r in cv)


def test_token_bucket_segments_split_hot_key(spark):
    from tidemark.operators.throttle import _epoch_micros, refill_segments
    base = dt.datetime(2024, 1, 1)
    rows, eid = [], 0
    for c in range(6):  # six bursts of 30 events, three hours apart (> full refill)
        for k in range(30):
            rows.append((eid, 7, base + dt.timedelta(hours=3 * c, seconds=k)))
            eid += 1
    ev = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz")
    seg = refill_segments(ev.withColumn("_us", _epoch_micros("ts")), "user_id", "_us", "event_id", 2.0, 1 / 3600.0)
    assert seg.select("_seg").distinct().count() == 6
    a = {r.event_id: (r.allowed, r.tokens) for r in throttle.token_bucket(ev, capacity=2.0, rate=1 / 3600.0).collect()}
    b = {r.event_id: (r.allowed, r.tokens) for r in throttle.token_bucket(
        ev, capacity=2.0, rate=1 / 3600.0, split_segments=False).collect()}
    assert a == b and sum(x[0] for x in a.values()) == 6 * 2


def test_step_features_continue_the_training_features(spark):
    from tidemark.operators import series
    rows = [("A", dt.date(2020 + i // 12, i % 12 + 1, 1), 100.0 + (i * 37) % 50) for i in range(25)]
    m = spark.createDataFrame(rows, "series_key string, period date, sales double")
    last = series.add_features(m).orderBy(F.desc("period")).first()
    state = spark.createDataFrame([("A", rows[-2][1], [r[2] for r in rows[:-1]], [0.0, 0.0], [0.0])],
                                  "series_key string, last_period date, hist array<double>, "
                                  "trend_hist array<double>, season_hist array<double>")
    step = forecast.step_features(state).first()
    for name in ("lag1", "lag12", "roll3_mean", "roll6_std", "roll12_mean", "ema3", "ema6", "ema12", "month", "is_q4"):
        assert abs(step[name] - last[name]) < 1e-9, name

def test_token_bucket_blocks_of_a_long_segment(spark, monkeypatch):
    base = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(3)
    at = np.cumsum(rng.integers(0, 3_000_000, 3000))  # no gap of a full refill: one segment
    rows = [(i, k, base + dt.timedelta(microseconds=int(t))) for i, t in enumerate(at) for k in ("a", "b") if k == "a" or i % 3 == 0]
    ev = spark.createDataFrame([(2 * i + (k == "b"), k, t) for i, k, t in rows], "event_id long, user_id string, ts timestamp_ntz")
    whole = {r.event_id: (r.user_id, r.allowed, r.tokens) for r in throttle.token_bucket(ev, capacity=10.0, rate=0.2, split_segments=False).collect()}
    monkeypatch.setattr(throttle, "BLOCK_EVENTS", 200)
    got = throttle.token_bucket(ev, capacity=10.0, rate=0.2)
    assert {r.event_id: (r.user_id, r.allowed, r.tokens) for r in got.collect()} == whole and len(whole) == 4000
    assert "_block" in got._jdf.queryExecution().optimizedPlan().toString()  # 15 and 5 tasks' work, not one for each key
