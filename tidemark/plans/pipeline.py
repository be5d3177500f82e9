"""The whole analysis composed (E1): profile -> EDA -> monthly series ->
STL -> features -> backtest + forecast -> explanation -> voted anomalies.

``run_pipeline`` writes the transactions once to the shared folder and
returns a dict of lazy DataFrames over them; further actions happen only at
model fits and when the caller writes or collects. The monthly feature
frame (one row per series and month) is persisted once and reused by
every downstream step.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import MODEL_FEATURES, PipelineConfig
from tidemark.operators import (anomaly, eda, evaluation, explain, forecast, iforest, profile,
                                series, stl, treeshap)
from tidemark.session import written

CFG = PipelineConfig()


def build_monthly(txn: DataFrame, key: str | None = None, cfg: PipelineConfig = CFG) -> DataFrame:
    """Monthly series with ``n_months`` per series (kept so model steps can
    skip series that are too short, SN4)."""
    m = series.monthly_series(txn, key, cfg)
    return m.withColumn("n_months", F.count(F.lit(1)).over(Window.partitionBy("series_key")))


def features_from_monthly(m: DataFrame) -> DataFrame:
    """STL + window features (C6 drops rows missing a model feature)."""
    return series.add_features(stl.with_stl(m))


def build_features(txn: DataFrame, key: str | None = None, cfg: PipelineConfig = CFG) -> DataFrame:
    return features_from_monthly(build_monthly(txn, key, cfg))


def series_status(m: DataFrame, fe: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    """SN4: per series, months, usable feature rows and whether it is long
    enough for the models; short series are reported, others go on."""
    months = m.groupBy("series_key").agg(F.count(F.lit(1)).alias("n_months"))
    rows = fe.groupBy("series_key").agg(F.count(F.lit(1)).alias("n_feature_rows"))
    g = months.join(rows, "series_key", "left").fillna(0, ["n_feature_rows"])
    return g.withColumn("status", F.when(F.col("n_months") >= cfg.min_months, "ok")
                                   .otherwise("too_short"))


def model_rows(fe: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    return fe.where(F.col("n_months") >= cfg.min_months)


def backtest_rows(m: DataFrame, fe: DataFrame, cfg: PipelineConfig = CFG) -> DataFrame:
    """Feature rows for the backtest: with ``stl_scope="train"`` the STL
    columns come from a fit on train months only (SN2)."""
    if cfg.stl_scope == "train":
        return model_rows(series.add_features(
            stl.with_stl_train_only(m, cfg.holdout, cfg.short_extra)), cfg)
    return model_rows(fe, cfg)


def fit_backtest_and_final(m: DataFrame, fe: DataFrame, cfg: PipelineConfig = CFG):
    """Backtest fit (train rows) and final fit (all rows) are independent:
    both are submitted at once. Returns (model rows, predictions, metrics,
    final models)."""
    mf = model_rows(fe, cfg)
    with ThreadPoolExecutor(max_workers=2) as pool:
        f_bt = pool.submit(forecast.backtest, backtest_rows(m, fe, cfg), cfg)
        f_full = pool.submit(forecast.fit_models, mf, cfg)
        (pred, metrics), models = f_bt.result(), f_full.result()
    return mf, pred, metrics, models


def run_pipeline(txn: DataFrame, cfg: PipelineConfig = CFG, key: str | None = None,
                 raw: DataFrame | None = None, with_models: bool = True) -> dict:
    out = {}
    txn = written(txn, "fact")  # every output below reads it: one join of the fact a run
    if raw is not None:
        out["schema_columns"] = profile.profile_columns(raw, cfg)
        out["schema_table"] = profile.profile_table(raw)
    for name, df in eda.eda_report(txn, cfg).items():
        out[f"eda_{name}"] = df
    m = build_monthly(txn, key, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    fe = features_from_monthly(m).persist(StorageLevel.MEMORY_AND_DISK)
    out["monthly"] = m
    out["features"] = fe
    out["series_status"] = series_status(m, fe, cfg)

    st = anomaly.stat_flags(fe, cfg)
    iso = iforest.isolation_flags(fe, cfg)
    flagged = st.join(iso.select("series_key", "period", "iso_flag"), ["series_key", "period"], "left") \
                .withColumn("iso_flag", F.coalesce("iso_flag", F.lit(False)))
    detectors = ["stat_flag", "iso_flag"]

    if with_models and not model_rows(fe, cfg).isEmpty():  # some series has a row to train on
        mf, pred, metrics, models = fit_backtest_and_final(m, fe, cfg)
        out["forecast_metrics"] = metrics.drop("rmse_raw")
        out["forecast_backtest"] = evaluation.backtest_rows(pred)
        fc = forecast.recursive_forecast(mf, models, metrics, cfg, m)
        out["forecast_future"] = fc
        imp = forecast.feature_importances(models[1], MODEL_FEATURES, txn.sparkSession)
        out["feature_importance"] = imp
        out["explain_global"] = explain.global_importance(imp, cfg)
        if cfg.explain_method == "tree_shap":
            scores = treeshap.shap_scores(mf, models[1], MODEL_FEATURES)
            out["explain_global"] = scores.groupBy("feature").agg(
                F.round(F.avg(F.abs("contribution")), 4).alias("shap"))
        else:
            scores = explain.deviation_scores(mf, imp, MODEL_FEATURES, cfg)
        out["explain_all"] = explain.top_contributions(scores, len(MODEL_FEATURES))
        top = explain.top_contributions(scores, cfg.top_contrib)
        out["explain_top"] = top
        out["explain_top_maps"] = explain.top_feature_maps(top)
        rf = anomaly.residual_flags(pred.where(F.col("is_test")), metrics, cfg)
        flagged = anomaly.attach_flags(flagged, rf, "resid_flag")
        detectors.append("resid_flag")
        out["anomaly_future_risks"] = anomaly.future_risks(fc, metrics, cfg)

    voted = anomaly.vote(flagged, detectors)
    out["anomaly_monthly_scores"] = anomaly.monthly_scores(voted)
    out["anomaly_confirmed"] = anomaly.confirmed(voted)
    out["anomaly_summary"] = anomaly.anomaly_summary(voted)
    return out
