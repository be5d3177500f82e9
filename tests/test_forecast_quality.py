"""Beat-naive check: on a clean seasonal series the two-model
forecast must beat the last-train-value baseline (MASE < 1)."""

import datetime as dt

import numpy as np

from tidemark.config import PipelineConfig
from tidemark.operators import forecast
from tidemark.plans import pipeline


def test_models_beat_naive_on_seasonal_series(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(72):
        d = dt.datetime(2010 + i // 12, i % 12 + 1, 3)
        level = 10000 + 60 * i + 3000 * np.sin(2 * np.pi * i / 12)
        for k in range(4):
            rows.append((d, float(level / 4 * (1 + 0.02 * rng.normal())), f"o{i}-{k}"))
    txn = spark.createDataFrame(rows, "order_date timestamp, sales double, order_id string")
    cfg = PipelineConfig(gbt_iter=30, rf_trees=30)
    m = pipeline.build_monthly(txn, None, cfg).cache()
    fe = pipeline.features_from_monthly(m).cache()
    _, metrics = forecast.backtest(pipeline.backtest_rows(m, fe, cfg), cfg)
    r = metrics.first()
    assert r.n_test == 12 and r.mase < 1.0, r
