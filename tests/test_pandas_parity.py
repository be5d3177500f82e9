"""The window features and statistical flags equal the pandas expressions
the source pipeline is written with, on a real monthly series."""

import numpy as np
import pandas as pd

from tests.conftest import SF_MID
from tidemark.operators import anomaly, series
from tidemark.sources.tables import sales_fact


def test_features_and_stats_equal_pandas(spark):
    m = series.monthly_series(sales_fact(spark, SF_MID, ["order_date", "sales"]), with_counts=False)
    ours = series.add_features(m, drop_incomplete=False).orderBy("period").toPandas()
    s = ours["sales"]
    ref = pd.DataFrame({"sales": s})
    for k in (1, 2, 3, 6, 12):
        ref[f"lag{k}"] = s.shift(k)
    ref["roll3_mean"] = s.shift(1).rolling(3).mean()
    ref["roll3_std"] = s.shift(1).rolling(3).std()
    ref["roll6_mean"] = s.shift(1).rolling(6).mean()
    ref["roll6_std"] = s.shift(1).rolling(6).std()
    ref["roll12_mean"] = s.shift(1).rolling(12).mean()
    for span in (3, 6, 12):
        ref[f"ema{span}"] = s.shift(1).ewm(span=span, adjust=False).mean()
    ref["mom_pct"] = s.pct_change() * 100
    ref["yoy_pct"] = s.pct_change(12) * 100
    ref["dev_roll3"] = s - ref["roll3_mean"]
    for c in ref.columns:
        a, b = ours[c].to_numpy(dtype=float), ref[c].to_numpy(dtype=float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        ok = ~np.isnan(a)
        assert np.allclose(a[ok], b[ok], rtol=1e-9, atol=1e-6), c

    fe = series.add_features(m).orderBy("period")
    st = anomaly.stat_flags(fe).orderBy("period").toPandas()
    x = st["sales"]
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    z = (x - x.mean()) / x.std()
    assert np.allclose(st["q1"], q1) and np.allclose(st["q3"], q3)
    assert np.allclose(st["z_score"], z)
    flag = (x < q1 - 1.5 * (q3 - q1)) | (x > q3 + 1.5 * (q3 - q1)) | (z.abs() > 2.0)
    assert (st["stat_flag"] == flag).all()
