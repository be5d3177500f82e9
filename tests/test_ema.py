"""The segmented EMA scan against pandas, over block borders and nulls."""

import numpy as np
import pandas as pd
import pytest

from tidemark.config import EMA_SPANS
from tidemark.operators import series


@pytest.mark.parametrize("block", [3, 8, 128])
def test_scan_equals_pandas(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for key, n, empty in (("a", 1, 0), ("b", 9, 0), ("c", 300, 0), ("d", 130, 70), ("e", 40, 40), ("f", 27, 1)):
        rows += [(key, i, None if i < empty or rng.random() < 0.1 else float(rng.integers(1, 10**6))) for i in range(n)]
    df = spark.createDataFrame(rows, "series_key string, period long, sales double").repartition(5)
    got = series.add_emas(df, block=block).toPandas().sort_values(["series_key", "period"])
    assert len(got) == len(rows)
    for key, g in got.groupby("series_key"):
        values = g["sales"].dropna()
        for s in EMA_SPANS:  # the EMA of the values before a row; rows without a value change nothing
            want = values.ewm(span=s, adjust=False).mean().reindex(g.index).ffill().shift()
            np.testing.assert_allclose(g[f"ema{s}"].astype(float), want.astype(float), rtol=1e-12)


def test_a_series_of_one_block_is_folded_as_before(spark):
    values = [float(x) / 7 for x in range(1, 90)]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "series_key string, period long, sales double")
    got = {r.period: r.ema6 for r in series.add_emas(df).collect()}
    ema, a = None, 2.0 / 7
    for i, v in enumerate(values):
        assert got[i] == ema  # the same bits
        ema = v if ema is None else (1.0 - a) * ema + a * v
