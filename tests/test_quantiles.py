"""Quantiles by histogram refinement against numpy."""

import numpy as np
import pytest

from tidemark.operators.quantiles import exact_quantiles

AT = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def groups():
    rng = np.random.default_rng(1)
    return {"even": rng.random(3000) * 100, "skewed": np.exp(rng.normal(0, 8, 2500)), "ties": np.repeat([3.0, -1.0, 3.0], 700),
            "one": np.array([5.0]), "two": np.array([-2.0, 7.0]), None: rng.integers(-5, 5, 900).astype(float),
            "huge": np.concatenate([rng.random(900), [1e308, -1e308]]), "powers": 2.0 ** np.arange(-20, 20)}


@pytest.mark.parametrize("bins,leaf", [(64, 20), (4096, 10_000)])
def test_quantiles_equal_numpy(spark, bins, leaf):
    data = groups()
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("none", None), ("even", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "key string, v double").repartition(5)
    got = {r["key"]: r for r in exact_quantiles(df, ["key"], "v", AT, bins, leaf).collect()}
    assert got.keys() == data.keys()
    for k, vs in data.items():
        assert got[k].n == len(vs)
        np.testing.assert_allclose([got[k][f"q{i}"] for i in range(len(AT))], np.quantile(vs, AT), rtol=1e-9, atol=1e-9)
