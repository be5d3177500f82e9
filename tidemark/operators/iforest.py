"""Isolation forest flag (AN2, AN3), per series.

Liu, Ting and Zhou (2008): trees grown on random sub-samples by random
splits; the anomaly score of a point is 2^(-E[h(x)] / c(psi)). As in the
source pipeline, the six inputs are standardised per series (population
std), 100 trees are grown on min(256, n) points, and the flagged share is
``contamination``: a point is an outlier when its score is above the
(1 - contamination) quantile of the series' scores.

Distribution: ``groupBy("series_key").applyInPandas``; a group is the
monthly feature rows of one series (bounded by the calendar span). The
random generator is seeded from the seed and the series key, so results
do not depend on partitioning or task retries.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.config import ISO_FEATURES, PipelineConfig

CFG = PipelineConfig()
ISO_SCHEMA = "series_key string, period date, iso_score double, iso_flag boolean"


def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(X: np.ndarray, idx: np.ndarray, depth: int, limit: int, rng, nodes: list) -> int:
    """Append nodes [feature, threshold, left, right, size] and return the node id."""
    me = len(nodes)
    nodes.append([-1, 0.0, -1, -1, len(idx)])
    if depth >= limit or len(idx) <= 1:
        return me
    sub = X[idx]
    lo, hi = sub.min(axis=0), sub.max(axis=0)
    cand = np.flatnonzero(hi > lo)
    if len(cand) == 0:
        return me
    f = int(rng.choice(cand))
    t = float(rng.uniform(lo[f], hi[f]))
    left = idx[sub[:, f] < t]
    right = idx[sub[:, f] >= t]
    nodes[me][0], nodes[me][1] = f, t
    nodes[me][2] = _grow(X, left, depth + 1, limit, rng, nodes)
    nodes[me][3] = _grow(X, right, depth + 1, limit, rng, nodes)
    return me


def _path_lengths(X: np.ndarray, nodes: list) -> np.ndarray:
    out = np.zeros(len(X))
    for i, x in enumerate(X):
        node, depth = 0, 0
        while nodes[node][0] >= 0:
            f, t, l, r, _ = nodes[node]
            node = l if x[f] < t else r
            depth += 1
        out[i] = depth + _c(nodes[node][4])
    return out


def isolation_scores(X: np.ndarray, n_trees: int, sample: int, seed: int) -> np.ndarray:
    n = len(X)
    psi = min(sample, n)
    limit = int(np.ceil(np.log2(max(psi, 2))))
    rng = np.random.default_rng(seed)
    depth = np.zeros(n)
    for _ in range(n_trees):
        idx = rng.choice(n, size=psi, replace=False)
        nodes: list = []
        _grow(X, idx, 0, limit, rng, nodes)
        depth += _path_lengths(X, nodes)
    return 2.0 ** (-(depth / n_trees) / _c(psi))


def _per_series(cfg: PipelineConfig, features):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        X = pdf[list(features)].to_numpy(dtype=float)
        mu, sd = X.mean(axis=0), X.std(axis=0)
        X = (X - mu) / np.where(sd > 0, sd, 1.0)
        key = str(pdf["series_key"].iloc[0])
        seed = (cfg.seed * 1_000_003 + zlib.crc32(key.encode())) % (2 ** 32)
        s = isolation_scores(X, cfg.iso_trees, cfg.iso_sample, seed)
        cut = np.quantile(s, 1.0 - cfg.contamination)
        return pd.DataFrame({"series_key": pdf["series_key"].to_numpy(),
                             "period": pdf["period"].to_numpy(), "iso_score": s,
                             "iso_flag": s > cut})
    return run


def isolation_flags(fe: DataFrame, cfg: PipelineConfig = CFG, features=ISO_FEATURES) -> DataFrame:
    return (fe.select("series_key", "period", *features)
              .groupBy("series_key").applyInPandas(_per_series(cfg, features), ISO_SCHEMA))
