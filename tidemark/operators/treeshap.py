"""Tree SHAP for the fitted random forest.

Path-dependent Tree SHAP (Lundberg, Erion and Lee, 2018, Algorithm 2):
exact Shapley values of a tree ensemble whose value function conditions
on the features in a coalition by following the split and weighting the
other branch by its training cover. Contributions of a row plus the
cover-weighted mean prediction equal the forest's prediction (on the
log1p scale the models are fitted on).

Distribution: the forest is written with ``model.write()`` to the shared
checkpoint folder and its node table read back with Spark (its size is
bounded by the model: trees x nodes, not by the data); the node arrays are
broadcast and ``mapInPandas`` scores every partition of feature rows. The
recursion is vectorised over all rows of a batch: each tree is walked once
per batch, with a row-wise "one fraction" per path element.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir


def forest_arrays(spark: SparkSession, model) -> list[dict]:
    """Node arrays per tree from a saved tree-ensemble regression model."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/forest-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", F.try_element_at("nodeData.impurityStats", F.lit(1)).alias("cover"),
        "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")).toPandas()
    trees = []
    for _, t in nodes.groupby("treeID"):
        t = t.sort_values("id")
        n = int(t["id"].max()) + 1
        arr = {k: np.zeros(n) for k in ("value", "cover", "threshold")}
        arr.update({k: np.full(n, -1, dtype=np.int64) for k in ("left", "right", "feature")})
        ids = t["id"].to_numpy()
        arr["value"][ids] = t["prediction"].to_numpy()
        arr["cover"][ids] = t["cover"].to_numpy()
        arr["left"][ids] = t["leftChild"].to_numpy()
        arr["right"][ids] = t["rightChild"].to_numpy()
        arr["feature"][ids] = t["featureIndex"].fillna(-1).to_numpy().astype(np.int64)
        arr["threshold"][ids] = t["threshold"].fillna(0.0).to_numpy()
        trees.append(arr)
    return trees


def expected_value(trees: list[dict]) -> float:
    """Cover-weighted mean leaf value, averaged over the trees."""
    out = 0.0
    for t in trees:
        leaf = t["left"] < 0
        # root id is 0; leaves partition the root's cover
        out += float((t["value"][leaf] * t["cover"][leaf]).sum() / t["cover"][0])
    return out / len(trees)


def _extend(path, pz, po, pi):
    """path: dict with d (list), z (list), o (list of arrays), w (list of arrays)."""
    d, z, o, w = list(path["d"]), list(path["z"]), list(path["o"]), [x.copy() for x in path["w"]]
    ln = len(d)
    d.append(pi)
    z.append(pz)
    o.append(po)
    w.append(np.ones_like(po) if ln == 0 else np.zeros_like(po))
    for i in range(ln - 1, -1, -1):
        w[i + 1] = w[i + 1] + po * w[i] * (i + 1) / (ln + 1)
        w[i] = pz * w[i] * (ln - i) / (ln + 1)
    return {"d": d, "z": z, "o": o, "w": w}


def _unwound_sum(path, i):
    """Sum of the path weights with element i removed (row-wise)."""
    ln = len(path["d"]) - 1
    w = path["w"]
    oi, zi = path["o"][i], path["z"][i]
    total = np.zeros_like(w[0])
    nxt = w[ln].copy()
    nz = oi != 0
    safe_o = np.where(nz, oi, 1.0)
    for j in range(ln - 1, -1, -1):
        a = nxt * (ln + 1) / ((j + 1) * safe_o)
        b = (w[j] * (ln + 1) / (zi * (ln - j))) if zi != 0 else np.zeros_like(w[j])
        tmp = np.where(nz, a, b)
        total = total + tmp
        nxt = np.where(nz, w[j] - tmp * zi * (ln - j) / (ln + 1), nxt)
    return total


def _unwind(path, i):
    ln = len(path["d"]) - 1
    w = [x.copy() for x in path["w"]]
    oi, zi = path["o"][i], path["z"][i]
    nz = oi != 0
    safe_o = np.where(nz, oi, 1.0)
    nxt = w[ln].copy()
    for j in range(ln - 1, -1, -1):
        a = nxt * (ln + 1) / ((j + 1) * safe_o)
        b = (w[j] * (ln + 1) / (zi * (ln - j))) if zi != 0 else np.zeros_like(w[j])
        new_w = np.where(nz, a, b)
        nxt = np.where(nz, w[j] - new_w * zi * (ln - j) / (ln + 1), nxt)
        w[j] = new_w
    keep = [k for k in range(ln + 1) if k != i]
    return {"d": [path["d"][k] for k in keep], "z": [path["z"][k] for k in keep],
            "o": [path["o"][k] for k in keep], "w": w[:ln]}


def tree_shap(tree: dict, X: np.ndarray) -> np.ndarray:
    """phi (n_rows x n_features) of one tree for every row of X."""
    n, m = X.shape
    phi = np.zeros((n, m))
    ones = np.ones(n)

    def recurse(j, path, pz, po, pi):
        path = _extend(path, pz, po, pi)
        left, right = tree["left"][j], tree["right"][j]
        if left < 0:
            v = tree["value"][j]
            for i in range(1, len(path["d"])):
                s = _unwound_sum(path, i)
                phi[:, path["d"][i]] += s * (path["o"][i] - path["z"][i]) * v
            return
        f = int(tree["feature"][j])
        goes_left = (X[:, f] <= tree["threshold"][j]).astype(float)
        iz, io = 1.0, ones
        if f in path["d"][1:]:
            k = path["d"].index(f, 1)
            iz, io = path["z"][k], path["o"][k]
            path = _unwind(path, k)
        cj = tree["cover"][j]
        recurse(left, path, iz * tree["cover"][left] / cj, io * goes_left, f)
        recurse(right, path, iz * tree["cover"][right] / cj, io * (1.0 - goes_left), f)

    recurse(0, {"d": [], "z": [], "o": [], "w": []}, 1.0, ones, -1)
    return phi


def forest_shap(trees: list[dict], X: np.ndarray) -> np.ndarray:
    out = np.zeros(X.shape)
    for t in trees:
        out += tree_shap(t, X)
    return out / len(trees)


def shap_scores(fe: DataFrame, rf_model, features) -> DataFrame:
    """Long rows (series_key, period, period_label, feature, feature_pos,
    value, contribution) of Tree SHAP contributions for every feature row."""
    spark = fe.sparkSession
    trees = spark.sparkContext.broadcast(forest_arrays(spark, rf_model))
    feats = list(features)

    def run(batches):
        tr = trees.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            X = pdf[feats].to_numpy(dtype=float)
            phi = forest_shap(tr, X)
            n = len(pdf)
            yield pd.DataFrame({
                "series_key": np.repeat(pdf["series_key"].to_numpy(), len(feats)),
                "period": np.repeat(pdf["period"].to_numpy(), len(feats)),
                "period_label": np.repeat(pdf["period_label"].to_numpy(), len(feats)),
                "feature": np.tile(np.array(feats, dtype=object), n),
                "feature_pos": np.tile(np.arange(1, len(feats) + 1, dtype=np.int32), n),
                "value": X.reshape(-1),
                "contribution": phi.reshape(-1)})

    schema = ("series_key string, period date, period_label string, feature string, "
              "feature_pos int, value double, contribution double")
    cols = ["series_key", "period", "period_label"] + [F.col(f).cast("double").alias(f) for f in feats]
    return fe.select(*cols).mapInPandas(run, schema)
