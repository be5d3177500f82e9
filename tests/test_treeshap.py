"""Tree SHAP equals brute-force Shapley values of the path-dependent value
function on small random trees, and is additive (SURVEY 5.3)."""

import itertools
import math

import numpy as np

from tidemark.operators.treeshap import expected_value, forest_shap, tree_shap


def _random_tree(rng, n_features, depth):
    nodes = {"value": [], "cover": [], "left": [], "right": [], "feature": [], "threshold": []}

    def add(d, cover):
        j = len(nodes["value"])
        for k in nodes:
            nodes[k].append(0)
        nodes["cover"][j] = cover
        if d == depth or rng.random() < 0.2:
            nodes["value"][j], nodes["left"][j], nodes["right"][j], nodes["feature"][j] = rng.normal(), -1, -1, -1
            return j
        nodes["feature"][j] = int(rng.integers(n_features))
        nodes["threshold"][j] = float(rng.normal())
        frac = rng.uniform(0.2, 0.8)
        nodes["left"][j] = add(d + 1, cover * frac)
        nodes["right"][j] = add(d + 1, cover * (1 - frac))
        return j

    add(0, 100.0)
    return {k: np.array(v, dtype=np.int64 if k in ("left", "right", "feature") else float)
            for k, v in nodes.items()}


def _value(tree, x, S, j=0):
    if tree["left"][j] < 0:
        return tree["value"][j]
    f = tree["feature"][j]
    l, r = tree["left"][j], tree["right"][j]
    if f in S:
        return _value(tree, x, S, l if x[f] <= tree["threshold"][j] else r)
    c = tree["cover"][j]
    return (tree["cover"][l] * _value(tree, x, S, l) + tree["cover"][r] * _value(tree, x, S, r)) / c


def _brute(tree, x, m):
    phi = np.zeros(m)
    for i in range(m):
        others = [k for k in range(m) if k != i]
        for size in range(m):
            for S in itertools.combinations(others, size):
                wgt = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
                phi[i] += wgt * (_value(tree, x, set(S) | {i}) - _value(tree, x, set(S)))
    return phi


def test_matches_brute_force_and_is_additive():
    rng = np.random.default_rng(7)
    m = 4
    for _ in range(5):
        tree = _random_tree(rng, m, 5)
        X = rng.normal(size=(20, m))
        phi = tree_shap(tree, X)
        for r in range(len(X)):
            assert np.allclose(phi[r], _brute(tree, X[r], m), atol=1e-9)
            assert abs(phi[r].sum() + _value(tree, X[r], set()) - _value(tree, X[r], set(range(m)))) < 1e-9


def test_forest_additivity():
    rng = np.random.default_rng(3)
    trees = [_random_tree(rng, 6, 6) for _ in range(4)]
    X = rng.normal(size=(30, 6))
    phi = forest_shap(trees, X)
    pred = np.array([np.mean([_value(t, x, set(range(6))) for t in trees]) for x in X])
    assert np.allclose(phi.sum(axis=1) + expected_value(trees), pred, atol=1e-9)
