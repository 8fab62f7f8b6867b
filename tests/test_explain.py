"""TreeSHAP: additivity on a Spark GBT and brute-force Shapley on a tiny tree."""

import itertools
import math

import numpy as np
import pytest

from recursive_tree_shap import tree_shap
from riskspark.operators.explain import base_value, explain_rows, extract_trees, margin
from riskspark.plans.learn import GBTParams, fit_gbt


def _cond_exp(tree, x, S, node=0):
    if tree["left"][node] < 0:
        return tree["value"][node]
    f = tree["feature"][node]
    lft, rgt = tree["left"][node], tree["right"][node]
    if f in S:
        return _cond_exp(tree, x, S, lft if x[f] <= tree["threshold"][node] else rgt)
    c = tree["cover"]
    return (c[lft] * _cond_exp(tree, x, S, lft) + c[rgt] * _cond_exp(tree, x, S, rgt)) / c[node]


def test_tree_shap_equals_brute_force_shapley():
    tree = {  # depth-2 tree over features 0, 1, 2 (feature 0 used twice)
        "feature": np.array([0, 1, -1, -1, 0, -1, 2, -1, -1]),
        "threshold": np.array([.5, .3, 0, 0, .8, 0, .1, 0, 0]),
        "left": np.array([1, 2, -1, -1, 5, -1, 7, -1, -1]),
        "right": np.array([4, 3, -1, -1, 6, -1, 8, -1, -1]),
        "value": np.array([0, 0, 1.0, 3.0, 0, -2.0, 0, 5.0, 0.5]),
        "cover": np.array([100., 40., 10., 30., 60., 20., 40., 15., 25.]),
    }
    M = 3
    for x in (np.array([.2, .7, .0]), np.array([.9, .1, .5]), np.array([.6, .3, .05])):
        phi = np.zeros(M)
        tree_shap(x, tree, phi, 1.0)
        exact = np.zeros(M)
        for i in range(M):
            others = [j for j in range(M) if j != i]
            for r in range(M):
                for S in itertools.combinations(others, r):
                    w = math.factorial(len(S)) * math.factorial(M - len(S) - 1) / math.factorial(M)
                    exact[i] += w * (_cond_exp(tree, x, set(S) | {i}) - _cond_exp(tree, x, set(S)))
        assert np.allclose(phi, exact)


def test_additivity_on_spark_gbt(spark):
    rng = np.random.default_rng(5)
    X = rng.random((300, 3))
    y = ((X[:, 0] + 0.5 * X[:, 1] + 0.2 * rng.random(300)) > 0.8).astype(int)
    df = spark.createDataFrame([(i, *map(float, X[i]), int(y[i])) for i in range(300)],
                               "account_id long, a double, b double, c double, y int")
    model = fit_gbt(df, ["a", "b", "c"], "y", GBTParams(max_iter=5, max_depth=3), 1.0)
    trees = extract_trees(model)
    base = base_value(trees)
    long = explain_rows(df.limit(20), model, ["a", "b", "c"]).toPandas()
    for key, g in long.groupby("account_id"):
        x = g.set_index("feature").loc[["a", "b", "c"], "feature_value"].to_numpy()
        assert g["shap_value"].sum() + base == pytest.approx(margin(trees, x), abs=1e-9)


def test_vectorised_equals_recursive():
    from riskspark.operators.explain import compile_trees, shap_matrix
    rng = np.random.default_rng(11)
    tree = {  # feature 0 split twice on one path, as in boosted trees
        "feature": np.array([0, 1, -1, 0, -1, -1, 2, -1, -1]),
        "threshold": np.array([.5, .3, 0, .2, 0, 0, .1, 0, 0]),
        "left": np.array([1, 2, -1, 4, -1, -1, 7, -1, -1]),
        "right": np.array([6, 3, -1, 5, -1, -1, 8, -1, -1]),
        "value": np.array([0, 0, 1.0, 0, 3.0, -1.5, 0, 5.0, 0.5]),
        "cover": np.array([100., 40., 10., 30., 12., 18., 60., 15., 45.]),
    }
    trees = [(1.0, tree), (0.05, tree)]
    X = rng.random((50, 3))
    fast = shap_matrix(X, compile_trees(trees))
    for r in range(len(X)):
        phi = np.zeros(3)
        for w, t in trees:
            tree_shap(X[r], t, phi, 2.0 * w)
        assert np.allclose(fast[r], phi)


def _random_tree(rng, depth, n_features):
    """A tree with one long path: each node splits off a leaf, on features in turn."""
    out = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

    def grow(level, cover):
        node = len(out["feature"])
        leaf = level == depth
        row = (-1 if leaf else int(rng.integers(n_features)) if level % 5 == 4 else level % n_features,
               0.0 if leaf else rng.random(), -1, -1, rng.normal() if leaf else 0.0, cover)
        for k, v in zip(("feature", "threshold", "left", "right", "value", "cover"), row):
            out[k].append(v)
        if not leaf:
            share = rng.uniform(.2, .8)
            short, side = depth if level + 1 < depth else level + 1, rng.random() < .5
            out["left"][node] = grow(short if side else level + 1, cover * share)
            out["right"][node] = grow(level + 1 if side else short, cover * (1 - share))
        return node

    grow(0, 1000.0)
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("depth", [4, 8, 12, 16, 20])
def test_long_paths_equal_recursion(depth):
    from riskspark.operators.explain import compile_trees, shap_matrix
    rng = np.random.default_rng(depth)
    trees = [(0.3, _random_tree(rng, depth, 25)), (1.0, _random_tree(rng, depth, 6))]
    X = rng.random((40, 25))
    compiled = compile_trees(trees)
    assert max(len(c[0]) for c in compiled) > 0.6 * depth
    fast = shap_matrix(X, compiled)
    for r in range(len(X)):
        phi = np.zeros(25)
        for w, t in trees:
            tree_shap(X[r], t, phi, 2.0 * w)
        assert np.allclose(fast[r], phi, rtol=1e-8, atol=1e-9)
    assert np.allclose(fast.sum(axis=1) + base_value(trees), [margin(trees, x) for x in X])


def test_top_of_a_batch_equals_top_of_all(spark):
    from riskspark.operators.explain import top_attributions
    rng = np.random.default_rng(6)
    X = rng.random((300, 4))
    y = ((X[:, 0] + 0.5 * X[:, 1]) > 0.8).astype(int)
    df = spark.createDataFrame([(i, *map(float, X[i]), int(y[i])) for i in range(300)],
                               "account_id long, d double, b double, c double, a double, y int")
    model = fit_gbt(df, ["d", "b", "c", "a"], "y", GBTParams(max_iter=3, max_depth=2), 1.0)
    few = df.limit(40)  # two of the features are hardly used, so zeros tie
    whole = top_attributions(explain_rows(few, model, ["d", "b", "c", "a"]), 3)
    cut = explain_rows(few, model, ["d", "b", "c", "a"], n=3)
    assert cut.count() == 3 * 40
    assert sorted(map(str, top_attributions(cut, 3).collect())) == sorted(map(str, whole.collect()))
