"""Per-account attributions of a Spark GBT score.

The fitted ensemble (trees x nodes, bounded by the model, not the data) is
flattened once on the driver. Path-dependent TreeSHAP (Lundberg et al., 2018)
is a sum over leaves of a term that depends only on which of the leaf's path
features a row satisfies: the integral of a path polynomial, exact with a few
nodes. Short paths look it up, longer ones compute it; every Arrow batch in
``mapInPandas`` is explained with vectorised numpy — no per-row Python. The
output is long ``(key, feature, shap_value, feature_value)``, ranked and
aggregated afterwards with Spark operators.

Spark's GBT margin is F = sum_t w_t tree_t(x) and P(y=1) = 1 / (1 + exp(-2F)),
so attributions are given on the 2F scale: ``sum(shap) + base = 2F``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.text import feature_label
from riskspark.operators.boosting import BoostedTrees


def _flatten(java_node, out: dict) -> int:
    """Append a node (pre-order) to the flat arrays; return its index."""
    idx = len(out["feature"])
    for k in out:
        out[k].append(0)
    out["cover"][idx] = float(java_node.impurityStats().count())
    if java_node.getClass().getSimpleName() == "InternalNode":
        split = java_node.split()
        out["feature"][idx] = int(split.featureIndex())
        out["threshold"][idx] = float(split.threshold())
        out["value"][idx] = 0.0
        out["left"][idx] = _flatten(java_node.leftChild(), out)
        out["right"][idx] = _flatten(java_node.rightChild(), out)
    else:
        out["feature"][idx] = -1
        out["threshold"][idx] = 0.0
        out["value"][idx] = float(java_node.prediction())
        out["left"][idx] = -1
        out["right"][idx] = -1
    return idx


def extract_trees(pipeline_model) -> list:
    """Boosted trees, or the GBT stage of a fitted pipeline -> list of (weight, dict of numpy arrays)."""
    if isinstance(pipeline_model, BoostedTrees):
        return pipeline_model.flat_trees()
    gbt = pipeline_model.stages[-1]
    trees = []
    for w, t in zip(gbt.treeWeights, gbt.trees):
        out = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}
        _flatten(t._java_obj.rootNode(), out)
        trees.append((float(w), {k: np.asarray(v) for k, v in out.items()}))
    return trees


def _expected(tree: dict, node: int = 0) -> float:
    if tree["left"][node] < 0:
        return tree["value"][node]
    lft, rgt = tree["left"][node], tree["right"][node]
    c = tree["cover"]
    return (c[lft] * _expected(tree, lft) + c[rgt] * _expected(tree, rgt)) / c[node]


def _leaf_paths(tree: dict) -> list:
    """Per leaf: (value, [(feature, zero_fraction, [(threshold, goes_left), ...]), ...]) with
    path conditions and cover ratios merged per unique feature."""
    out = []

    def walk(node, conds):
        if tree["left"][node] < 0:
            feats = {}
            for f, z, thr, left in conds:
                zf, cs = feats.get(f, (1.0, []))
                feats[f] = (zf * z, cs + [(thr, left)])
            out.append((tree["value"][node], [(f, zf, cs) for f, (zf, cs) in feats.items()]))
            return
        f, thr, c = tree["feature"][node], tree["threshold"][node], tree["cover"]
        for child, left in ((tree["left"][node], True), (tree["right"][node], False)):
            walk(child, conds + [(f, c[child] / c[node], thr, left)])

    walk(0, [])
    return out


#: Satisfaction patterns of a leaf that are tabulated before the rows come; longer paths are weighed row by row.
MAX_PATTERNS = 256


def _leaf_weights(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Shapley weights (patterns x features) of one leaf; ``ones``: which path features each pattern satisfies.

    phi_j = (o_j - z_j) sum_{S in U\\{j}} |S|! (m-|S|-1)! / m! prod_{i in S} o_i prod_{i not in S, i != j} z_i

    As k! (m-1-k)! / m! is the integral of t^k (1-t)^(m-1-k) over [0, 1], the sum is the integral of the path
    polynomial prod_{i != j} (o_i t + z_i (1-t)), of degree m - 1: Gauss-Legendre with (m + 1) // 2 nodes is exact.
    """
    m = len(zeros)
    if m == 0:
        return np.zeros((len(ones), 0))
    nodes, weights = np.polynomial.legendre.leggauss((m + 1) // 2)
    t = ((nodes + 1) / 2)[:, None, None]
    factors = zeros * (1 - t) + ones * t
    before, after = np.ones_like(factors), np.ones_like(factors)
    np.cumprod(factors[..., :-1], axis=-1, out=before[..., 1:])
    np.cumprod(factors[..., :0:-1], axis=-1, out=after[..., -2::-1])
    return (ones - zeros) * np.tensordot(weights / 2, before * after, 1)


def compile_trees(trees: list) -> list:
    """Per tree and leaf: path features, their conditions and cover ratios, the leaf's value on the 2F scale
    and, for short paths, the weights of all patterns (driver, model-sized)."""
    compiled = []
    for w, t in trees:
        for value, feats in _leaf_paths(t):
            zeros = np.array([z for _, z, _ in feats], dtype=float)
            table = None
            if 1 << len(feats) <= MAX_PATTERNS:
                patterns = np.arange(1 << len(feats))[:, None] >> np.arange(len(feats)) & 1
                table = _leaf_weights(zeros, patterns) * (2.0 * w * value)
            compiled.append(([f for f, _, _ in feats], [cs for _, _, cs in feats], zeros, 2.0 * w * value, table))
    return compiled


def shap_matrix(X: np.ndarray, compiled: list) -> np.ndarray:
    """Vectorised path-dependent TreeSHAP on the 2F scale: rows x features. Time and memory grow with
    a path's length, not with its patterns, so trees may be of any depth."""
    phi = np.zeros(X.shape)
    for fidx, conds, zeros, value, table in compiled:
        ok = np.ones((len(X), len(fidx)), dtype=bool)
        for j, (f, cs) in enumerate(zip(fidx, conds)):
            for thr, left in cs:
                ok[:, j] &= (X[:, f] <= thr) if left else (X[:, f] > thr)
        if table is not None:
            phi[:, fidx] += table[ok @ (1 << np.arange(len(fidx)))]
        else:
            phi[:, fidx] += value * _leaf_weights(zeros, ok)
    return phi


def base_value(trees: list) -> float:
    """Expected margin (2F scale) under the trees' own cover."""
    return 2.0 * sum(w * _expected(t) for w, t in trees)


def margin(trees: list, x: np.ndarray) -> float:
    total = 0.0
    for w, t in trees:
        n = 0
        while t["left"][n] >= 0:
            n = t["left"][n] if x[t["feature"][n]] <= t["threshold"][n] else t["right"][n]
        total += w * t["value"][n]
    return 2.0 * total


def explain_rows(df: DataFrame, pipeline_model, features: list[str], key: str = "account_id",
                 n: int | None = None) -> DataFrame:
    """Long ``(key, feature, shap_value, feature_value)`` for every row and feature, or for the ``n``
    features of each row that ``top_attributions`` ranks first (the others don't leave the batch)."""
    compiled = compile_trees(extract_trees(pipeline_model))  # model-sized, shipped with the task
    key_type = df.schema[key].dataType.simpleString()
    by_name = sorted(range(len(features)), key=lambda j: features[j])
    width = len(features) if n is None else min(n, len(features))

    def run(batches):
        names = np.asarray(features, dtype=object)
        for pdf in batches:
            X = pdf[features].to_numpy(dtype=float)
            phis = shap_matrix(X, compiled)
            take = np.broadcast_to(by_name, X.shape)
            if width < len(features):
                order = np.argsort(-np.abs(phis[:, by_name]), axis=1, kind="stable")[:, :width]
                take = np.take(by_name, order)
            yield pd.DataFrame({
                key: np.repeat(pdf[key].to_numpy(), width),
                "feature": names[take].reshape(-1),
                "shap_value": np.take_along_axis(phis, take, axis=1).reshape(-1),
                "feature_value": np.take_along_axis(X, take, axis=1).reshape(-1),
            })

    schema = f"{key} {key_type}, feature string, shap_value double, feature_value double"
    return df.select(key, *features).mapInPandas(run, schema)


def direction(v) -> F.Column:
    """sign of an attribution."""
    return F.when(v >= 0, F.lit("increases_risk")).otherwise(F.lit("reduces_risk"))


def top_attributions(long: DataFrame, n: int = 10, key: str = "account_id") -> DataFrame:
    """K5: the n largest |shap| per account (ties by feature), with labels and direction.

    The window is per account: at most one row per feature, so bounded by the schema.
    """
    w = Window.partitionBy(key).orderBy(F.abs("shap_value").desc(), F.col("feature"))
    ranked = long.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)
    return ranked.select(key, "rank", feature_label(F.col("feature")).alias("label"),
                         F.col("feature").alias("raw_feature"), "shap_value",
                         direction(F.col("shap_value")).alias("direction"), "feature_value")


def shap_struct_array(top: DataFrame, key: str = "account_id") -> DataFrame:
    """Nested ``shap_values ARRAY<STRUCT<feature,raw_feature,shap_value,direction,feature_value>>``."""
    s = F.struct(F.col("rank"), F.col("label").alias("feature"), "raw_feature", "shap_value",
                 "direction", "feature_value")
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(s)), lambda e: e.dropFields("rank"))
                                .alias("shap_values"))


def global_importance(long: DataFrame, n: int = 20) -> DataFrame:
    """X2 + K6: mean |shap| per feature (top n) and the sign of the mean."""
    agg = long.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"),
                                      F.avg("shap_value").alias("mean_shap"))
    return agg.orderBy(F.col("mean_abs_shap").desc(), F.col("feature")).limit(n).select(
        feature_label(F.col("feature")).alias("label"), F.col("feature").alias("raw_feature"),
        "mean_abs_shap", direction(F.col("mean_shap")).alias("direction"))
