"""Joint histogram boosting against a plain recursive booster on sorted rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import boosting
from riskspark.operators.boosting import (BoostedTrees, BoostParams, Fit, _draw, boost, quantile_cuts, sampled_columns,
                                          sigmoid)

SCHEMA = "a double, b double, c double, d double, y int, fits long, hash long"


def table(n, seed):
    """Skewed classes, a column of few values, a constant one."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.random(n) ** 3, np.full(n, 2.0)])
    y = ((x[:, 0] + .5 * x[:, 1] * x[:, 2] + .3 * rng.normal(size=n)) > 1.0).astype(int)
    return x, y, rng.integers(-2 ** 62, 2 ** 62, n)


def plain(x, y, hashes, number, fit, p, cuts):
    """The reference: recursion over nodes, candidate thresholds tried one by one, sums over row lists."""
    margin, trees = np.zeros(len(y)), []
    for t in range(p.trees):
        used = _draw(hashes, number, t, p.seed) < p.rows
        prob = sigmoid(margin)
        w = np.where(y > 0, fit.weight, 1.0)
        g, h = w * (prob - y), w * prob * (1 - prob)
        columns = sampled_columns(fit, number, t, p)

        def grow(rows, level, everyone):
            G, H = g[rows].sum(), h[rows].sum()
            leaf = -p.rate * G / (H + p.l2)
            best = None
            for f in columns if level < p.depth else []:
                for cut in cuts[f]:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if not len(left) or not len(right) or min(h[left].sum(), h[right].sum()) < p.min_child:
                        continue
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + p.l2) for s in (left, right)) - G ** 2 / (H + p.l2)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, f, cut, left, right)
            if best is None:
                margin[everyone] += leaf
                return leaf
            _, f, cut, left, right = best
            go = x[everyone, f] <= cut
            return (f, cut, grow(left, level + 1, everyone[go]), grow(right, level + 1, everyone[~go]))
        trees.append(grow(np.flatnonzero(used), 0, np.arange(len(y))))
    return margin, trees


def nested(model, t, node=0):
    f = model.feature[t, node]
    if f < 0:
        return model.value[t, node]
    return (f, model.threshold[t, node], nested(model, t, 2 * node + 1), nested(model, t, 2 * node + 2))


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if isinstance(a, tuple):
        return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return a == pytest.approx(b, abs=1e-9)


def frame(spark, x, y, hashes, fits):
    rows = [(*map(float, x[i]), int(y[i]), int(fits[i]), int(hashes[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("rows_per_task", [10 ** 6, 0])
def test_trees_equal_the_reference(spark, monkeypatch, rows_per_task):
    """Both ways of growing, three fits with their own rows, columns and weights, margins written twice."""
    monkeypatch.setattr(boosting, "REFRESH", 3)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 128)
    x, y, hashes = table(1000, 3)
    members = np.random.default_rng(1).integers(1, 8, 1000)
    p = BoostParams(trees=8, depth=4, rate=.3, bins=16)
    fits = [Fit([0, 1, 2, 3], 1.0), Fit([0, 1, 2], 7.5), Fit([2, 1], 2.0)]
    df = frame(spark, x, y, hashes, members)
    models = boost(df, ["a", "b", "c", "d"], fits, p, rows_per_task)
    cuts = quantile_cuts(df, ["a", "b", "c", "d"], 16)
    assert [len(c) for c in cuts] == [15, 4, 15, 0] or len(cuts[0]) <= 16
    for k, (fit, model) in enumerate(zip(fits, models)):
        rows = np.flatnonzero((members >> k) & 1)
        order = rows[np.lexsort((y[rows], hashes[rows]))]
        margin, trees = plain(x[order], y[order], hashes[order], k, fit, p, cuts)
        for t, tree in enumerate(trees):
            mine = nested(model, t)
            rename = lambda n: (fit.features[n[0]], n[1], rename(n[2]), rename(n[3])) if isinstance(n, tuple) else n
            assert same(rename(mine), tree), (k, t)
        assert model.margin(x[order][:, fit.features]) == pytest.approx(margin, abs=1e-9)


def test_level_growth_equals_one_task_for_many_trees(spark):
    x, y, hashes = table(600, 8)
    df = frame(spark, x, y, hashes, np.ones(600, int))
    p = BoostParams(trees=25)
    one, many = (boost(df, ["a", "b", "c", "d"], [Fit([0, 1, 2, 3], 4.0)], p, n)[0] for n in (10 ** 6, 0))
    assert one.margin(x) == pytest.approx(many.margin(x), abs=1e-8)
    assert ((one.margin(x) > 0) == y).mean() > 0.9


def test_odd_fits(spark):
    x, y, hashes = table(200, 4)
    p = BoostParams(trees=3, depth=2)
    fits = [Fit([0, 1, 2, 3]), Fit([3]), Fit([0])]
    members = np.where(np.arange(200) % 2 == 0, 1 | 2, 2)  # nobody learns the third
    for rows_per_task in (10 ** 6, 0):
        some, constant, nobody = boost(frame(spark, x, y, hashes, members), ["a", "b", "c", "d"], fits, p, rows_per_task)
        assert (constant.feature == -1).all() and len(set(constant.margin(x[:, [3]]))) == 1
        assert (nobody.margin(x[:, [0]]) == 0).all()
        ones = boost(frame(spark, x, np.ones(200), hashes, np.ones(200, int)), ["a", "b", "c", "d"], fits[:1], p, rows_per_task)
        assert (ones[0].margin(x) > 0).all()
        nothing = boost(spark.createDataFrame([], SCHEMA), ["a", "b", "c", "d"], fits[:1], p, rows_per_task)
        assert (nothing[0].margin(x) == 0).all()
    with pytest.raises(ValueError):
        boost(spark.createDataFrame([], SCHEMA), ["a"], [Fit([0])] * 63, p)


def test_null_where_unused_and_column_score(spark):
    x, y, hashes = table(300, 5)
    members = np.where(np.arange(300) < 200, 1, 2)
    df = frame(spark, x, y, hashes, members).withColumn("c", F.when(F.col("fits") == 1, F.col("c")))
    model = boost(df, ["a", "b", "c", "d"], [Fit([0, 1, 2]), Fit([0, 1])], BoostParams(trees=5))[0]
    got = df.where("fits = 1").select("a", "b", "c", model.probability("a", "b", "c").alias("p")).collect()
    want = sigmoid(model.margin(np.array([(r["a"], r["b"], r["c"]) for r in got])))
    assert [r["p"] for r in got] == pytest.approx(want)
    again = BoostedTrees.from_json(model.to_json())
    assert (again.margin(x[:, :3]) == model.margin(x[:, :3])).all()
    assert sum(model.importance().values()) == pytest.approx(1.0) and set(model.importance()) == {"a", "b", "c"}


def test_many_small_pieces_are_dealt_over_the_cores(spark, monkeypatch):
    """A pass has a task per core, not one per piece of the input; a block holds rows of one fit."""
    x, y, hashes = table(400, 6)
    seen, grow = [], boosting._grow_levels
    monkeypatch.setattr(boosting, "_grow_levels", lambda blocks, *rest: seen.append(blocks) or grow(blocks, *rest))
    df = frame(spark, x, y, hashes, 1 + np.arange(400) % 3).repartition(40)
    boost(df, ["a", "b", "c", "d"], [Fit([0, 1]), Fit([1, 2])], BoostParams(trees=2), 0)
    assert seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert {r["fit"]: r["n"] for r in seen[0].groupBy("fit").agg(F.sum("n").alias("n")).collect()} == {0: 267, 1: 266}
    merged = seen[0].rdd.mapPartitions(boosting._merged).map(lambda b: b[:2]).collect()
    assert sum(n for _, n in merged) == 533


def test_fits_that_a_task_can_hold_need_no_job_per_level(spark, monkeypatch):
    """Fits of over 100,000 rows grow in a task each as long as their bins fit; both ways give the same trees."""
    df = spark.range(120_000).select((F.col("id") % 97).cast("double").alias("a"),
                                     (F.col("id") % 31).cast("double").alias("b"),
                                     ((F.col("id") % 97) > 60).cast("int").alias("y"),
                                     (F.lit(1) + F.col("id") % 2 * 2).alias("fits"), F.xxhash64("id").alias("hash"))
    fits, p, levels = [Fit([0, 1], 2.0), Fit([1])], BoostParams(trees=3, depth=2), []
    grow = boosting._grow_levels
    monkeypatch.setattr(boosting, "_grow_levels", lambda *a: levels.append(1) or grow(*a))
    alone = boost(df, ["a", "b"], fits, p)
    assert not levels
    monkeypatch.setattr(boosting, "BYTES_PER_TASK", 100_000)  # 50,000 rows of two features
    level = boost(df, ["a", "b"], fits, p)
    assert levels
    for one, other in zip(alone, level):
        assert (one.feature == other.feature).all() and (one.threshold == other.threshold).all()
        assert one.value == pytest.approx(other.value, abs=1e-9)
        assert (one.cover == other.cover).all()


def grown(codes, y, hashes, p):
    return boosting._grow_fit(codes.copy(), y, hashes, 0, Fit(list(range(len(codes))), 3.0), p)


def test_chunks_and_joint_columns_give_the_same_trees(monkeypatch):
    """A task's rows in chunks, and columns of few bins counted together, as over all rows column by column."""
    rng = np.random.default_rng(9)
    codes = np.stack([rng.integers(0, n, 5_000) for n in (256, 2, 7, 1, 40, 3)]).astype(np.uint8)
    y = (codes[0] / 256 + codes[2] / 7 + codes[1] * codes[5] / 4 + rng.normal(size=5_000) > 1.5).astype(np.uint8)
    hashes, p = rng.integers(-2 ** 62, 2 ** 62, 5_000), BoostParams(trees=8)
    want = grown(codes, y, hashes, p)
    monkeypatch.setattr(boosting, "JOINT_ROWS", 1)
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 700)
    assert [len(members) for members, _ in boosting._joint_columns(codes, list(range(6)), p.bins)] == [5, 1]
    order = rng.permutation(5_000)
    for one, other in zip(want, grown(codes[:, order], y[order], hashes[order], p), strict=True):
        assert (one.feature == other.feature).all() and (one.cut == other.cut).all() and (one.feature >= 0).sum() > 4
        assert other.value == pytest.approx(one.value, abs=1e-9) and (one.cover == other.cover).all()


def test_a_fit_needs_few_bytes_per_row():
    """So that a task holds the rows of a fit that would take a Spark job per level otherwise."""
    import tracemalloc
    n, rng = 600_000, np.random.default_rng(10)
    data = [rng.integers(0, 256, (13, n)).astype(np.uint8), rng.integers(0, 2, n).astype(np.uint8),
            rng.integers(-2 ** 62, 2 ** 62, n)]
    tracemalloc.start()
    boosting._grow_fit(data.pop(0), data.pop(0), data.pop(0), 0, Fit(list(range(13))), BoostParams(trees=1, depth=3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * n, peak / n


def test_fits_of_millions_of_rows_need_no_job_per_level():
    from riskspark.operators.boosting import BYTES_PER_TASK, ROWS_PER_TASK
    assert min(ROWS_PER_TASK, BYTES_PER_TASK // 13) >= 8_300_000
