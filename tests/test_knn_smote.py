"""Filter-and-refine kNN equals brute force in few and many dimensions (with a hot duplicate group);
its bounds hold; SMOTE counts, and its points lie between true neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators.knn import approximate, centres, distance_bounds, exact_knn, kth_bound
from riskspark.operators.smote import smote


def _points(spark, x):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "key long, vec array<double>")
    return df.groupBy("vec").agg(F.min("key").alias("pid"), F.count(F.lit(1)).alias("mult"))


def _brute_force(pts, k):
    p = {r["pid"]: (np.array(r["vec"]), r["mult"]) for r in pts.collect()}
    return {pid: sorted([0.0] * (m - 1) + [float(np.linalg.norm(v - w)) for q, (w, mm) in p.items() if q != pid
                                           for _ in range(mm)])[:k] for pid, (v, m) in p.items()}


def test_exact_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)).round(2)
    x[250:] = x[0]  # a third-ish of rows are one point
    pts = _points(spark, x)
    got = {r["pid"]: [s["dist"] for s in r["neighbours"]] for r in exact_knn(pts, 4, 3, leaf_size=16).collect()}
    want = _brute_force(pts, 4)
    assert got.keys() == want.keys()
    for pid, dist in want.items():
        assert np.allclose(dist, got[pid])


def test_queries_meet_few_blocks(spark):
    """Where few dimensions hold most of the spread, a query's bounds exclude most blocks before any product."""
    from riskspark.operators import knn
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2_000, 13)) * np.array([30.0, 0.1, 8.0, *[0.2] * 10])
    x[:500, 0] = x[0, 0]  # equal values in the widest dimension
    pts = _points(spark, x).withColumn("grp", F.lit(0).cast("long"))
    leaves, levels = knn.build_tree(pts, 13, 125)[0], 4
    sizes = [r["count"] for r in leaves.groupBy("cell").count().collect()]
    assert len(sizes) == 2 ** levels and max(sizes) <= 130
    pairs = knn._block_pairs(knn._blocks(leaves, 5, 13, 8), levels, 13)
    met = pairs.agg(F.sum(F.length("pids") / 8 * F.length("nids") / 8)).first()[0]
    assert met < 0.25 * len(x) ** 2, met / len(x) ** 2
    got = {r["pid"]: [s["dist"] for s in r["neighbours"]] for r in exact_knn(pts, 5, 13, leaf_size=125).collect()}
    dist = np.sqrt(((x[:50, None] - x[None]) ** 2).sum(axis=2))
    dist[np.arange(50), np.arange(50)] = np.inf
    for pid, want in enumerate(np.sort(dist, axis=1)[:, :5]):
        assert np.allclose(got[pid], want)


@pytest.mark.parametrize("d", [13, 200])
def test_many_dimensions_compare_few_pairs(spark, d):
    """Boxes exclude nothing there; the approximations leave a few exact distances per point."""
    rng = np.random.default_rng(d)
    x = rng.normal(size=(1500, d)) * rng.gamma(2.0, size=d)
    x[700:] += 40.0  # away from the origin
    pts = _points(spark, x)
    rows = exact_knn(pts, 5, d, leaf_size=256).collect()
    square = ((x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * x @ x.T)
    np.fill_diagonal(square, np.inf)
    want = np.sqrt(np.sort(square, axis=1)[:, :5])
    for r in rows:
        assert np.allclose([s["dist"] for s in r["neighbours"]], want[r["pid"]])
    share = sum(r["n_compared"] for r in rows) / (len(x) * (len(x) - 1))
    assert len(rows) == len(x) and share < 0.02, share


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(60, 7)), rng.integers(0, 3, (60, 4)).astype(float), np.full((5, 2), 1e9),
              rng.normal(size=(40, 5)) * 1e-9 + 1e6, rng.standard_cauchy((50, 6))):
        for bits in (1, 4, 8):
            codes, low, step, errors = approximate(x, bits)
            lower, upper = distance_bounds(x, centres(codes, low, step), errors)
            dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
            assert (lower <= dist).all() and (dist <= upper).all()


def test_kth_bound():
    upper = np.array([[3.0, 1.0, 2.0], [np.inf, np.inf, 5.0]])
    assert kth_bound(upper, np.array([1, 1, 1]), 2).tolist() == [2.0, np.inf]
    assert kth_bound(upper, np.array([1, 2, 1]), 2).tolist() == [1.0, np.inf]
    assert kth_bound(upper, np.array([1, 1, 1]), 4).tolist() == [np.inf, np.inf]


def test_fewer_points_than_neighbours(spark):
    pts = _points(spark, [[0.0], [0.0], [3.0]])
    got = {r["pid"]: [(s["dist"], s["nid"]) for s in r["neighbours"]] for r in exact_knn(pts, 5, 1).collect()}
    assert got == {0: [(0.0, 0), (3.0, 2)], 2: [(3.0, 0), (3.0, 0)]}
    one = _points(spark, [[1.0]])
    assert exact_knn(one, 2, 1).collect()[0]["neighbours"] == []


def test_smote_balances_and_interpolates(spark):
    """Each synthetic point lies on the segment from a positive to one of its five nearest."""
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b), 1 if i % 5 == 0 else 0) for i, (a, b) in enumerate(rng.random((200, 2)))]
    df = spark.createDataFrame(rows, "account_id long, a double, b double, y int")
    out = smote(df, ["a", "b"], "y", "account_id", leaf_size=8)
    counts = {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert counts[(1, False)] + counts[(1, True)] == counts[(0, False)]
    pos = np.array([[r[1], r[2]] for r in rows if r[3] == 1])
    dist = np.linalg.norm(pos[:, None] - pos[None], axis=2)
    np.fill_diagonal(dist, np.inf)
    near = np.argsort(dist, axis=1)[:, :5]
    a = np.repeat(pos, 5, axis=0)
    step = pos[near].reshape(-1, 2) - a
    used = set()
    for r in out.where("synthetic").collect():
        p = np.array([r["a"], r["b"]])
        u = np.clip(((p - a) * step).sum(axis=1) / (step * step).sum(axis=1), 0, 1)
        off = np.linalg.norm(p - a - u[:, None] * step, axis=1)
        assert off.min() < 1e-9
        used.add(int(off.argmin()) // 5)
    assert len(used) >= len(pos) * 0.9  # all positives are replicated, not a few


def test_smote_leaves_single_positive_alone(spark):
    df = spark.createDataFrame([(1, .1, 1), (2, .2, 0), (3, .3, 0)], "account_id long, a double, y int")
    assert smote(df, ["a"], "y").count() == 3


def test_groups_are_searched_apart(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    rows = [(g, i, rng.standard_normal(3).round(2).tolist(), 1 + i % 2) for g in (0, 2, 5) for i in range(20 + 30 * g)]
    pts = spark.createDataFrame(rows, "draw int, pid long, vec array<double>, mult long")
    joint = exact_knn(pts, 4, 3, leaf_size=16, group="draw")
    assert joint.columns[0] == "draw"
    got = {(r["draw"], r["pid"]): r["neighbours"] for r in joint.collect()}
    assert len(got) == len(rows)
    for g in (0, 2, 5):
        alone = exact_knn(pts.where(F.col("draw") == g).drop("draw"), 4, 3, leaf_size=16).collect()
        assert {r["pid"]: r["neighbours"] for r in alone} == {p: n for (of, p), n in got.items() if of == g}


def test_draws_equal_smote_of_each_part(spark):
    """Subsets of a table with their own features and seeds, in one run and one by one."""
    from pyspark.sql import functions as F

    from riskspark.operators.smote import Draw, smote_draws

    rng = np.random.default_rng(6)
    rows = [(i if i % 17 else None, float(a), float(b), int(i % 7 == 0), i % 3)
            for i, (a, b) in enumerate(rng.integers(0, 9, (150, 2)))]
    df = spark.createDataFrame(rows, "account_id long, a double, b double, y int, part int")
    few = (F.col("y") == 0) | (F.col("account_id") < 25)  # three positives: two neighbours
    draws = [Draw(F.col("part") != 0, ["a", "b"], 4), Draw(F.col("part") != 1, ["b"], 5), Draw(few, ["b", "a"], 6),
             Draw(F.col("y") == 0, ["a"], 7)]
    got: dict = {}
    for r in smote_draws(df, draws).collect():
        got.setdefault(r["draw"], []).append(tuple(r["svec"]))
    assert 3 not in got
    for k, d in enumerate(draws[:3]):
        alone = smote(df.where(d.rows), d.features, seed=d.seed).where("synthetic").select(*d.features).collect()
        assert alone and sorted(map(tuple, alone)) == sorted(v[:len(d.features)] for v in got[k])


def test_training_oversamples_all_fits_in_one_run(spark, monkeypatch):
    """The jobs of a training must not grow with its fits: one search of neighbours serves all of them."""
    import riskspark.operators.smote as module
    from riskspark.plans.learn import GBTParams, train_many

    calls, search = [], module.exact_knn
    monkeypatch.setattr(module, "exact_knn", lambda *a, **kw: calls.append(1) or search(*a, **kw))
    rows = [(i, float(i % 11), float(i % 5), int(i % 6 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "account_id long, a double, b double, y int")
    models, _ = train_many(df, ["a", "b"], {"A": True, "B": False}, params=GBTParams(max_iter=2), n_folds=3)
    assert set(models) == {"A", "B"} and len(calls) == 1


def test_replicas_are_made_after_the_joins(spark):
    """A join of the replicas would move each point's vector once per synthetic row."""
    from riskspark.operators.smote import Draw, smote_draws
    rows = [(k, int(k < 12), float(k % 7), float(k * k % 11)) for k in range(200)]
    df = spark.createDataFrame(rows, "account_id long, y int, a double, b double")
    made = smote_draws(df, [Draw(F.lit(True), ["a", "b"])])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(sequence") < plan.index("Join Inner")
    assert made.count() == 176


def test_kth_bound_of_points_that_count_several_times():
    rng = np.random.default_rng(4)
    upper, mults = rng.random((30, 50)), rng.integers(1, 4, 50)
    for k in (1, 5, 40):
        want = [np.sort(np.repeat(row, mults))[k - 1] for row in upper]
        assert kth_bound(upper, mults, k).tolist() == want
