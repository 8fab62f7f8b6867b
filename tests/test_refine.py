"""Histogram refinement against sorted columns."""

import math

import numpy as np
import pytest

from riskspark.operators import refine


def brute_median(x):
    x = np.sort(x[~np.isnan(x)])
    return (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2 if len(x) else 0.0


def brute_ks(x, y):
    a, b = x[(y == 1) & ~np.isnan(x)], x[(y != 1) & ~np.isnan(x)]
    if len(a) < 2 or len(b) < 2:
        return None
    return max(abs((a <= v).sum() / len(a) - (b <= v).sum() / len(b)) for v in np.concatenate([a, b]))


def brute_information(x, y, fill, n_bins=20, discrete=10):
    x = np.where(np.isnan(x), fill, x) + 0.0
    n, values = len(x), np.unique(x)
    below = np.array([(x < v).sum() for v in x])
    bins = x if len(values) <= discrete else below * n_bins // n
    total = 0.0
    for b in np.unique(bins):
        for label in (0, 1):
            both = ((bins == b) & ((y == 1) == label)).sum()
            if both:
                total += both / n * math.log(both * n / ((bins == b).sum() * ((y == 1) == label).sum()))
    return total


def columns(n, seed):
    """Measured, skewed, few-valued, one huge tie, nulls, extremes, constant, empty, one value per row."""
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < .3).astype(int)
    x = rng.normal(size=n)
    out = {"normal": x + y, "tiny": 1 + x * 1e-13, "huge": np.exp(30 * x), "few": rng.integers(0, 4, n).astype(float),
           "eleven": rng.integers(0, 11, n).astype(float), "tie": np.where(rng.random(n) < .8, 5.0, x),
           "nulls": np.where(rng.random(n) < .6, np.nan, x - y), "signs": np.where(x > 0, 0.0, -0.0),
           "edges": rng.choice([np.inf, -np.inf, 5e-324, -5e-324, 1.7e308, 0.0], n), "constant": np.full(n, 3.0),
           "empty": np.full(n, np.nan), "place": np.arange(n) - 1e6, "flag": (rng.random(n) < .01).astype(float)}
    return out, y


def frame(spark, cols, y):
    rows = [tuple([None if np.isnan(c[i]) else float(c[i]) for c in cols.values()] + [int(y[i])]) for i in range(len(y))]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols) + ", y int").repartition(3)


@pytest.mark.parametrize("cells", [1 << 20, 64])
def test_against_sorted_columns(spark, monkeypatch, cells):
    """Also with a budget so small that ranges have four cells and wait for later passes."""
    monkeypatch.setattr(refine, "MOST_BINS", cells)
    cols, y = columns(400 if cells == 64 else 1500, cells)
    df = frame(spark, cols, y).checkpoint()
    names = list(cols)
    got = refine.medians(df, names)
    assert got == {c: pytest.approx(brute_median(x), rel=0, abs=0, nan_ok=True) for c, x in cols.items()}
    assert refine.ks_statistics(df, names) == {c: brute_ks(x, y) for c, x in cols.items()}
    finite = [c for c in names if c != "edges"]
    info = refine.label_information(df, finite, {c: got[c] for c in finite})
    assert info == {c: pytest.approx(brute_information(cols[c], y, got[c]), abs=1e-12) for c in finite}
    assert refine.flag_counts(df, names) == {
        c: (int(((x >= 1) & (y == 1)).sum()), int(((x >= 1) & (y == 0)).sum())) for c, x in cols.items()}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, y int")
    assert refine.medians(empty, ["a"]) == {"a": 0.0} and refine.ks_statistics(empty, ["a"]) == {"a": None}
    assert refine.label_information(empty, ["a"], {}) == {"a": 0.0}
    assert refine.flag_counts(empty, ["a"]) == {"a": (0, 0)}
    one = spark.createDataFrame([(2.5, 1), (None, None)], "a double, y int")
    assert refine.medians(one, ["a"]) == {"a": 2.5} and refine.ks_statistics(one, ["a"]) == {"a": None}


def test_width_of_the_reference(spark):
    """3,924 columns: the shuffle holds cells, not values, and no pass reads the table per group of columns."""
    n, width = 300, 3924
    base = spark.range(n).selectExpr(*[f"(xxhash64(id, {k}) % 1000) / 7.0D as b{k}" for k in range(50)],
                                     "cast(id % 7 = 0 as int) as y").checkpoint()
    df = base.selectExpr(*[f"b{k % 50} as c{k}" for k in range(width)], "y")
    names = [f"c{k}" for k in range(width)]
    got = refine.medians(df, names)
    x = base.drop("y").toPandas().to_numpy(float)
    assert [got[f"c{k}"] for k in range(50)] == [brute_median(x[:, k]) for k in range(50)]
    assert all(got[f"c{k}"] == got[f"c{k % 50}"] for k in range(width))
