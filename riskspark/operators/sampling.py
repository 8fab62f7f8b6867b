"""Deterministic stratified split and folds (D3, D4) and the K9 sample.

All randomness is ``xxhash64(key, seed)``, never ``rand()`` (which changes
with partitioning). Split and fold borders become one hash cut-off per (class,
border), found by a histogram of hashes; the classes x folds cuts are literals
of a row-wise expression, so a split that was learned once can be replayed.
No row-level join and no single-partition window are needed, and class
shares are exact (up to 64-bit hash collisions sitting exactly on a border).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MIN_LONG = -(2 ** 63)


def row_hash(key: str, seed: int):
    return F.xxhash64(F.col(key).cast(T.StringType()), F.lit(seed))


def _class_counts(df: DataFrame, y: str) -> dict:
    # one row per class: a config-sized result
    return {r[0]: r[1] for r in df.groupBy(y).count().collect()}


def holdout_allocation(class_counts: dict, test_fraction: float) -> dict:
    """Per-class test sizes: ceil(fraction * n) split by class share, remainders
    to the largest fractional parts (ties: larger class, then class value)."""
    n = sum(class_counts.values())
    n_test = math.ceil(test_fraction * n)
    raw = {c: n_test * k / n for c, k in class_counts.items()}
    alloc = {c: math.floor(v) for c, v in raw.items()}
    left = n_test - sum(alloc.values())
    order = sorted(class_counts, key=lambda c: (-(raw[c] - alloc[c]), -class_counts[c], c))
    for c in order[:left]:
        alloc[c] += 1
    return alloc


def _per_class(values: dict, cls: Column, kind: str) -> Column:
    """The value of a row's class, NULL for other classes: a literal map, as there are few classes."""
    if not values:
        return F.lit(None).cast(kind)
    return F.try_element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c).cast("long"), v)]), cls)


def _longs(values: list) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values]).cast("array<bigint>")


def _cutoffs(df: DataFrame, y: str, key: str, seed: int, counts: dict, borders: dict,
             rows_per_bucket: int = 20_000) -> list[list]:
    """``borders``: class -> list of inclusive rank borders. Returns ``[class, cuts]`` pairs:
    for each border the largest hash whose running count is within it.

    A histogram of hash prefixes finds the bucket that holds each border; only the
    rows of these buckets (about ``rows_per_bucket`` each) are then ranked. Classes
    that fit in one bucket need no histogram.
    """
    bits = max(0, math.ceil(math.log2(max(1, max(counts.values(), default=1) / rows_per_bucket))))
    borders = {int(c): list(bs) for c, bs in borders.items()}
    cls = F.col("_cls")
    hashed = df.select(F.col(y).cast("long").alias("_cls"), row_hash(key, seed).alias("_h"))
    hashed = hashed.withColumn("_bucket", F.shiftright("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    if bits:
        upto = Window.partitionBy("_cls").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        histogram = hashed.groupBy("_cls", "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn(
            "_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        wanted = _per_class({c: _longs(bs) for c, bs in borders.items()}, cls, "array<bigint>")
        inside = (F.col("_before") < F.col("_b")) & (F.col("_b") <= F.col("_before") + F.col("_n"))
        found = {(r["_cls"], r["_i"]): (r["_bucket"], r["_b"] - r["_before"]) for r in
                 histogram.select("*", F.posexplode(wanted).alias("_i", "_b")).where(inside).collect()}
        buckets = {c: sorted({b for (of, _), (b, _) in found.items() if of == c}) for c in borders}
        hashed = hashed.where(F.array_contains(
            _per_class({c: _longs(bs) for c, bs in buckets.items()}, cls, "array<bigint>"), F.col("_bucket")))
    else:
        n = {int(c): k for c, k in counts.items()}
        found = {(c, i): (0, int(b)) for c, bs in borders.items() for i, b in enumerate(bs) if 0 < b <= n[c]}
    top: dict = {}
    if found:
        ranked = hashed.groupBy("_cls", "_bucket", "_h").agg(F.count(F.lit(1)).alias("_n")) \
            .withColumn("_cum", F.sum("_n").over(Window.partitionBy("_cls", "_bucket").orderBy("_h")))

        def within(i: int) -> Column:
            bucket, rest = (_per_class({c: F.lit(v[k]).cast("long") for (c, at), v in found.items() if at == i},
                                       cls, "bigint") for k in (0, 1))
            return F.max(F.when((F.col("_bucket") == bucket) & (F.col("_cum") <= rest), F.col("_h"))).alias(f"_cut{i}")
        which = sorted({i for _, i in found})
        for r in ranked.groupBy("_cls").agg(*[within(i) for i in which]).collect():  # a row per class
            top |= {(r["_cls"], i): r[f"_cut{i}"] for i in which}

    def cut(c, i):
        if (c, i) not in found:  # a border at rank 0
            return _MIN_LONG
        low = (found[c, i][0] << (64 - bits)) if bits else _MIN_LONG
        return top[c, i] if top.get((c, i)) is not None else max(_MIN_LONG, low - 1)
    return [[c, [cut(c, i) for i in range(len(bs))]] for c, bs in borders.items()]


def _class_cuts(cuts: list[list], y: str) -> Column:
    return _per_class({c: _longs(values) for c, values in cuts}, F.col(y).cast("long"), "array<bigint>")


def split_cuts(df: DataFrame, y: str = "y", key: str = "account_id", test_fraction: float = 0.2,
               seed: int = 42) -> list[list]:
    """What ``stratified_split`` learns: ``[class, [largest hash of a test row]]`` pairs."""
    counts = _class_counts(df, y)
    return _cutoffs(df, y, key, seed, counts, {c: [a] for c, a in holdout_allocation(counts, test_fraction).items()})


def apply_split(df: DataFrame, cuts: list[list], y: str = "y", key: str = "account_id", seed: int = 42) -> DataFrame:
    """Add ``is_test`` by learned cuts, row by row."""
    return df.select("*", F.coalesce(row_hash(key, seed) <= F.element_at(_class_cuts(cuts, y), 1), F.lit(False))
                     .alias("is_test"))


def stratified_split(df: DataFrame, y: str = "y", key: str = "account_id",
                     test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """D3: add ``is_test``; exact per-class test counts (see ``holdout_allocation``)."""
    return apply_split(df, split_cuts(df, y, key, test_fraction, seed), y, key, seed)


def fold_cuts(df: DataFrame, k: int = 5, y: str = "y", key: str = "account_id", seed: int = 43) -> list[list]:
    """What ``stratified_folds`` learns: ``[class, borders of the folds]`` pairs."""
    counts = _class_counts(df, y)
    borders = {c: [round(j * n / k) for j in range(1, k)] for c, n in counts.items()}
    return _cutoffs(df, y, key, seed, counts, borders) if k > 1 else []


def apply_folds(df: DataFrame, cuts: list[list], k: int = 5, y: str = "y", key: str = "account_id",
                seed: int = 43) -> DataFrame:
    """Add ``fold`` by learned cuts, row by row."""
    if k == 1:
        return df.select("*", F.lit(0).alias("fold"))
    h = row_hash(key, seed)
    return df.select("*", F.size(F.filter(_class_cuts(cuts, y), lambda c: h > c)).alias("fold"))


def stratified_folds(df: DataFrame, k: int = 5, y: str = "y", key: str = "account_id",
                     seed: int = 43) -> DataFrame:
    """Add ``fold`` in [0, k): each class cut into k hash-ordered chunks of equal size (+-1)."""
    return apply_folds(df, fold_cuts(df, k, y, key, seed), k, y, key, seed)


def hash_sample(df: DataFrame, n: int, key: str = "account_id", seed: int = 0) -> DataFrame:
    """K9: the n rows with the smallest ``xxhash64(key, seed)`` (all rows when fewer).

    ``orderBy().limit(n)`` plans TakeOrderedAndProject (per-partition top-n)."""
    return df.orderBy(row_hash(key, seed), F.col(key)).limit(n)
