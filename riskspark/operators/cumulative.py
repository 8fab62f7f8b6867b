"""Exact running sums over an ordered column without a single-partition window.

A global ``Window.orderBy`` plans ``Exchange SinglePartition``: every row in one
task. Here the ordered values are cut into ``n_buckets`` ranges by approximate
quantiles (per group), bucket totals are prefix-summed (a tiny table), and the
running sum inside each (group, bucket) is added to the bucket's offset. The
result is exact; only the bucket borders are approximate, which affects load
balance, never values.

Input rows should already be aggregated to distinct order values (ties then
need no special handling and a hot value is one row).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


ROWS_PER_BUCKET = 20_000


def buckets_for(df: DataFrame, group_cols: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets that hold about ``rows_per_bucket`` rows of the largest group."""
    counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"))
    return max(1, math.ceil((counts.agg(F.max("n")).first()[0] or 0) / rows_per_bucket))


def running_sums(df: DataFrame, group_cols: list[str], order_col: str, sum_cols: list[str],
                 descending: bool = False, n_buckets: int | None = None,
                 accuracy: int | None = None, broadcast_groups: bool = True) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum) and ``tot_<c>`` (group total) per ``sum_cols``.

    Rows are ordered by ``order_col`` (ascending unless ``descending``) within
    ``group_cols``; ``order_col`` values must be distinct within a group.
    ``n_buckets`` follows the largest group's rows unless given, so a window task
    sorts about ``ROWS_PER_BUCKET`` rows at any size; the input is read several times
    and should be a written table. The per-group cut points and bucket offsets (groups x n_buckets rows) are
    broadcast when ``broadcast_groups`` (groups = features, models, classes:
    schema-sized); pass False when the number of groups grows with the data.
    """
    g = list(group_cols)
    n_buckets = n_buckets or buckets_for(df, g)
    accuracy = accuracy or max(1000, 10 * n_buckets)
    if n_buckets == 1 and g:
        by = Window.partitionBy(*g)
        upto = by.orderBy((-F.col(order_col) if descending else F.col(order_col)).asc()) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select("*", *[F.sum(c).over(upto).alias(f"cum_{c}") for c in sum_cols],
                         *[F.sum(c).over(by).alias(f"tot_{c}") for c in sum_cols])
    if not g:
        return _running_sums_global(df, order_col, sum_cols, descending, n_buckets, accuracy)
    key = F.col(order_col)
    okey = -key if descending else key
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cuts = df.groupBy(*g).agg(F.percentile_approx(okey, probs, accuracy).alias("_cuts"))
    # one row per group with n_buckets-1 doubles: bounded by the number of groups
    # (features or models), never by the number of rows
    small = F.broadcast if broadcast_groups else (lambda x: x)
    withcuts = df.join(small(cuts), g, "inner")
    bucketed = withcuts.select(
        "*", F.size(F.filter("_cuts", lambda c: c < okey)).alias("_bucket")).drop("_cuts")

    totals = bucketed.groupBy(*g, "_bucket").agg(*[F.sum(c).alias(f"_bt_{c}") for c in sum_cols])
    wb = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*g)
    offsets = totals.select(
        *g, "_bucket",
        *[F.coalesce(F.sum(f"_bt_{c}").over(wb), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
        *[F.sum(f"_bt_{c}").over(wt).alias(f"tot_{c}") for c in sum_cols],
    )
    # offsets: groups x n_buckets rows (broadcast only when groups are schema-sized)
    joined = bucketed.join(small(offsets), [*g, "_bucket"], "inner")
    wr = Window.partitionBy(*g, "_bucket").orderBy(okey.asc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *[c for c in bucketed.columns if c != "_bucket"],
        *[(F.col(f"_off_{c}") + F.sum(c).over(wr)).alias(f"cum_{c}") for c in sum_cols],
        *[F.col(f"tot_{c}") for c in sum_cols],
    )


def _running_sums_global(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool,
                         n_buckets: int, accuracy: int) -> DataFrame:
    """No groups: the n_buckets-1 cut points and the bucket offsets are fetched once
    (bounded by ``n_buckets``) and inlined as literals — no join on a constant key,
    which the optimizer would turn into a cartesian product."""
    key = F.col(order_col)
    okey = -key if descending else key
    probs = [i / n_buckets for i in range(1, n_buckets)]
    cut_vals = (df.agg(F.percentile_approx(okey, probs, accuracy)).first()[0] or []) if probs else []
    cuts = F.array(*[F.lit(v) for v in cut_vals]) if cut_vals else F.array().cast("array<double>")
    bucketed = df.select("*", F.size(F.filter(cuts, lambda c: c < okey)).alias("_bucket"))
    totals = {r["_bucket"]: r for r in bucketed.groupBy("_bucket")
              .agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()}  # <= n_buckets rows
    wr = Window.partitionBy("_bucket").orderBy(okey.asc()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [c for c in df.columns]
    extra = []
    for c in sum_cols:
        offsets, acc = {}, 0
        for b in sorted(totals):
            offsets[b] = acc
            acc += totals[b][c] or 0
        off_map = F.create_map(*[x for b, o in offsets.items() for x in (F.lit(b), F.lit(o))]) \
            if offsets else F.create_map().cast("map<int,bigint>")
        extra.append((F.coalesce(F.element_at(off_map, F.col("_bucket")), F.lit(0)) + F.sum(c).over(wr))
                     .alias(f"cum_{c}"))
        extra.append(F.lit(acc).alias(f"tot_{c}"))
    return bucketed.select(*out, *extra)
