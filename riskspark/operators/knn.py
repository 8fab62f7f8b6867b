"""Exact k-nearest neighbours by filter and refine (C4, used by SMOTE D6).

Points are first de-duplicated (a vector repeated by a third of the rows is
one point with a multiplicity). A tree cuts them into leaves of about ``leaf_size``
points, split at the *exact* median of the cell's widest dimension (ties in it by a
random projection), each level checkpointed to the shared folder. A leaf becomes one
row, a block:

* its **vector approximations**: each dimension of the leaf's box is cut into
  ``2^bits`` cells, a point is its cell numbers (a byte each) and the distance
  ``e`` from the centre ``c`` that the numbers name;
* its points as queries, each with a first bound on its k-th neighbour distance.

``|q - c| - e <= |q - x| <= |q - c| + e`` bounds a distance by the approximation
alone, and the bounds of a pair of blocks are one matrix product. Search:

1. *Filter.* A block's queries travel to the blocks whose boxes lie within their own
   first bounds, those only. A query keeps the points whose lower bound is within its
   k-th smallest upper bound there.
2. The k-th smallest upper bound over all blocks drops more of them.
3. *Refine.* Only for what is left the vectors are fetched and compared.

Points may come in groups that are searched apart in the same passes: each group is
a tree of its own, whose root cell is the group's number.

No candidate is dropped without that proof, so the result equals brute force. The
boxes prune where few dimensions hold most of the spread; in many (13 to 200 tested)
it is the approximations that leave few exact distances (``n_compared`` tells how many).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.operators.cumulative import running_sums

#: Points of a block, and bits of a dimension's cell number (8 at most: a byte).
LEAF_SIZE, BITS = 1024, 8
#: Share of a random projection in a cell's split, which only has to part equal values.
TILT = 1e-3
#: Boxes that a block's queries are held against at once (a power of two), and queries that meet a block at once.
BOXES_BITS, QUERIES = 10, 64
#: Relative room for rounding in the bounds.
ROOM = 1e-12
BLOCK = ("cell long, grp long, pids binary, vecs binary, mults binary, bounds binary, farthest double, "
         "codes binary, low binary, high binary, step binary, errors binary")
CANDIDATE = "grp long, pid long, nid long, mult long, lower double, upper double"


def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _dot(a: Column, u: list) -> Column:
    lit = F.array(*[F.lit(float(x)) for x in u])
    return F.aggregate(F.zip_with(a, lit, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _widest(df: DataFrame, d: int) -> DataFrame:
    """The dimension of the greatest spread in each cell."""
    spread = F.array(*[F.coalesce(F.var_pop(F.col("vec")[i]), F.lit(0.0)) for i in range(d)])
    return df.groupBy("cell").agg(spread.alias("_spread")).select(
        "cell", (F.array_position("_spread", F.array_max("_spread")) - 1).cast("int").alias("_dim"))


def _median_by_cell(df: DataFrame) -> DataFrame:
    counts = df.groupBy("cell", F.col("proj").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    # cells grow with the data: no forced broadcast of their cut points
    cum = running_sums(counts, ["cell"], "value", ["cnt"], broadcast_groups=False)
    n = F.col("tot_cnt")
    lo, hi = F.floor((n - 1) / 2) + 1, F.floor(n / 2) + 1
    first = F.col("cum_cnt") - F.col("cnt")
    return cum.groupBy("cell").agg(
        ((F.max(F.when((first < lo) & (lo <= F.col("cum_cnt")), F.col("value")))
          + F.max(F.when((first < hi) & (hi <= F.col("cum_cnt")), F.col("value")))) / 2.0).alias("median"))


def build_tree(points: DataFrame, d: int, leaf_size: int = LEAF_SIZE, seed: int = 7):
    """Return (points with ``cell`` = leaf id, n_levels); a group ``grp`` is a tree."""
    from riskspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(points.sparkSession)
    n = points.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    levels = max(0, math.ceil(math.log2(max(1, n) / leaf_size)))
    rng = np.random.default_rng(seed)
    # checkpointed so ``cell`` is data, not a literal the optimizer would fold into a cross join
    cur = points.select("*", F.col("grp").alias("cell")).checkpoint()
    for _ in range(levels):
        u = rng.standard_normal(d) * TILT
        tilted = F.element_at("vec", F.col("_dim") + 1) + _dot(F.col("vec"), list(u))
        proj = cur.join(_widest(cur, d), "cell").select(*cur.columns, tilted.alias("proj"))
        med = _median_by_cell(proj)
        cur = proj.join(med, "cell").select(
            *[c for c in cur.columns if c != "cell"],
            (F.col("cell") * 2 + F.when(F.col("proj") > F.col("median"), 1).otherwise(0)).alias("cell")
        ).checkpoint()
    return cur, levels


def approximate(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of points (rows) in their own box, its low corner, the cells' widths, and
    each point's distance from its cell's centre (rounded up)."""
    cells = 1 << bits
    low, high = x.min(axis=0), x.max(axis=0)
    step = (high - low) / cells
    width = np.where(step > 0, step, 1.0)
    codes = np.clip(np.floor((x - low) / width), 0, cells - 1).astype(np.uint8)
    errors = np.linalg.norm(x - centres(codes, low, step), axis=1) * (1 + ROOM)
    return codes, low, step, errors


def centres(codes: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    return low + (codes + 0.5) * step


def distance_bounds(q: np.ndarray, c: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's distance to each approximated point."""
    shift = c.mean(axis=0) if len(c) else 0.0  # smaller numbers round less
    q, c = q - shift, c - shift
    qq, cc = (q * q).sum(axis=1)[:, None], (c * c).sum(axis=1)[None, :]
    square = qq + cc - 2.0 * (q @ c.T)
    slack = (qq + cc) * (4e-16 * (q.shape[1] + 8))
    lower = np.sqrt(np.maximum(square - slack, 0.0)) * (1 - ROOM) - errors
    upper = np.sqrt(np.maximum(square + slack, 0.0)) * (1 + ROOM) + errors
    return np.maximum(lower, 0.0), upper


def kth_bound(upper: np.ndarray, mults: np.ndarray, k: int) -> np.ndarray:
    """The least bound in each row that ``k`` neighbours (points count ``mults`` times) keep to."""
    if upper.shape[1] > k:  # points count once or more, so the k least hold it
        near = np.argpartition(upper, k - 1, axis=1)[:, :k]
        upper, mults = np.take_along_axis(upper, near, axis=1), mults[near]
    else:
        mults = np.broadcast_to(mults, upper.shape)
    order = np.argsort(upper, axis=1, kind="stable")
    held = np.cumsum(np.minimum(np.take_along_axis(mults, order, axis=1), k), axis=1) >= k
    first = held.argmax(axis=1)
    at = np.arange(len(upper))
    return np.where(held.any(axis=1), upper[at, order[at, first]], np.inf)


def _tasks(df: DataFrame) -> int:
    """Partitions of work that is heavy for its bytes (a block takes a matrix product per pair), which the
    session would merge by size."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _blocks(leaves: DataFrame, k: int, d: int, bits: int) -> DataFrame:
    """One row per leaf: its points as queries, with a first bound each, and their approximations."""
    def pack(leaf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(leaf["vec"].to_numpy()).astype(np.float64).reshape(len(leaf), d)
        mults = leaf["mult"].to_numpy(np.int64)
        codes, low, step, errors = approximate(x, bits)
        _, upper = distance_bounds(x, centres(codes, low, step), errors)
        np.fill_diagonal(upper, np.inf)
        # a point's own copies are neighbours at distance 0
        bounds = np.where(mults > k, 0.0, np.inf)
        for own in np.unique(mults[mults <= k]):
            rows = mults == own
            bounds[rows] = kth_bound(upper[rows], mults, k - own + 1)
        return pd.DataFrame({
            "cell": [leaf["cell"].iloc[0]], "grp": [leaf["grp"].iloc[0]], "pids": [leaf["pid"].to_numpy(np.int64).tobytes()],
            "vecs": [x.tobytes()], "mults": [mults.tobytes()], "bounds": [bounds.tobytes()],
            "farthest": [float(bounds.max())], "codes": [codes.tobytes()], "low": [low.tobytes()],
            "high": [x.max(axis=0).tobytes()], "step": [step.tobytes()], "errors": [errors.tobytes()]})

    return leaves.select("cell", "grp", "pid", "vec", "mult").repartition(_tasks(leaves), "cell").groupBy("cell").applyInPandas(pack, BLOCK)


def _doubles(value: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(value, np.float64).reshape(shape or (-1,))


def _block_pairs(blocks: DataFrame, levels: int, d: int) -> DataFrame:
    """Queries with the approximations of each block whose box is within reach of their bounds."""
    asks, answers = ["pids", "vecs", "bounds"], ["mults", "codes", "low", "step", "errors"]
    if levels == 0:  # a block per group, which meets itself
        return blocks.select("grp", *asks, F.col("pids").alias("nids"), *answers)
    blocks = blocks.checkpoint()
    # a group's boxes go to several tasks, its blocks are dealt over them
    n = _tasks(blocks)
    boxes = blocks.groupBy("grp", F.shiftright("cell", BOXES_BITS)).agg(F.collect_list(F.struct("cell", "low", "high")).alias("boxes")) \
        .select("grp", "boxes", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("share"))
    dealt = blocks.select("grp", F.pmod("cell", F.lit(n)).cast("int").alias("share"), *asks)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, bounds = _doubles(row["vecs"], -1, d), _doubles(row["bounds"])
                pids, room = np.frombuffer(row["pids"], np.int64), bounds * (1 + ROOM)
                low, high = (np.stack([_doubles(b[c]) for b in row["boxes"]]) for c in ("low", "high"))
                gaps = np.maximum(0.0, np.maximum(low - q.max(axis=0), q.min(axis=0) - high))
                # negated, so that what can't be compared (overflow) stays
                for k in np.flatnonzero(~((gaps * gaps).sum(axis=1) > room.max() ** 2)).tolist():
                    gap = np.maximum(0.0, np.maximum(low[k] - q, q - high[k]))
                    near = np.flatnonzero(~((gap * gap).sum(axis=1) > room * room))
                    if len(near):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["grp"]]), pa.array([row["boxes"][k]["cell"]]), *[
                                pa.array([x[near].tobytes()]) for x in (pids, q, bounds)]], ["grp", "node", *asks])

    asked = dealt.repartition(n, "grp", "share").join(boxes.repartition(n, "grp", "share"), ["grp", "share"]).mapInArrow(
        reach, "grp long, node long, pids binary, vecs binary, bounds binary")
    return asked.repartition(n, "node").join(
        blocks.select(F.col("cell").alias("node"), F.col("pids").alias("nids"), *answers).repartition(n, "node"), "node")


def _filter(pairs: DataFrame, k: int, d: int) -> DataFrame:
    """Candidates of every pair of blocks: what a query's bounds in that pair don't exclude."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pids, nids, mults = (np.frombuffer(row[c], np.int64) for c in ("pids", "nids", "mults"))
                vecs, bounds, errors = _doubles(row["vecs"], -1, d), _doubles(row["bounds"]), _doubles(row["errors"])
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, d)
                points = centres(codes, _doubles(row["low"]), _doubles(row["step"]))
                for lo in range(0, len(pids), QUERIES):  # as many as a core's cache holds
                    own = pids[lo:lo + QUERIES]
                    lower, upper = distance_bounds(vecs[lo:lo + QUERIES], points, errors)
                    itself = own[:, None] == nids[None, :]
                    upper[itself] = np.inf
                    bound = np.minimum(bounds[lo:lo + QUERIES], kth_bound(upper, mults, k))
                    # negated, so that what can't be compared (overflow) stays
                    q, n = np.nonzero(~(lower > bound[:, None]) & ~itself)
                    if len(q):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(q), row["grp"])), pa.array(own[q]), pa.array(nids[n]), pa.array(mults[n]),
                             pa.array(lower[q, n]), pa.array(upper[q, n])], ["grp", "pid", "nid", "mult", "lower", "upper"])

    return pairs.mapInArrow(meet, CANDIDATE)


def exact_knn(points: DataFrame, k: int, d: int, leaf_size: int = LEAF_SIZE, seed: int = 7,
              bits: int = BITS, group: str | None = None) -> DataFrame:
    """``points(pid, vec, mult)`` -> ``(pid, neighbours ARRAY<STRUCT<dist, nid>>, n_compared)``, k slots.

    ``group`` names a column of small numbers (0 or more, long): neighbours are sought in a point's own group, the
    column comes first in the result, and a ``pid`` names a point of a group.

    Duplicates of a point count as neighbours at distance 0 (``mult - 1`` slots). Equal distances
    are ordered by ``nid``. ``n_compared``: exact distances that the point needed.
    """
    grp = F.col(group).cast("long") if group else F.lit(0).cast("long")
    leaves, levels = build_tree(points.select(grp.alias("grp"), "pid", "vec", "mult"), d, leaf_size, seed)
    point = ["grp", "pid"]
    # 1. filter: the bounds of the points of near blocks
    close_blocks = _block_pairs(_blocks(leaves, k, d, bits), levels, d)

    # 2. the k-th smallest upper bound over all blocks (both windows share one exchange)
    held = Window.partitionBy(*point).orderBy("upper", "nid")
    bound = F.min(F.when(F.col("_held") >= k, F.col("upper"))).over(Window.partitionBy(*point))
    close = (_filter(close_blocks, k, d).repartition(_tasks(leaves), *point).withColumn("_held", F.sum(F.least("mult", F.lit(k))).over(held))
             .withColumn("bound", bound).where(~F.coalesce(F.col("lower") > F.col("bound"), F.lit(False))))

    # 3. refine: vectors only for what is left
    vecs = leaves.select(*point, "vec")
    exact = (close.select(*point, "nid", "mult").join(vecs, point)
             .join(vecs.select("grp", F.col("pid").alias("nid"), F.col("vec").alias("nvec")), ["grp", "nid"])
             .select(*point, "nid", "mult", F.sqrt(_sqdist(F.col("vec"), F.col("nvec"))).alias("dist")))
    rank = Window.partitionBy(*point).orderBy("dist", "nid")
    best = (exact.withColumn("_rank", F.row_number().over(rank)).groupBy(*point).agg(
        F.count(F.lit(1)).alias("n_compared"),
        F.array_sort(F.collect_list(F.when(F.col("_rank") <= k, F.struct("dist", "nid", "mult")))).alias("best")))
    slot = "array<struct<dist:double,nid:long,mult:bigint>>"
    itself = F.when(F.col("mult") > 1, F.array(F.struct(F.lit(0.0).alias("dist"), F.col("pid").alias("nid"),
                                                       (F.col("mult") - 1).alias("mult")))) \
        .otherwise(F.array().cast(slot))
    merged = leaves.select(*point, "mult").join(best, point, "left")
    slots = F.flatten(F.transform(F.concat(itself, F.coalesce(F.col("best"), F.array().cast(slot))),
                                  lambda c: F.array_repeat(F.struct(c["dist"].alias("dist"), c["nid"].alias("nid")),
                                                           F.least(c["mult"], F.lit(k)).cast("int"))))
    return merged.select(*([F.col("grp").alias(group)] if group else []), "pid", F.slice(slots, 1, k).alias("neighbours"),
                         F.coalesce("n_compared", F.lit(0)).cast("long").alias("n_compared"))
