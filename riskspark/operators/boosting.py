"""Joint histogram boosting (D7): all folds and models of a training run grow their trees together.

Every feature is binned once (quantile cuts over the training rows). A *fit* is one
boosted model; a row names the fits that learn from it in a bit mask. The rows of
a fit are packed into blocks of byte matrices, dealt evenly over the cores, and one
pass over the blocks per tree level gives the gradient histograms of all nodes of
all fits. Of two siblings only the lighter one is counted, the other is the parent
less its sibling. Histograms have a fixed size (fits x nodes x features x bins), are
added up on the executors, and the driver only picks splits. A finished tree is
added to a row's margin once, and the blocks with their margins stay cached until
the next tree; every ``REFRESH`` trees they are written to the shared folder, so a
lost executor costs little.

A run whose fits have at most ``rows_per_task`` rows each needs no exchange
between tasks: there each fit is one task that grows all its trees by the same
functions, at a byte per row and feature and about forty more per row. Beyond
that bound the levels are grown together as described: a pass over the blocks is
a Spark job, and a run has ``trees x depth`` of them.

Loss: weighted logistic, second order. Leaf value ``-G / (H + l2)``, split gain
``GL^2/(HL+l2) + GR^2/(HR+l2) - G^2/(H+l2)``; rows and columns are sampled per tree
by hash, so a rerun gives the same model.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.session import ensure_checkpoint_dir

#: Trees between two written states of the margins.
REFRESH = 20
#: Rows of a block.
BLOCK_ROWS = 8_192
#: Rows of one fit that a task may hold, and bytes of their bins; larger fits are grown level by level over all blocks.
ROWS_PER_TASK, BYTES_PER_TASK = 10_000_000, 128 << 20
#: Rows that a task handles at once, and from how many rows of a fit on columns of few bins are counted together,
#: in at most so many cells.
CHUNK_ROWS, JOINT_ROWS, JOINT_CELLS = 1 << 17, 1 << 18, 1 << 12
#: Rows of all fits in a partition of blocks, where there are more than the cores' share.
ROWS_PER_PARTITION = 2_000_000
#: Relative rank error of the cuts.
CUT_ERROR = 1.0 / 4096


@dataclass
class BoostParams:
    trees: int = 300
    depth: int = 4
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    min_child: float = 1.0
    l2: float = 1.0
    bins: int = 256
    seed: int = 42


@dataclass
class Fit:
    """One boosted model of a run: the features it may use (places in the run's list) and the weight of positives."""

    features: list[int]
    weight: float = 1.0


@dataclass
class BoostedTrees:
    """A fitted model. Trees are complete: node i has the children 2i + 1 (value <= threshold) and 2i + 2;
    ``feature`` is -1 where a node does not split. ``value`` holds the margin a row gets at a node where it stays."""

    features: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    info: dict = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for the rows of a matrix (columns as ``features``)."""
        out = np.zeros(len(x))
        depth, n = int(math.log2(self.feature.shape[1] + 1)) - 1, self.feature.shape[1]
        first = np.arange(len(self.feature)) * n  # flat places: ``take`` is far faster than indexing by pairs
        feature, threshold, value = self.feature.ravel(), self.threshold.ravel(), self.value.ravel()
        for lo in range(0, len(x), 512):
            part = np.ascontiguousarray(x[lo:lo + 512])
            node, row = np.zeros((len(part), len(first)), np.int64), np.arange(len(part))[:, None] * x.shape[1]
            for _ in range(depth):
                at = first + node
                f = feature.take(at)
                right = part.take(row + np.maximum(f, 0)) > threshold.take(at)
                node = np.where(f >= 0, 2 * node + 1 + right, node)
            out[lo:lo + 512] = value.take(first + node).sum(axis=1)
        return out

    def flat_trees(self) -> list[tuple[float, dict]]:
        """(weight, arrays) of each tree in the form that attribution reads; its margin is twice the weighted
        sum, hence the weight of a half."""
        out = []
        for f, thr, v, c in zip(self.feature, self.threshold, self.value, self.cover):
            inner = f >= 0
            at = np.arange(len(f))
            out.append((0.5, {"feature": f.copy(), "threshold": thr, "value": np.where(inner, 0.0, v), "cover": c,
                              "left": np.where(inner, 2 * at + 1, -1), "right": np.where(inner, 2 * at + 2, -1)}))
        return out

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "feature": self.feature.tolist(),
                           "threshold": self.threshold.tolist(), "value": self.value.tolist(),
                           "cover": self.cover.tolist(), "info": self.info})

    @staticmethod
    def from_json(text: str) -> BoostedTrees:
        d = json.loads(text)
        return BoostedTrees(d["features"], np.array(d["feature"], np.int64), np.array(d["threshold"], float),
                            np.array(d["value"], float), np.array(d["cover"], float), d["info"])

    def probability(self, *columns) -> F.Column:
        """The probability as a column over the feature columns; row by row, so also on a stream."""
        model = self

        @F.pandas_udf(T.DoubleType())
        def score(*values: pd.Series) -> pd.Series:
            return pd.Series(sigmoid(model.margin(np.column_stack([v.to_numpy(float) for v in values]))))
        # columns that use the score often must not repeat it: the optimizer copies deterministic expressions only
        return score.asNondeterministic()(*columns)

    def importance(self) -> dict[str, float]:
        """Share of the total split gain that each feature brought."""
        gain = self.info.get("gain", {})
        total = sum(gain.values()) or 1.0
        return {f: gain.get(f, 0.0) / total for f in self.features}


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))


# ---------------------------------------------------------------- numpy pieces, used by both ways of growing
def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads a counter or a hash over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draw(hashes: np.ndarray, fit: int, tree: int, seed: int) -> np.ndarray:
    """A number in [0, 1) per hash, fit and tree."""
    salt = _mix(np.array([(seed << 40) + (fit << 24) + tree + 1], np.uint64))
    return (_mix(hashes.astype(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / float(1 << 53)


def sampled_columns(fit: Fit, number: int, tree: int, p: BoostParams) -> list[int]:
    """The columns that a tree may split on: the share with the smallest draws."""
    draws = _draw(_mix(np.array(fit.features, np.uint64) + np.uint64(7)), number, tree, p.seed + 1)
    n = max(1, round(p.columns * len(fit.features)))
    return sorted(np.array(fit.features)[np.argsort(draws, kind="stable")[:n]].tolist())


def _descend(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each column of ``codes`` (features x rows) after some levels of one tree."""
    node = np.zeros(codes.shape[1], np.int64)
    for _ in range(levels):
        node = _step(codes, node, feature, cut)
    return node


def _step(codes: np.ndarray, node: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The node of each column of ``codes`` one level below ``node``; a node that doesn't split keeps its rows."""
    at, splits = np.arange(len(feature)), feature >= 0
    # flat places and small tables: no code lies above 255, so rows of a node that doesn't split never go right
    left = np.where(splits, 2 * at + 1, at).astype(node.dtype)
    limit = np.where(splits, cut, 255).astype(np.uint8)
    place = (np.maximum(feature, 0) * codes.shape[1]).take(node)
    place += np.arange(codes.shape[1])
    return left.take(node) + (codes.ravel().take(place) > limit.take(node))


def _gradients(margin: np.ndarray, y: np.ndarray, used: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(margin)
    w = np.where(y > 0, weight, 1.0) * used
    return w * (p - y), w * p * (1.0 - p)


def _histogram(codes: np.ndarray, node: np.ndarray, wanted: list[int], g: np.ndarray, h: np.ndarray,
               used: np.ndarray, columns: list[int], bins: int) -> np.ndarray:
    """Sums of g, h and rows: (wanted nodes, columns, bins, 3). Rows outside the sample count as no rows."""
    out = np.zeros((len(wanted), len(columns), bins, 3))
    place = np.full(int(node.max(initial=0)) + 1, -1)
    for k, n in enumerate(wanted):
        if n < len(place):
            place[n] = k
    rows = np.flatnonzero((place[node] >= 0) & used)
    if len(rows):
        base, weights, size = place[node[rows]] * bins, (g[rows], h[rows], None), len(wanted) * bins
        for c, column in enumerate(columns):
            index = base + codes[column, rows]
            for k, values in enumerate(weights):
                out[:, c, :, k] = np.bincount(index, values, size).reshape(len(wanted), bins)
    return out


class _Tree:
    """One tree of one fit while it grows."""

    def __init__(self, p: BoostParams, columns: list[int]):
        n = 2 ** (p.depth + 1) - 1
        self.p, self.columns = p, columns
        self.feature, self.cut = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.value, self.cover = np.zeros(n), np.zeros(n)
        self.sums = {}      # node -> (G, H, rows)
        self.hist = {}      # histograms of the level above
        self.open = [0]
        self.gain: dict[int, float] = {}

    def wanted(self) -> list[int]:
        """The open nodes to count: the root, and the lighter one of two siblings."""
        if self.open == [0]:
            return [0]
        pairs = [(n, n + 1) for n in self.open if n % 2]
        return [a if self.sums[a][2] <= self.sums[b][2] else b for a, b in pairs]

    def split(self, counted: dict[int, np.ndarray]) -> None:
        """Take the level's histograms, complete the siblings, choose the best split of each open node."""
        p, hists = self.p, {}
        for n, hist in counted.items():
            hists[n] = hist
            if n:
                other = n + 1 if n % 2 else n - 1
                hists[other] = self.hist[(n - 1) // 2] - hist
        if 0 in hists:
            self._close(0, hists[0][0].sum(axis=0))
        children = []
        for n in self.open:
            left = np.cumsum(hists[n], axis=1)
            total = left[0, -1]
            right = total - left
            ok = (left[..., 1] >= p.min_child) & (right[..., 1] >= p.min_child) & (left[..., 2] > .5) & (right[..., 2] > .5)
            gain = (left[..., 0] ** 2 / (left[..., 1] + p.l2) + right[..., 0] ** 2 / (right[..., 1] + p.l2)
                    - total[0] ** 2 / (total[1] + p.l2))
            gain = np.where(ok, gain, -np.inf)
            best = int(np.argmax(gain))
            f, b = divmod(best, gain.shape[1])
            if not gain[f, b] > 1e-12:
                continue
            self.feature[n], self.cut[n] = self.columns[f], b
            self.gain[self.columns[f]] = self.gain.get(self.columns[f], 0.0) + float(gain[f, b])
            self._close(2 * n + 1, left[f, b])
            self._close(2 * n + 2, right[f, b])
            children += [2 * n + 1, 2 * n + 2]
        self.hist, self.open = hists, children

    def _close(self, n: int, sums: np.ndarray) -> None:
        g, h, rows = (float(s) for s in sums)
        self.sums[n] = (g, h, rows)
        self.value[n], self.cover[n] = -self.p.rate * g / (h + self.p.l2), rows


def _joint_columns(codes: np.ndarray, columns: list[int], bins: int) -> list[tuple[list[int], list[int]]]:
    """Groups of columns that are counted by one code each, and the columns' numbers of bins: columns of few bins
    share a group while it has ``JOINT_CELLS`` cells at most. Few rows are counted column by column."""
    if codes.shape[1] < JOINT_ROWS:
        return [([c], [bins]) for c in columns]
    groups: list[tuple[list[int], list[int]]] = []
    for size, c in sorted((int(codes[c].max()) + 1, c) for c in columns):
        if groups and math.prod(groups[-1][1]) * size <= JOINT_CELLS:
            groups[-1][0].append(c)
            groups[-1][1].append(size)
        else:
            groups.append(([c], [size]))
    return groups


def _joint_codes(codes: np.ndarray, groups: list[tuple[list[int], list[int]]]) -> list[np.ndarray]:
    """Each group's code of the columns of ``codes`` (features x rows)."""
    out = []
    for members, sizes in groups:
        joint = codes[members[0]]
        for c, size in zip(members[1:], sizes[1:]):
            joint = joint.astype(np.uint16) * np.uint16(size) + codes[c]
        out.append(joint)
    return out


class _Chunk:
    """Some rows of a fit that one task grows, few enough for a core's cache."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, hashes: np.ndarray, groups: list):
        self.codes, self.y, self.hashes, self.joint = codes, y, hashes, _joint_codes(codes, groups)
        self.margin = np.zeros(len(y))

    def begin(self, number: int, tree: int, p: BoostParams, weight: float) -> None:
        """A tree's sample, gradients and root."""
        self.used = _draw(self.hashes, number, tree, p.seed) < p.rows
        self.g, self.h = _gradients(self.margin, self.y, self.used, weight)
        self.node = np.zeros(len(self.y), np.min_scalar_type(2 ** (p.depth + 1)))

    def count(self, wanted: list[int], counted: dict[int, np.ndarray], sizes: list[int]) -> None:
        """Add the wanted nodes' sums of g, h and rows to the cells of the groups in ``counted``."""
        place = np.full(2 ** 16 if self.node.dtype.itemsize > 1 else 2 ** 8, -1, np.int64)
        place[wanted] = np.arange(len(wanted))
        at = place.take(self.node)
        rows = np.flatnonzero((at >= 0) & self.used)
        if not len(rows):
            return
        at, g, h = at[rows], self.g[rows], self.h[rows]
        for k, total in counted.items():
            index, size = at * sizes[k] + self.joint[k][rows], len(wanted) * sizes[k]
            for n, values in enumerate((g, h, None)):
                total[n] += np.bincount(index, values, size)


def _grow_chunks(chunks: list[_Chunk], groups: list, number: int, fit: Fit, p: BoostParams) -> list[_Tree]:
    """All trees of one fit over rows that one task holds."""
    trees, sizes = [], [math.prod(sizes) for _, sizes in groups]
    for t in range(p.trees):
        tree = _Tree(p, sampled_columns(fit, number, t, p))
        for chunk in chunks:
            chunk.begin(number, t, p, fit.weight)
        for level in range(p.depth):
            if not tree.open:
                break
            wanted = tree.wanted()
            counted = {k: np.zeros((3, len(wanted) * sizes[k])) for k, (members, _) in enumerate(groups)
                       if not set(members).isdisjoint(tree.columns)}
            for chunk in chunks:
                chunk.count(wanted, counted, sizes)
            hist = np.zeros((len(wanted), len(tree.columns), p.bins, 3))
            for k, total in counted.items():
                members, shape = groups[k]
                cells = total.reshape(3, len(wanted), *shape)
                for c in members:
                    if c in tree.columns:
                        others = tuple(2 + i for i, m in enumerate(members) if m != c)
                        sums = cells.sum(axis=others) if others else cells
                        hist[:, tree.columns.index(c), :sums.shape[2]] = np.moveaxis(sums, 0, -1)
            tree.split(dict(zip(wanted, hist)))
            for chunk in chunks:
                chunk.node = _step(chunk.codes, chunk.node, tree.feature, tree.cut)
        for chunk in chunks:
            chunk.margin += tree.value[chunk.node]
        tree.hist = {}
        trees.append(tree)
    return trees


def _grow_fit(codes, y, hashes, number: int, fit: Fit, p: BoostParams) -> list[_Tree]:
    """All trees of one fit; the rows are put into an order that doesn't depend on where they come from."""
    order, groups = np.lexsort((y, hashes)), _joint_columns(codes, fit.features, p.bins)
    cuts = [order[lo:lo + CHUNK_ROWS] for lo in range(0, len(order), CHUNK_ROWS)]
    chunks = [_Chunk(codes.take(rows, axis=1), y[rows], hashes[rows], groups) for rows in cuts]
    del codes, y, hashes, order, cuts
    return _grow_chunks(chunks, groups, number, fit, p)


# ---------------------------------------------------------------- Spark
def quantile_cuts(df: DataFrame, features: list[str], bins: int = 256) -> list[np.ndarray]:
    """At most ``bins - 1`` rising cuts per feature; a value's bin is the number of cuts below it.
    One pass over all columns; 64 columns at a time keep the sketches of a task small."""
    out, probabilities = [], [k / (bins - 1) for k in range(bins)]
    for lo in range(0, len(features), 64):
        part = features[lo:lo + 64]
        for q in df.approxQuantile([f"`{f}`" for f in part], probabilities, CUT_ERROR):
            out.append(np.unique(np.array(q, float))[:-1])
    return out


def _blocks(rows: DataFrame, features: list[str], cuts: list[np.ndarray], n_fits: int) -> DataFrame:
    """``rows(features.., y, fits, hash)`` as blocks of byte matrices, one fit's rows each: ``fit, n, codes, y, hash``."""
    def pack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                codes = np.stack([np.searchsorted(c, part.column(k).to_numpy(zero_copy_only=False), "left")
                                  for k, c in enumerate(cuts)]).astype(np.uint8)
                y, fits, h = (part.column(len(cuts) + k).to_numpy(zero_copy_only=False) for k in range(3))
                for fit in range(n_fits):
                    mine = np.flatnonzero((fits >> fit) & 1)
                    if len(mine):
                        yield pa.record_batch([pa.array([fit], pa.int64()), pa.array([len(mine)], pa.int64()),
                                               pa.array([codes[:, mine].tobytes()]),
                                               pa.array([y[mine].astype(np.uint8).tobytes()]),
                                               pa.array([h[mine].astype(np.int64).tobytes()])],
                                              names=["fit", "n", "codes", "y", "hash"])
    return rows.select(*[f"`{f}`" for f in features], "y", "fits", "hash").mapInArrow(
        pack, "fit long, n long, codes binary, y binary, hash binary")


def _views(block) -> tuple:
    fit, n, codes, y, hashes = block[:5]
    return (fit, np.frombuffer(codes, np.uint8).reshape(-1, n), np.frombuffer(y, np.uint8).astype(float),
            np.frombuffer(hashes, np.int64))


def _merged(part):
    """The blocks of a partition, those of a fit joined up to ``BLOCK_ROWS`` rows or more, with margins of 0."""
    held: dict[int, list] = {}

    def joined(blocks):
        fit, n = blocks[0][0], sum(b[1] for b in blocks)
        codes = np.concatenate([_views(b)[1] for b in blocks], axis=1)
        return fit, n, codes.tobytes(), *(b"".join(b[i] for b in blocks) for i in (3, 4)), np.zeros(n).tobytes()
    for block in part:
        mine = held.setdefault(block[0], [])
        mine.append(block)
        if sum(b[1] for b in mine) >= BLOCK_ROWS:
            yield joined(held.pop(block[0]))
    yield from map(joined, held.values())


def _grow_levels(blocks: DataFrame, fits: list[Fit], p: BoostParams) -> list[list[_Tree]]:
    """All trees of all fits, one pass over the blocks per level."""
    state = blocks.rdd.mapPartitions(_merged).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    done: list[list[_Tree]] = [[] for _ in fits]
    for t in range(p.trees):
        trees = [_Tree(p, sampled_columns(f, k, t, p)) for k, f in enumerate(fits)]
        for level in range(p.depth):
            asked = {k: (tree.wanted(), tree.feature, tree.cut, tree.columns) for k, tree in enumerate(trees) if tree.open}
            if not asked:
                break

            def count(part, asked=asked, t=t, level=level):
                total: dict = {}
                for block in part:
                    k = block[0]
                    if k not in asked:
                        continue
                    wanted, feature, cut, columns = asked[k]
                    _, codes, y, hashes = _views(block)
                    rows = np.flatnonzero(_draw(hashes, k, t, p.seed) < p.rows)
                    if not len(rows):
                        continue
                    codes, every = codes[:, rows], np.ones(len(rows), bool)
                    g, h = _gradients(np.frombuffer(block[5])[rows], y[rows], every, fits[k].weight)
                    hist = _histogram(codes, _descend(codes, feature, cut, level), wanted, g, h, every, columns, p.bins)
                    total[k] = total[k] + hist if k in total else hist
                yield total

            def add(a, b):
                for k, hist in b.items():
                    a[k] = a[k] + hist if k in a else hist
                return a
            counted = state.mapPartitions(count).treeReduce(add)
            if before is not None:  # the first pass of a tree has cached its state
                before.unpersist()
                before = None
            for k, (wanted, _, _, columns) in asked.items():
                hist = counted.get(k, np.zeros((len(wanted), len(columns), p.bins, 3)))
                trees[k].split(dict(zip(wanted, hist)))
        grown = []
        for k, tree in enumerate(trees):
            tree.hist = {}
            done[k].append(tree)
            grown.append((tree.feature, tree.cut, tree.value))

        def grow(block, grown=grown):
            k, codes, _, _ = _views(block)
            feature, cut, value = grown[k]
            return (*block[:5], (np.frombuffer(block[5]) + value[_descend(codes, feature, cut, p.depth)]).tobytes())
        if t + 1 < p.trees:
            before, state = state, state.map(grow).persist(StorageLevel.MEMORY_AND_DISK)
            if (t + 1) % REFRESH == 0:
                state.checkpoint()
    state.unpersist()
    return done


def _grow_alone(blocks: DataFrame, fits: list[Fit], p: BoostParams, sizes: list[int]) -> list[list[_Tree]]:
    """Each fit in a task of its own; for fits of a bounded number of rows (``rows_per_task`` of ``boost``).
    ``sizes``: the fits' rows."""
    def grow(part):
        held, filled, k = None, 0, 0
        for block in part:
            k, *views = _views(block)
            if held is None:
                held = [np.empty((*v.shape[:-1], sizes[k]), np.uint8 if v.dtype == float else v.dtype) for v in views]
            n = views[-1].shape[-1]
            for to, view in zip(held, views):
                to[..., filled:filled + n] = view
            filled += n
        if held is not None:
            data, held = held, None
            yield k, _grow_fit(data.pop(0), data.pop(0), data.pop(0), k, fits[k], p)
    # the largest fits first, as there may be fewer cores than fits
    place = np.argsort(np.argsort([-n for n in sizes], kind="stable")).tolist()
    dealt = blocks.repartitionById(len(fits), F.element_at(F.array(*[F.lit(n) for n in place]), (F.col("fit") + 1).cast("int")))
    grown = dict(dealt.rdd.mapPartitions(grow).collect())
    return [grown.get(k, []) for k in range(len(fits))]


def boost(rows: DataFrame, features: list[str], fits: list[Fit], params: BoostParams | None = None,
          rows_per_task: int | None = None) -> list[BoostedTrees]:
    """Fit all ``fits`` on ``rows(features.., y, fits, hash)``: ``fits`` is a bit mask of the fits that learn from a
    row, ``hash`` decides what samples it is in. A feature may be null where no fit of the row uses it. At most 62 fits.
    Fits of at most ``rows_per_task`` rows (what ``ROWS_PER_TASK`` and ``BYTES_PER_TASK`` allow) grow in a task each.

    A fit without rows, or with rows of one class only and nothing to split, is a model of margin 0 or of roots.
    """
    p = params or BoostParams()
    if len(fits) > 62:
        raise ValueError("a run holds at most 62 fits")
    if rows_per_task is None:
        rows_per_task = min(ROWS_PER_TASK, BYTES_PER_TASK // max(1, len(features)))
    ensure_checkpoint_dir(rows.sparkSession)
    mask = [F.count_if(F.col("fits").bitwiseAND(F.lit(1 << k).cast("long")) != 0) for k in range(len(fits))]
    with ThreadPoolExecutor(1) as pool:  # two passes that don't wait for each other
        counted = pool.submit(inheritable_thread_target(rows.sparkSession)(
            lambda: rows.agg(*[m.alias(f"n{k}") for k, m in enumerate(mask)]).first() or [0]))
        cuts = quantile_cuts(rows, features, p.bins)
        sizes = counted.result()
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(sum(sizes) / ROWS_PER_PARTITION))
    blocks = _blocks(rows, features, cuts, len(fits)).repartition(parts).checkpoint()
    grown = _grow_alone(blocks, fits, p, list(sizes)) if max(sizes) <= rows_per_task else _grow_levels(blocks, fits, p)
    return [_model(trees, fit, features, cuts, p) for trees, fit in zip(grown, fits)]


def _model(trees: list[_Tree], fit: Fit, features: list[str], cuts: list[np.ndarray], p: BoostParams) -> BoostedTrees:
    place = {f: k for k, f in enumerate(fit.features)}
    n = 2 ** (p.depth + 1) - 1
    shape = (len(trees), n)
    feature, threshold = np.full(shape, -1, np.int64), np.zeros(shape)
    gain: dict[str, float] = {}
    for t, tree in enumerate(trees):
        for i in np.flatnonzero(tree.feature >= 0):
            f = int(tree.feature[i])
            feature[t, i], threshold[t, i] = place[f], cuts[f][tree.cut[i]]
        for f, x in tree.gain.items():
            gain[features[f]] = gain.get(features[f], 0.0) + x
    value = np.array([tree.value for tree in trees]).reshape(shape)
    cover = np.array([tree.cover for tree in trees]).reshape(shape)
    return BoostedTrees([features[f] for f in fit.features], feature, threshold, value, cover, {"gain": gain})
