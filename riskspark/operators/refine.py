"""Exact order statistics of wide tables by histogram refinement.

A double is an ordered 64-bit key. One pass counts, for each column, how many rows
of either label fall into a fixed number of equal key ranges; ranges that can still
hold what is asked for are cut again in the next pass, until a range holds one
value. Tasks send histograms only (at most ``MOST_BINS`` cells in a pass), so no
value is shuffled and no column is sorted, however many rows and columns there are.

* ranks (medians, equal-frequency borders): the ranges that hold the ranks;
* KS: the ranges in which the difference of the two running shares can exceed
  the best one seen at a range border.

The number of passes depends on the bits that tell neighbouring values apart:
two or three for measured data, seven at most. Ranges beyond the budget wait for the next pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.session import ensure_checkpoint_dir

#: Cells of all histograms of a pass, and the most of one range.
MOST_BINS, RANGE_BINS = 1 << 20, 1 << 10
_FLIP = np.int64(0x7FFFFFFFFFFFFFFF)
_LOW, _HIGH = -(2 ** 63), 2 ** 63 - 1


def to_key(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers of the same order (-0.0 is 0.0)."""
    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ _FLIP, bits)


def from_key(key: int) -> float:
    k = np.int64(key)
    return float((k ^ _FLIP if k < 0 else k).view(np.float64))


@dataclass
class Range:
    """Keys ``low..high`` of a column that are asked for, with the rows of either label below them."""

    column: int
    low: int
    high: int
    pos: int = 0
    neg: int = 0
    ranks: tuple[int, ...] = ()


@dataclass
class Cells:
    """Non-empty cells of a range, rising: rows of either label, smallest and largest key."""

    pos: np.ndarray
    neg: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Table:
    """Columns of a wide table and its label. Tasks get the columns that are asked for as one array, written as
    one SQL expression: thousands of separate columns make analysis and planning slow."""

    df: DataFrame
    features: list[str]
    y: str = "y"

    def rows(self, columns: list[int]) -> DataFrame:
        names = [self.features[c].replace("`", "``") for c in columns]
        values = ", ".join(f"cast(`{f}` as double)" for f in names)
        label = self.y.replace("`", "``")
        return self.df.selectExpr(f"cast(array({values}) as array<double>) as x", f"(`{label}` <=> 1) as positive")


def _batches(batches, width: int):
    """(matrix with a row per column, which rows have label 1) of each Arrow batch; NULL is NaN."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            yield x.reshape(-1, width).T, batch.column(1).to_numpy(zero_copy_only=False).astype(bool)


def _keys(x: np.ndarray, fill: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a column and which rows count; NaN is NULL, NULL is ``fill`` where given."""
    null = np.isnan(x)
    if fill is not None:
        return to_key(np.where(null, fill, x)), np.ones(len(x), bool)
    return to_key(x), ~null


def count_ranges(data: Table, asked: list[Range], fills: list[float] | None = None) -> list[Cells]:
    """One pass over ``data``: the cells of each range. Ranges of a column don't overlap."""
    per_range = min(RANGE_BINS, max(4, 1 << int(math.log2(MOST_BINS / max(1, len(asked))))))
    columns = sorted({r.column for r in asked})
    place = {c: k for k, c in enumerate(columns)}
    groups = []
    for c in columns:
        mine = sorted((r.low, r.high, i) for i, r in enumerate(asked) if r.column == c)
        low, high, index = (np.array(v, np.int64) for v in zip(*mine))
        width = high.view(np.uint64) - low.view(np.uint64)
        shift = np.array([max(0, int(w).bit_length() - int(math.log2(per_range))) for w in width], np.uint64)
        groups.append((place[c], None if fills is None else fills[c], low, high, index, shift))

    def count(batches):
        cells: dict = {}
        for x, positive in _batches(batches, len(columns)):
            for k, fill, low, high, index, shift in groups:
                key, some = _keys(x[k], fill)
                r = np.searchsorted(low, key, "right") - 1
                rows = np.flatnonzero(some & (r >= 0) & (key <= high[r]))
                if not len(rows):
                    continue
                key, r = key[rows], r[rows]
                cell = r * per_range + ((key.view(np.uint64) - low[r].view(np.uint64)) >> shift[r]).astype(np.int64)
                if k not in cells:
                    n = len(low) * per_range
                    cells[k] = (np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, _HIGH), np.full(n, _LOW))
                pos, neg, least, most = cells[k]
                pos += np.bincount(cell[positive[rows]], minlength=len(pos))
                neg += np.bincount(cell[~positive[rows]], minlength=len(neg))
                np.minimum.at(least, cell, key)
                np.maximum.at(most, cell, key)
        for k, _, low, high, index, shift in groups:
            if k in cells:
                pos, neg, least, most = cells[k]
                full = np.flatnonzero(pos + neg)
                yield pa.record_batch([pa.array(index[full // per_range]), pa.array(full % per_range), pa.array(pos[full]),
                                       pa.array(neg[full]), pa.array(least[full]), pa.array(most[full])],
                                      names=["range", "cell", "pos", "neg", "low", "high"])
    counted = (data.rows(columns).mapInArrow(count, "range long, cell long, pos long, neg long, low long, high long")
               .groupBy("range", "cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                                             F.min("low").alias("low"), F.max("high").alias("high")).toArrow())
    of, cell, pos, neg, low, high = (counted.column(c).to_numpy() for c in ("range", "cell", "pos", "neg", "low", "high"))
    order = np.lexsort((cell, of))
    bounds = np.searchsorted(of[order], np.arange(len(asked) + 1))
    return [Cells(*[v[order[a:b]] for v in (pos, neg, low, high)]) for a, b in zip(bounds, bounds[1:])]


def _passes(data: Table, asked: list[Range], fills, take: Callable[[Range, Cells], list[Range]]) -> None:
    """Count the ranges and let ``take`` name those to cut again, until none is left."""
    most = MOST_BINS // 4
    while asked:
        now, later = asked[:most], asked[most:]
        asked = [new for r, cells in zip(now, count_ranges(data, now, fills)) for new in take(r, cells)] + later


def rank_values(data: Table, n_columns: int, ranks: Callable[[int, int], list[int]],
                fills: list[float] | None = None, only: list[int] | None = None) -> dict[int, dict[int, tuple]]:
    """For each column the values at the ranks (from 1) that ``ranks(column, rows)`` names: rank to
    (value, rows of label 1 up to the value, other rows up to it)."""
    found: dict[int, dict[int, tuple]] = {c: {} for c in (range(n_columns) if only is None else only)}
    totals: dict[int, int] = {}

    def take(r: Range, cells: Cells) -> list[Range]:
        upto = r.pos + r.neg + np.cumsum(cells.pos + cells.neg)
        if r.column not in totals:  # the first pass
            totals[r.column] = int(upto[-1]) if len(upto) else 0
            r.ranks = tuple(ranks(r.column, totals[r.column]))
        pos, neg = r.pos + np.cumsum(cells.pos), r.neg + np.cumsum(cells.neg)
        again: dict[int, list[int]] = {}
        for rank in r.ranks:
            k = int(np.searchsorted(upto, rank))
            if cells.low[k] == cells.high[k]:
                found[r.column][rank] = (from_key(cells.low[k]), int(pos[k]), int(neg[k]))
            else:
                again.setdefault(k, []).append(rank)
        return [Range(r.column, int(cells.low[k]), int(cells.high[k]), int(pos[k] - cells.pos[k]),
                      int(neg[k] - cells.neg[k]), tuple(v)) for k, v in again.items()]
    _passes(data, [Range(c, _LOW, _HIGH) for c in found], fills, take)
    return found


def medians(df: DataFrame, features: list[str], y: str = "y") -> dict[str, float]:
    """Exact median of each column (mean of the two middle values; NULLs skipped; 0.0 without values)."""
    found = rank_values(Table(df, features, y), len(features),
                        lambda c, n: sorted({(n - 1) // 2 + 1, n // 2 + 1}) if n else [])
    out = {}
    for c, f in enumerate(features):
        values = [found[c][r][0] for r in sorted(found[c])]
        out[f] = (values[0] + values[-1]) / 2.0 if values else 0.0
    return out


def ks_statistics(df: DataFrame, features: list[str], y: str = "y") -> dict[str, float | None]:
    """Exact two-sample KS of each column, None where either class has fewer than two values."""
    totals: dict[int, tuple[int, int]] = {}
    best = dict.fromkeys(range(len(features)), 0.0)

    def take(r: Range, cells: Cells) -> list[Range]:
        pos, neg = r.pos + np.cumsum(cells.pos), r.neg + np.cumsum(cells.neg)
        if r.column not in totals:
            totals[r.column] = (int(pos[-1]), int(neg[-1])) if len(pos) else (0, 0)
        n_pos, n_neg = totals[r.column]
        if n_pos < 2 or n_neg < 2 or not len(pos):
            return []
        best[r.column] = max(best[r.column], float(np.abs(pos / n_pos - neg / n_neg).max()))
        # inside a range the difference is largest if all its rows of one label come first
        first_pos = pos / n_pos - (neg - cells.neg) / n_neg
        first_neg = neg / n_neg - (pos - cells.pos) / n_pos
        open_ = (cells.low < cells.high) & (np.maximum(first_pos, first_neg) > best[r.column])
        return [Range(r.column, int(cells.low[k]), int(cells.high[k]), int(pos[k] - cells.pos[k]),
                      int(neg[k] - cells.neg[k])) for k in np.flatnonzero(open_)]
    _passes(Table(df, features, y), [Range(c, _LOW, _HIGH) for c in range(len(features))], None, take)
    return {f: best[c] if min(totals[c]) > 1 else None for c, f in enumerate(features)}


def few_values(data: Table, n_columns: int, most: int, fills: list[float] | None = None) -> dict[int, list[tuple]]:
    """Columns of at most ``most`` distinct values: (value, rows of label 1, other rows), rising. A task drops a
    column as soon as it has seen more, so it sends at most ``most`` rows per column."""
    def count(batches):
        seen: dict[int, dict] = {k: {} for k in range(n_columns)}
        for x, positive in _batches(batches, n_columns):
            for k in [k for k, values in seen.items() if values is not None]:
                key, some = _keys(x[k], None if fills is None else fills[k])
                distinct, place = np.unique(key[some], return_inverse=True)
                values = seen[k]
                if len(distinct) > most or len(values.keys() | set(distinct.tolist())) > most:
                    seen[k] = None
                    continue
                pos = np.bincount(place[positive[some]], minlength=len(distinct))
                for v, p, n in zip(distinct.tolist(), pos.tolist(), np.bincount(place, minlength=len(distinct)).tolist()):
                    had = values.get(v, (0, 0))
                    values[v] = (had[0] + p, had[1] + n - p)
        rows = [(k, x, p, n) for k, values in seen.items() if values for x, (p, n) in values.items()]
        rows += [(k, None, 0, 0) for k, values in seen.items() if values is None]
        if rows:
            k, x, p, n = zip(*rows)
            yield pa.record_batch([pa.array(k, pa.int64()), pa.array(x, pa.int64()), pa.array(p, pa.int64()),
                                   pa.array(n, pa.int64())], names=["col", "key", "pos", "neg"])
    merged = (data.rows(list(range(n_columns))).mapInArrow(count, "col long, key long, pos long, neg long").groupBy("col", "key")
              .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    # tasks may have met different values: a column is dropped again where they add up to more
    small = merged.groupBy("col").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("key").isNull()).alias("many"))
    small = small.where(~F.col("many") & (F.col("n") <= most)).select(F.col("col").alias("_col"))
    kept = merged.join(F.broadcast(small), F.col("col") == F.col("_col"))  # a row per column
    out: dict[int, list[tuple]] = {}
    for r in kept.orderBy("col", "key").collect():
        out.setdefault(r["col"], []).append((from_key(r["key"]), r["pos"], r["neg"]))
    return out


def label_information(df: DataFrame, features: list[str], fills: dict[str, float], y: str = "y", n_bins: int = 20,
                      discrete_max: int = 10) -> dict[str, float]:
    """Plug-in mutual information (nats) of each column with the label, NULLs as ``fills`` says.

    A column of at most ``discrete_max`` values has a bin per value, any other ``n_bins`` bins of equal frequency:
    a value's bin is ``floor(rows below * n_bins / rows)``, so equal values share a bin.
    """
    ensure_checkpoint_dir(df.sparkSession)
    data, fill = Table(df, features, y), [fills.get(f, 0.0) for f in features]
    few = few_values(data, len(features), discrete_max, fill)
    many = [c for c in range(len(features)) if c not in few]

    def borders(c: int, n: int) -> list[int]:
        return sorted({*(-(-k * n // n_bins) for k in range(1, n_bins)), n} - {0}) if n else []
    found = rank_values(data, len(features), borders, fill, many) if many else {}
    out = {}
    for c, f in enumerate(features):
        if c in few:
            cells = [(p, n) for _, p, n in few[c]]
        else:
            upto = [(0, 0), *[found[c][r][1:] for r in sorted(found[c])]]
            cells = [(b[0] - a[0], b[1] - a[1]) for a, b in zip(upto, upto[1:])]
        totals = [sum(x) for x in zip(*cells)] or [0, 0]
        n, info = sum(totals), 0.0
        for cell in cells:
            for k in (0, 1):
                if cell[k]:
                    info += cell[k] / n * math.log(cell[k] * n / (sum(cell) * totals[k]))
        out[f] = info
    return out


def flag_counts(df: DataFrame, features: list[str], y: str = "y") -> dict[str, tuple[int, int]]:
    """Rows of label 1 and other rows with a value of at least 1, per column, in one pass."""
    at_least_one = int(to_key(np.array([1.0]))[0])
    cells = count_ranges(Table(df, features, y), [Range(c, at_least_one, _HIGH) for c in range(len(features))])
    return {f: (int(x.pos.sum()), int(x.neg.sum())) for f, x in zip(features, cells)}
