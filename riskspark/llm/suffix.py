"""Suffix-array dedup: bytes covered by a 50-byte string of an earlier document.

Windows that may be shared meet in buckets (see ``windows``). There the suffixes
that begin at them are sorted, some bytes a round; suffixes that agree so far and
whose prefix polynomial hashes agree need no more rounds. Neighbours that the
hashes call equal are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.arrays import PrefixHash, Texts
from riskspark.llm.windows import Plan, Units, byte_units, covered_by_earlier

WINDOW, GRAM = 50, 20


def common_prefix(prefix: PrefixHash, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Length, up to ``limit``, of the common prefix of the suffixes at ``a`` and ``b``."""
    sums, down = prefix.sums, prefix.down
    sum_a, down_a, sum_b, down_b = sums[a], down[a], sums[b], down[b]
    length = np.zeros(len(a), np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        longer = np.minimum(length + step, limit)
        same = (sums[a + longer] - sum_a) * down_a == (sums[b + longer] - sum_b) * down_b
        length = np.where(same, longer, length)
        step >>= 1
    return length


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number that sorts like them (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))


def merge_sort(data: np.ndarray, prefix: PrefixHash, at: np.ndarray, segment: np.ndarray,
               limit: int) -> np.ndarray:
    """Order of the suffixes ``at`` by segment (small numbers, 0 or more), then by their first ``limit`` bytes.

    Most significant bytes first: a round sorts by the group so far and as many of
    the next bytes as fit a 64-bit number beside it. Suffixes still alike go
    through another round, unless prefix hashes call all of them equal.
    """
    words, hashes = _words(data), prefix.of(at, at + limit)
    order = np.arange(len(at))
    slots, group, done = order.copy(), segment, 0
    while len(slots) and done < limit:
        n = min(8 - -(-int(group.max()).bit_length() // 8), limit - done)
        key = words[at[order[slots]] + done].astype(np.uint64) >> np.uint64(64 - 8 * n)
        key |= group.astype(np.uint64) << np.uint64(8 * n)
        sort = np.argsort(key)
        order[slots] = order[slots][sort]
        key, h = key[sort], hashes[order[slots]]
        tied = key[1:] == key[:-1]
        run = np.concatenate([[0], np.cumsum(~tied)])
        mixed = np.zeros(int(run[-1]) + 1, bool)
        mixed[run[1:][tied & (h[1:] != h[:-1])]] = True
        left = mixed[run]
        slots, group = slots[left], (np.cumsum(mixed) - 1)[run[left]]
        done += n
    return order


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether the ``limit`` bytes (eight or more) at ``a`` and at ``b`` are the same."""
    words, equal = _words(data), np.ones(len(a), bool)
    for k in [*range(0, limit - 8, 8), limit - 8]:
        equal &= words[a + k] == words[b + k]
    return equal


def equal_windows(units: Units, win: np.ndarray, family: np.ndarray, window: int) -> np.ndarray:
    """Group numbers of the windows at ``win``; equal windows alike (and of one family)."""
    prefix = PrefixHash(units.codes)
    order = merge_sort(units.data, prefix, win, family, window)
    a, b = win[order[:-1]], win[order[1:]]
    value, sorted_family = prefix.of(win, win + window)[order], family[order]
    same = (value[1:] == value[:-1]) & (sorted_family[1:] == sorted_family[:-1])
    near = np.flatnonzero(same)
    group = np.empty(len(win), np.int64)
    if not same_bytes(units.data, a[near], b[near], window).all():
        # two strings of one hash: group by the strings themselves
        known: dict[bytes, int] = {}
        group[:] = [known.setdefault(units.data[w:w + window].tobytes(), len(known)) for w in win.tolist()]
        return group
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    return group


def _result(ids: pa.Array, texts: Texts, units: Units, covered: np.ndarray) -> pa.Table:
    names = ["doc_id", "n_bytes", "removed", "kept"]
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    if texts is None:
        return pa.table([ids, pa.array([], pa.int64()), pa.array([], pa.list_(span)), pa.array([], pa.binary())],
                        names=names)
    step = np.diff(covered.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    at = np.searchsorted(begin, np.append(texts.start, len(texts.data)))
    own = np.repeat(texts.start, np.diff(at))
    removed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(begin - own, pa.int64()), pa.array(end - own, pa.int64())], fields=list(span)))
    kept = [texts.data[s:e].tobytes() if a == b else texts.data[s:e][~covered[s:e]].tobytes()
            for s, e, a, b in zip(texts.start.tolist(), texts.end.tolist(), at[:-1].tolist(), at[1:].tolist())]
    return pa.table([ids, pa.array(texts.end - texts.start, pa.int64()), removed, pa.array(kept, pa.binary())],
                    names=names)


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove from ``docs(doc_id, text)`` each byte covered by a ``window``-byte string
    that also starts in a document with a smaller ``doc_id``.

    Returns, one row per input row, ``doc_id, n_bytes, removed`` (byte ranges
    ``start, end``, maximal, in order) and ``kept`` (the remaining bytes; a cut may
    split a character). Strings are judged on the input. Null text is empty; rows of
    one ``doc_id`` don't affect each other; a null ``doc_id`` is larger than any.
    Empty input gives no rows; other columns are ignored.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM} bytes")
    plan = Plan(byte_units, equal_windows, window, GRAM)
    return covered_by_earlier(
        docs, plan, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary", _result)


def removed_bytes(removed) -> F.Column:
    """Number of bytes in the ``removed`` ranges."""
    return F.aggregate(removed, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
