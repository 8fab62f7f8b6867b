"""Exact search for windows of text that also start in an earlier document.

Shared by substring dedup (windows of words) and suffix-array dedup (windows of
bytes). Consecutive windows with the same minimiser form a stretch. Documents
are dealt into batches of a few megabytes, the unit in which tasks work:

1. Each batch tells which minimisers it has (5 bytes each, dealt by hash); the
   answer, two bits each, says which occur in two documents or more, and which
   have very many windows.
2. Stretches with a shared minimiser travel as packed strings, equal ones of a
   batch once, to the bucket of their minimiser. Where a minimiser has very many
   windows its stretches are cut into single windows, dealt by their own hash,
   equal ones of a batch once, so no bucket grows with one passage.
3. A bucket groups equal windows exactly and answers each batch with the
   smallest document of each window.

Two equal windows have equal minimisers, so nothing is lost; hashes only deal
and pick candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.arrays import BYTE_CODE, PrefixHash, Texts, mix, ranges, sliding_min, text_pieces

#: Bytes of text in a batch; a task's memory is some tens of times this.
BATCH_BYTES = 4 << 20
#: Bytes of text whose units are in memory at once (or one longer document): few enough for a core's cache.
PIECE_BYTES = 1 << 17
#: From so many windows on, those of a minimiser are dealt one by one.
HOT_WINDOWS = 1 << 14
_KEY_BITS = 35
NO_ID = np.iinfo(np.int64).max


@dataclass
class Units:
    """Texts as sequences of units (words or bytes) in one normalised buffer."""

    data: np.ndarray
    start: np.ndarray   # bytes of each unit
    end: np.ndarray
    first: np.ndarray   # units of each text
    last: np.ndarray
    codes: np.ndarray


#: Words of this many bytes or more are not coded by a polynomial.
LONG_WORD = 256


def byte_units(texts: Texts) -> Units:
    at = np.arange(len(texts.data))
    return Units(texts.data, at, at + 1, texts.start, texts.end, BYTE_CODE[texts.data])


def word_units(texts: Texts) -> Units:
    """Words, one space after each."""
    starts, ends, first = texts.words()
    lengths = ends - starts
    joined = texts.data[ranges(starts, lengths + 1)] if len(starts) else texts.data[:0]
    at = np.cumsum(lengths + 1) - lengths - 1
    joined[at + lengths] = 32
    codes = mix(PrefixHash(BYTE_CODE[joined]).of(at, at + lengths)) if len(starts) else np.zeros(0, np.uint64)
    # polynomials over 64-bit integers agree on some long texts of two symbols, whatever the base
    for k in np.flatnonzero(lengths >= LONG_WORD):
        codes[k] = xxhash.xxh3_64_intdigest(joined[at[k]:at[k] + lengths[k]].tobytes())
    return Units(joined, at, at + lengths, first[:-1], first[1:], codes)


@dataclass(frozen=True)
class Plan:
    """What a window is: its size and the size of the grams that vie for minimiser, in units."""

    units: Callable[[Texts], Units]
    group: Callable[[Units, np.ndarray, np.ndarray, int], np.ndarray]
    window: int
    gram: int


@dataclass
class Stretches:
    text: np.ndarray     # index of the text
    first: np.ndarray    # first unit
    windows: np.ndarray  # number of windows
    value: np.ndarray    # the minimiser

    def hashes(self, prefix: PrefixHash, window: int) -> np.ndarray:
        return mix(prefix.of(self.first, self.first + self.windows - 1 + window))


def stretches(units: Units, plan: Plan) -> Stretches | None:
    """Maximal runs of windows with one minimiser; none if no text has a window."""
    counts = np.maximum(units.last - units.first - plan.window + 1, 0)
    some = np.flatnonzero(counts)
    if not len(some):
        return None
    low = sliding_min(mix(PrefixHash(units.codes).each(plan.gram)), plan.window - plan.gram + 1)
    # places where windows begin or end, or the minimiser changes
    first, stop = units.first[some], units.first[some] + counts[some]
    border = np.concatenate([[True], low[1:] != low[:-1], [True]])
    border[first] = border[stop] = True
    cut = np.flatnonzero(border)
    cut, size = cut[:-1], np.diff(cut)
    text = np.searchsorted(first, cut, "right") - 1
    inside = np.flatnonzero((text >= 0) & (cut < stop[text]))
    cut = cut[inside]
    return Stretches(some[text[inside]], cut, size[inside], low[cut])


def _deal(value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and key within the bucket of a hash (minima are small numbers, so mixed again)."""
    h = mix(value ^ np.uint64(0x5851F42D4C957F2D))
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return bucket, (h << np.uint64(bits)) >> np.uint64(64 - _KEY_BITS)


def _pieces(docs: pa.Table) -> Iterator[tuple[np.ndarray, Texts]]:
    ids = docs.column("id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
    for piece in text_pieces(docs.column("text"), PIECE_BYTES):
        yield ids[piece.lo:piece.hi], piece


@dataclass
class _Census:
    """A batch's stretches by piece with their places among its distinct (bucket, key) in order:
    in two documents of the batch or more, and how many windows."""

    pieces: list[tuple[Stretches, np.ndarray] | None]
    bucket: np.ndarray
    key: np.ndarray
    several: np.ndarray
    count: np.ndarray


def _joint(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (bucket.astype(np.uint64) << np.uint64(_KEY_BITS)) | key


def _census(docs: pa.Table, plan: Plan, bits: int) -> _Census:
    pieces = [stretches(plan.units(piece), plan) for _, piece in _pieces(docs)]
    some = [(n, p) for n, p in enumerate(pieces) if p]
    if not some:
        return _Census([None] * len(pieces), *[np.zeros(0, t) for t in (np.int64, np.uint64, bool, np.int64)])
    joint = np.concatenate([_joint(*_deal(p.value, bits)) for _, p in some])
    owner = np.concatenate([p.text + (n << 32) for n, p in some])
    windows = np.concatenate([p.windows for _, p in some])
    order = np.argsort(joint)
    joint, owner, windows = joint[order], owner[order], windows[order]
    new = np.concatenate([[True], joint[1:] != joint[:-1]])
    at, place = np.flatnonzero(new), np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    ends = np.cumsum([len(p.value) for _, p in some])
    placed: list = [None] * len(pieces)
    for (n, p), lo, hi in zip(some, [0, *ends], ends):
        placed[n] = p, place[lo:hi]
    several = np.minimum.reduceat(owner, at) < np.maximum.reduceat(owner, at)
    joint, count = joint[at], np.add.reduceat(windows, at)
    return _Census(placed, (joint >> np.uint64(_KEY_BITS)).astype(np.int64),
                   joint & np.uint64((1 << _KEY_BITS) - 1), several, count)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket of a sorted array with its range."""
    if len(bucket):
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for lo, hi in zip(at.tolist(), np.append(at[1:], len(bucket)).tolist()):
            yield int(bucket[lo]), lo, hi


def _rows(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, t) for c, t in zip(columns, schema.values())], names=list(schema))


_MESSAGE = {"batch": pa.int64(), "bucket": pa.int64(), "kind": pa.int32(), "body": pa.binary()}
MESSAGE = "batch long, bucket long, kind int, body binary"
_FLAGS, _FOUND = 0, 1


def _packed(key: np.ndarray, several: np.ndarray, count: np.ndarray) -> bytes:
    """Five bytes a key: 35 bits, one for several documents, four for the logarithm of the count."""
    size = np.minimum(np.log2(count).astype(np.uint64), np.uint64(15))
    both = (key << np.uint64(5)) | (several.astype(np.uint64) << np.uint64(4)) | size
    return both.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, documents (1 or 2: several) and windows (rounded down to a power of two)."""
    raw = np.zeros((len(body) // 5, 8), np.uint8)
    raw[:, :5] = np.frombuffer(body, np.uint8).reshape(-1, 5)
    both = raw.view("<u8").ravel()
    return (both >> np.uint64(5), 1 + (both >> np.uint64(4) & np.uint64(1)).astype(np.int64),
            np.int64(1) << (both & np.uint64(15)).astype(np.int64))


def _tell(plan: Plan, bits: int):
    def run(docs: pa.Table) -> pa.Table:
        census = _census(docs, plan, bits)
        batch = docs.column("batch")[0].as_py()
        return _rows(_MESSAGE, [
            (batch, b, 0, _packed(census.key[lo:hi], census.several[lo:hi], census.count[lo:hi]))
            for b, lo, hi in _cuts(census.bucket)])
    return run


def _count(bucket_rows: pa.Table) -> pa.Table:
    """For each batch's keys, two bits each: in two documents or more, very many windows."""
    parts = [_unpacked(b) for b in bucket_rows.column("body").to_pylist()]
    key, documents, count = (np.concatenate(p) for p in zip(*parts))
    _, at = np.unique(key, return_inverse=True)
    flags = np.stack([np.bincount(at, weights=documents)[at] >= 2,
                      np.bincount(at, weights=count)[at] >= HOT_WINDOWS], axis=1)
    rows, lo = [], 0
    bucket = bucket_rows.column("bucket")[0].as_py()
    for batch, (k, _, _) in zip(bucket_rows.column("batch").to_pylist(), parts):
        rows.append((batch, bucket, _FLAGS, np.packbits(flags[lo:lo + len(k)].ravel()).tobytes()))
        lo += len(k)
    return _rows(_MESSAGE, rows)


class _Shared:
    """The stretches of a batch whose minimiser is shared, from the answers to its census."""

    def __init__(self, docs: pa.Table, answers: pa.Table, plan: Plan, bits: int):
        self._census = census = _census(docs, plan, bits)
        self._flags = np.zeros((len(census.key), 2), bool)
        body = {b: x for b, k, x in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "body")))
                if k == _FLAGS}
        for b, lo, hi in _cuts(census.bucket):
            bits_of = np.unpackbits(np.frombuffer(body[b], np.uint8))[:2 * (hi - lo)]
            self._flags[lo:hi] = bits_of.reshape(-1, 2)
        self._plan = plan

    def candidates(self, docs: pa.Table) -> Iterator[tuple[np.ndarray, Texts, Units, Stretches, np.ndarray]]:
        """Each piece's ids, texts and units, its stretches with a shared minimiser and
        their hashes. Stretches of a hot minimiser are cut into single windows, whose
        own hash takes the minimiser's place."""
        window = self._plan.window
        for placed, (ids, piece) in zip(self._census.pieces, _pieces(docs)):
            units = self._plan.units(piece)
            if not placed:
                none = np.zeros(0, np.int64)
                yield ids, piece, units, Stretches(none, none, none, none.view(np.uint64)), none.view(np.uint64)
                continue
            found, place = placed
            flags = self._flags[place]
            cold, hot = np.flatnonzero(flags[:, 0] & ~flags[:, 1]), np.flatnonzero(flags[:, 0] & flags[:, 1])
            prefix = PrefixHash(units.codes)
            n = found.windows[hot]
            single = ranges(found.first[hot], n)
            own = mix(prefix.of(single, single + window))
            some = Stretches(np.concatenate([found.text[cold], np.repeat(found.text[hot], n)]),
                             np.concatenate([found.first[cold], single]),
                             np.concatenate([found.windows[cold], np.ones(len(single), np.int64)]),
                             np.concatenate([found.value[cold], own]))
            yield ids, piece, units, some, some.hashes(prefix, window)


@dataclass
class _Strings:
    """Distinct packed strings: hash, minimiser (32 bits), least and greatest id, and length."""

    hash: np.ndarray
    family: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    texts: list[bytes]

    def body(self, at: np.ndarray) -> bytes:
        columns = (self.hash, self.family, self.low, self.high - self.low, self.size)
        return zstandard.compress(b"".join([*[c[at].tobytes() for c in columns],
                                            *[self.texts[k] for k in at.tolist()]]), 3)

    @staticmethod
    def read(body: bytes, n: int) -> _Strings:
        raw, at, columns = zstandard.decompress(body), 0, []
        for kind in ("<u8", "<u4", "<i8", "<i8", "<u4"):
            columns.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        hashes, family, low, above, size = columns
        ends = (np.cumsum(size, dtype=np.int64) + at).tolist()
        return _Strings(hashes, family, low, low + above, size, [raw[s:e] for s, e in zip([at, *ends], ends)])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by hash, and where in it each distinct hash begins."""
    order = np.argsort(h, kind="stable")
    return order, np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))


def _send(plan: Plan, bits: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(_MESSAGE, [])
        columns, texts = [], []
        for ids, _, units, found, h in _Shared(docs, answers, plan, bits).candidates(docs):
            if not len(h):
                continue
            order, at = _distinct(h)
            pick, own = order[at], ids[found.text[order]]
            start = units.start[found.first[pick]]
            end = units.end[found.first[pick] + found.windows[pick] + plan.window - 2]
            columns.append((h[pick], found.value[pick], np.minimum.reduceat(own, at), np.maximum.reduceat(own, at),
                            (end - start).astype(np.uint32)))
            raw = units.data.tobytes()
            texts += [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
        if not columns:
            return _rows(_MESSAGE, [])
        h, value, low, high, size = (np.concatenate(c) for c in zip(*columns))
        order, at = _distinct(h)  # equal strings of several pieces once
        pick = order[at]
        bucket, _ = _deal(value[pick], bits)
        strings = _Strings(h[pick], value[pick].astype(np.uint32), np.minimum.reduceat(low[order], at),
                           np.maximum.reduceat(high[order], at), size[pick], [texts[k] for k in pick.tolist()])
        dealt = np.argsort(bucket, kind="stable")
        batch = docs.column("batch")[0].as_py()
        return _rows(_MESSAGE, [(batch, b, hi - lo, strings.body(dealt[lo:hi]))
                                for b, lo, hi in _cuts(bucket[dealt])])
    return run


#: An answer's columns: string, windows to skip, windows, and their smallest document.
_RUN = (("hash", "<u8"), ("skip", "<u4"), ("windows", "<u4"), ("low", "<i8"))


def _runs(bodies: list[bytes]) -> dict[str, np.ndarray]:
    """The answers' columns, ordered by string."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in _RUN}
    for raw in map(zstandard.decompress, bodies):
        n, at = len(raw) // sum(np.dtype(t).itemsize for _, t in _RUN), 0
        for name, t in _RUN:
            parts[name].append(np.frombuffer(raw, t, n, at))
            at += n * np.dtype(t).itemsize
    columns = {name: np.concatenate([*parts[name], np.zeros(0, t)]) for name, t in _RUN}
    order = np.argsort(columns["hash"], kind="stable")
    return {name: c[order] for name, c in columns.items()}


def _match(plan: Plan):
    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        batches = rows.column("batch").to_pylist()
        counts = rows.column("kind").to_pylist()
        parts = [_Strings.read(b, n) for b, n in zip(rows.column("body").to_pylist(), counts)]
        h, value, ids_low, ids_high, _ = (np.concatenate([getattr(p, f) for p in parts])
                                          for f in ("hash", "family", "low", "high", "size"))
        every = [t for p in parts for t in p.texts]
        del parts
        order, at = _distinct(h)
        string_of = np.empty(len(h), np.int64)
        string_of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
        low = np.minimum.reduceat(ids_low[order], at)
        high = np.maximum.reduceat(ids_high[order], at)
        pick = order[at]
        texts = [every[k] for k in pick.tolist()]
        del every
        lengths = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(lengths + 1) - lengths - 1
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        units = plan.units(Texts(0, len(texts), data, start, start + lengths))
        windows = units.last - units.first - plan.window + 1
        least = np.repeat(low, windows)
        # a minimiser with one string only has no other windows to compare
        _, family = np.unique(value[pick], return_inverse=True)
        several = np.bincount(family)[family] > 1
        compared = np.flatnonzero(np.repeat(several, windows))
        if len(compared):
            win = ranges(units.first, windows)[compared]
            group = plan.group(units, win, np.repeat(family, windows)[compared], plan.window)
            smallest = np.full(group.max() + 1, NO_ID)
            np.minimum.at(smallest, group, least[compared])
            least[compared] = smallest[group]
        # runs of windows with one smallest document
        string = np.repeat(np.arange(len(texts)), windows)
        cut = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (string[1:] != string[:-1])]))
        first = np.cumsum(windows) - windows
        size = np.diff(np.append(cut, len(least)))
        keep = least[cut] < high[string[cut]]
        cut, size = cut[keep], size[keep]
        owner = string[cut]
        run_lo, run_hi = np.searchsorted(owner, np.arange(len(texts))), np.searchsorted(
            owner, np.arange(len(texts)), "right")
        out, lo = [], 0
        for batch, n in zip(batches, counts):
            mine = string_of[lo:lo + n]
            per = run_hi[mine] - run_lo[mine]
            r = ranges(run_lo[mine], per)
            which = np.repeat(np.arange(lo, lo + n), per)
            useful = least[cut[r]] < ids_high[which]
            r, which = r[useful], which[useful]
            if len(r):
                columns = (h[which], cut[r] - first[owner[r]], size[r], least[cut[r]])
                out.append((batch, bucket, _FOUND, zstandard.compress(
                    b"".join([c.astype(t).tobytes() for c, (_, t) in zip(columns, _RUN)]), 1)))
            lo += n
        return _rows(_MESSAGE, out)
    return run


def _covered(docs: pa.Table, answers: pa.Table, plan: Plan, bits: int) -> Iterator[tuple[Texts, Units, np.ndarray]]:
    """Each piece of the batch with its units and which of them an earlier document covers."""
    bodies = [x for k, x in zip(answers.column("kind").to_pylist(), answers.column("body").to_pylist())
              if k == _FOUND]
    runs = _runs(bodies)
    for ids, piece, units, found, h in _Shared(docs, answers, plan, bits).candidates(docs):
        steps = np.zeros(len(units.codes) + 1, np.int64)
        if len(runs["hash"]) and len(h):
            lo, hi = np.searchsorted(runs["hash"], h), np.searchsorted(runs["hash"], h, "right")
            which = np.repeat(np.arange(len(h)), hi - lo)
            run = ranges(lo, hi - lo)
            earlier = runs["low"][run] < ids[found.text[which]]
            run, which = run[earlier], which[earlier]
            first = found.first[which] + runs["skip"][run]
            np.add.at(steps, first, 1)
            np.add.at(steps, first + runs["windows"][run].astype(np.int64) + plan.window - 1, -1)
        yield piece, units, np.cumsum(steps[:-1]) > 0


def covered_by_earlier(docs: DataFrame, plan: Plan, schema: str,
                       result: Callable[[pa.Array, Texts, Units, np.ndarray], pa.Table],
                       batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Apply ``result(ids, texts, units, covered)`` to all of ``docs(doc_id, text)``.

    ``covered`` says of each unit whether a window around it also starts in a
    document with a smaller ``doc_id`` (a null id is larger than any).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // batch_bytes))
    bits = max(0, (n - 1).bit_length())
    dealt = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(n)).alias("batch"), "id", "text")
    by_batch = dealt.groupBy("batch")
    flags = (by_batch.applyInArrow(_tell(plan, bits), MESSAGE)
             .groupBy("bucket").applyInArrow(_count, MESSAGE))
    send = _send(plan, bits)
    found = (by_batch.cogroup(flags.groupBy("batch")).applyInArrow(send, MESSAGE)
             .groupBy("bucket").applyInArrow(_match(plan), MESSAGE))

    def finish(batch: pa.Table, answers: pa.Table) -> pa.Table:
        out, done = [], 0
        ids = batch.column("id").combine_chunks()
        if batch.num_rows:
            for piece, units, covered in _covered(batch, answers, plan, bits):
                out.append(result(ids.slice(done, piece.hi - piece.lo), piece, units, covered))
                done += piece.hi - piece.lo
        return pa.concat_tables(out) if out else result(pa.array([], pa.int64()), None, None, None)

    return by_batch.cogroup(flags.unionByName(found).groupBy("batch")).applyInArrow(finish, schema)
