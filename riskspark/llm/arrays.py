"""Numpy views of Arrow text batches: words, polynomial prefix hashes, sliding minima.

Helpers for the operators whose tasks work on whole texts as byte arrays.
All hashes are polynomial over the ring of 64-bit integers; they only choose
buckets and candidates, every equality that counts is verified on the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate words: space and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(42))
#: A 64-bit value for each byte value.
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


class PrefixHash:
    """Prefix polynomial hashes of a sequence of 64-bit codes; any range's hash in O(1)."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:len(codes)], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges ``[start, end)``."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def each(self, length: int) -> np.ndarray:
        """Hashes of all ranges of a length, by start."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values (length ``n - width + 1``), by doubling."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` for each start and length."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


@dataclass
class Texts:
    """Some rows' texts in one byte buffer; a separator byte follows each text."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the index of each text's first word (and the end)."""
        inside = ~SPACE[self.data]
        inside[self.end] = False
        step = np.diff(inside.astype(np.int8), prepend=0)
        starts = np.flatnonzero(step == 1)
        ends = np.flatnonzero(step == -1)
        first = np.searchsorted(starts, np.append(self.start, len(self.data)))
        return starts, ends, first


def text_pieces(column: pa.Array | pa.ChunkedArray, max_bytes: int = 1 << 20,
                separator: int = 32, max_rows: int = 4096) -> Iterator[Texts]:
    """Cut a text column into pieces of whole texts, at most ``max_rows`` and about
    ``max_bytes`` each (null: empty)."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    base = 0
    for chunk in chunks:
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        n = len(chunk)
        if not n:
            continue
        _, offsets_buffer, data_buffer = chunk.buffers()
        offsets = np.frombuffer(offsets_buffer, np.int64)[chunk.offset:chunk.offset + n + 1]
        data = np.frombuffer(data_buffer or b"", np.uint8)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
            hi = min(hi, n, lo + max_rows)
            lengths = np.diff(offsets[lo:hi + 1])
            start = np.cumsum(lengths + 1) - lengths - 1
            out = np.full(int(lengths.sum()) + hi - lo, separator, np.uint8)
            for s, a, b in zip(start, offsets[lo:hi], offsets[lo + 1:hi + 1]):
                out[s:s + b - a] = data[a:b]
            yield Texts(base + lo, base + hi, out, start, start + lengths)
            lo = hi
        base += n
