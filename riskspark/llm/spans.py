"""Spans found in texts, and their text form."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

Span = tuple[int, int, int]  # start, kind number, end; code points, end exclusive


def written(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    return ",".join(f"{kinds[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def inside(span: Span, others: list[Span], same_kind: bool = True) -> bool:
    """Whether one of the others contains the whole span."""
    start, kind, end = span
    return any(s <= start and end <= e and (k == kind or not same_kind) for s, k, e in others)


def texts_of(batch: pa.RecordBatch, column: int, rows: int = 256) -> Iterator[tuple[int, str]]:
    """Row number and text (null: empty), converted a few rows at a time."""
    for lo in range(0, batch.num_rows, rows):
        for k, text in enumerate(batch.column(column).slice(lo, rows).to_pylist(), lo):
            yield k, text or ""
