"""Substring dedup by super-k-mers: words covered by a 50-word window of an earlier document.

Consecutive windows sharing a minimiser (the least hash of the word grams in a
window) travel as one packed string to the minimiser's bucket (see
``windows``). There words become numbers, the windows are sorted, and runs of
equal windows, checked word by word, give each window's first document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.arrays import PrefixHash, Texts, mix
from riskspark.llm.windows import Plan, Units, covered_by_earlier, word_units

WINDOW, GRAM = 50, 8


def equal_windows(units: Units, win: np.ndarray, family: np.ndarray, window: int) -> np.ndarray:
    """Group numbers of the windows at ``win``; equal windows alike."""
    known: dict[bytes, int] = {}
    split = units.data.tobytes().split()
    word = np.fromiter((known.setdefault(w, len(known)) for w in split), np.int64, len(split))
    sums = PrefixHash(mix(word.astype(np.uint64) + np.uint64(1)))
    value = mix(sums.of(win, win + window))
    order = np.lexsort((value, family))
    same = (value[order[1:]] == value[order[:-1]]) & (family[order[1:]] == family[order[:-1]])
    near = np.flatnonzero(same)
    a, b = win[order[near]], win[order[near + 1]]
    equal = np.ones(len(near), bool)
    for k in range(window):
        equal &= word[a + k] == word[b + k]
    group = np.empty(len(win), np.int64)
    if not equal.all():  # different windows of one hash: sort the windows themselves
        rows = np.column_stack([word[win + k] for k in range(window)])
        return np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    group[order] = np.concatenate([[0], np.cumsum(~same)])
    return group


def _result(ids: pa.Array, texts: Texts, units: Units, covered: np.ndarray) -> pa.Table:
    names = ["doc_id", "n_words", "n_removed", "kept"]
    if texts is None:
        return pa.table([ids, *[pa.array([], pa.int64())] * 2, pa.array([], pa.binary())], names=names)
    sums = np.concatenate([[0], np.cumsum(covered)])
    removed = sums[units.last] - sums[units.first]
    out = units.data[np.repeat(~covered, units.end - units.start + 1)].tobytes()
    size = np.concatenate([[0], np.cumsum(np.where(covered, 0, units.end - units.start + 1))])
    kept = [out[s:max(s, e - 1)] for s, e in zip(size[units.first].tolist(), size[units.last].tolist())]
    return pa.table([ids, pa.array(units.last - units.first, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.binary())], names=names)


def remove_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove from ``docs(doc_id, text)`` each word covered by a window of ``window``
    words whose word sequence also starts in a document with a smaller ``doc_id``.

    Returns, one row per input row, ``doc_id, n_words, n_removed, kept`` (the kept
    words, one space between). Windows are judged on the input. Null text has no
    words; rows of one ``doc_id`` don't affect each other; a null ``doc_id`` is
    larger than any. Empty input gives no rows; other columns are ignored.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM} words")
    plan = Plan(word_units, equal_windows, window, GRAM)
    return covered_by_earlier(docs, plan, "doc_id long, n_words long, n_removed long, kept binary",
                              _result).withColumn("kept", F.col("kept").cast("string"))
