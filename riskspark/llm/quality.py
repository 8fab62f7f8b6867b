"""Quality rules: counts of a text and its distance from its language's usual histograms.

Reference histograms are made per language over all documents: character
classes, and the language's most common words with all others as one
bin. A document's own histograms are compared with its language's by
Jensen-Shannon distance (base 2, 0 to 1); a text below a minimum length has no
verdict from that histogram.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.arrays import PrefixHash, SPACE, Texts, mix, ranges, text_pieces
from riskspark.session import ensure_checkpoint_dir

REPEAT_WINDOW = 8
COMMON_WORDS = 200
#: Distances above these fail, for texts of at least so many characters and words.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.30, 300
MAX_WORD_DISTANCE, MIN_WORDS = 0.55, 50
#: So does a text whose common words are less than this part of what its language's share lets expect,
#: and by so many standard deviations of a count of that size.
MIN_COMMON, COMMON_SIGMAS = 0.5, 2.0

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "control", "other")
_CLASS = np.full(256, len(CLASSES), np.int64)  # bytes within a character count for none
_CLASS[0:32], _CLASS[127] = 6, 6
_CLASS[33:127] = 5
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 1, 0
_CLASS[_SYMBOLS] = 4
_CLASS[SPACE] = 3
_CLASS[0xC0:] = 7
_ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _per_text(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[end] - sums[start]


def class_counts(piece: Texts) -> np.ndarray:
    """Characters of each class, one row per text."""
    n, width = len(piece.start), len(CLASSES) + 1
    lengths = piece.end - piece.start
    text = np.repeat(np.arange(n), lengths)
    kinds = _CLASS[piece.data[ranges(piece.start, lengths)]]
    return np.bincount(text * width + kinds, minlength=n * width).reshape(n, width)[:, :-1]


def word_ids(piece: Texts) -> tuple[np.ndarray, list[bytes]]:
    """The words of the piece as numbers, equal words alike, and the words by number."""
    known: dict[bytes, int] = {}
    split = piece.data.tobytes().split()
    ids = np.fromiter((known.setdefault(w, len(known)) for w in split), np.int64, len(split))
    return ids, list(known)


def repeated_words(ids: np.ndarray, first: np.ndarray, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each text inside windows that the text has twice or more."""
    n_windows = np.maximum(np.diff(first) - window + 1, 0)
    win = ranges(first[:-1], n_windows)
    covered = np.zeros(len(ids) + 1, np.int64)
    if len(win):
        text = np.repeat(np.arange(len(n_windows)), n_windows)
        hashes = PrefixHash(mix(ids.astype(np.uint64) + np.uint64(1))).of(win, win + window)
        hashes = mix(hashes ^ mix(text.astype(np.uint64) + np.uint64(1)))
        order = np.argsort(hashes, kind="stable")
        same = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
        i, j = order[same], order[same + 1]
        equal = text[i] == text[j]
        for k in range(window):
            equal &= ids[win[i] + k] == ids[win[j] + k]
        if not equal.all():  # different windows of one hash: compare the windows themselves
            rows = np.column_stack([text, *[ids[win + k] for k in range(window)]])
            _, group, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            found = np.flatnonzero(count[group.ravel()] > 1)
        else:
            found = np.union1d(i, j)
        np.add.at(covered, win[found], 1)
        np.add.at(covered, win[found] + window, -1)
    inside = np.cumsum(covered[:-1]) > 0
    return _per_text(inside, first[:-1], first[1:])


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


@dataclass
class References:
    """Histograms by language (None: all documents): class counts, common words and their counts."""

    classes: dict
    words: dict
    word_counts: dict


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language: counts of classes and of words."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        classes: dict = {}
        words: dict = {}
        total: Counter = Counter()
        for piece in text_pieces(batch.column(1)):
            counts = class_counts(piece)
            lower = piece.data.tobytes().translate(_ASCII_LOWER)
            for k in range(piece.lo, piece.hi):
                lang = langs[k]
                at = k - piece.lo
                classes[lang] = classes.get(lang, 0) + counts[at]
                split = lower[piece.start[at]:piece.end[at]].split()
                words.setdefault(lang, Counter()).update(split)
                total[lang] += len(split)
        rows = [(lang, 0, str(c).encode(), int(v)) for lang, row in classes.items() for c, v in enumerate(row)]
        rows += [(lang, 2, b"", n) for lang, n in total.items()]
        rows += [(lang, 1, w, n) for lang, c in words.items() for w, n in c.items()]
        if rows:
            lang, kind, key, n = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(kind, pa.int32()), pa.array(key, pa.binary()),
                 pa.array(n, pa.int64())], ["lang", "kind", "key", "n"])


def references(docs: DataFrame) -> References:
    """Reference histograms of all ``docs(lang, text)``.

    The result has a few hundred numbers per language and is all that reaches the driver.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    counts = (docs.select(F.col("lang").cast("string").alias("lang"), "text")
              .mapInArrow(_histograms, "lang string, kind int, key binary, n long")
              .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).checkpoint())
    whole = counts.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    rows = (counts.filter(F.col("lang").isNotNull()).select("lang", "kind", "key", "n", F.lit(False).alias("whole"))
            .unionByName(whole.select(F.lit("").alias("lang"), "kind", "key", "n", F.lit(True).alias("whole"))))
    # the rank is cut in the map tasks already, so a language's many words don't meet in one task
    rank = F.row_number().over(Window.partitionBy("whole", "lang").orderBy(F.desc("n"), "key"))
    words = rows.filter(F.col("kind") == 1).withColumn("rank", rank).filter(F.col("rank") <= COMMON_WORDS)
    top = words.unionByName(rows.filter(F.col("kind") != 1).withColumn("rank", F.lit(0)))
    refs = References({}, {}, {})
    for row in top.orderBy("whole", "lang", "kind", "rank").collect():
        lang = None if row["whole"] else row["lang"]
        if row["kind"] == 0:
            refs.classes.setdefault(lang, np.zeros(len(CLASSES)))[int(bytes(row["key"]))] = row["n"]
        elif row["kind"] == 1:
            refs.words.setdefault(lang, {})[bytes(row["key"])] = len(refs.words.get(lang, {}))
            refs.word_counts.setdefault(lang, []).append(row["n"])
        else:
            common = refs.word_counts.setdefault(lang, [])
            refs.words.setdefault(lang, {})
            common.append(row["n"] - sum(common))
    return refs


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` from the counts ``q``; no count: 0."""
    total = p.sum(axis=1, keepdims=True)
    if not q.sum():
        return np.zeros(len(p))
    p = p / np.maximum(total, 1)
    q = q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total.ravel() > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 0.0)


def distances(piece: Texts, langs: list, refs: References,
              min_common: float = MIN_COMMON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and common-word distance of each text from its language's references, and whether
    it has too few of its language's common words (never, if its language has no reference)."""
    n = len(piece.start)
    by_class, by_word, few = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    counts = class_counts(piece)
    lower = Texts(0, n, np.frombuffer(piece.data.tobytes().translate(_ASCII_LOWER), np.uint8),
                  piece.start, piece.end)
    ids, known = word_ids(lower)
    _, _, first = lower.words()
    text = np.repeat(np.arange(n), np.diff(first))
    own = [lang if lang in refs.classes else None for lang in langs]
    for lang in set(own):
        if lang not in refs.classes:
            continue
        rows = np.flatnonzero([x == lang for x in own])
        by_class[rows] = js_distance(counts[rows], refs.classes[lang])
        common = refs.words[lang]
        bins = len(common) + 1
        place = np.fromiter((common.get(w, bins - 1) for w in known), np.int64, len(known))
        seat = np.full(n, -1)
        seat[rows] = np.arange(len(rows))
        mine = seat[text] >= 0
        table = np.bincount(seat[text[mine]] * bins + place[ids[mine]], minlength=len(rows) * bins)
        table, usual = table.reshape(len(rows), bins), np.array(refs.word_counts[lang], float)
        by_word[rows] = js_distance(table, usual)
        if lang is not None and usual.sum():
            expected = table.sum(axis=1) * (1 - usual[-1] / usual.sum())
            lack = expected - table[:, :-1].sum(axis=1)
            few[rows] = lack > np.maximum((1 - min_common) * expected, COMMON_SIGMAS * np.sqrt(expected))
    return by_class, by_word, few


def quality_rules(docs: DataFrame, refs: References | None = None,
                  max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE,
                  min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
                  min_common: float = MIN_COMMON) -> DataFrame:
    """Quality counts and verdict of every document of ``docs(doc_id, text, lang)``.

    Returns, one row per input row, ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, class_distance, word_distance, base_failed,
    kept``. Null text is an empty text, which fails the base rules; a null or
    unseen language is compared with all documents; texts under ``min_chars``
    characters or ``min_words`` words pass the histogram in question. A text with
    less than ``min_common`` of the common words that its language's share lets
    expect fails, too, unless its language is null or unseen. Repeated
    rows each come back; empty input gives no rows; other columns are ignored.
    """
    refs = refs or references(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for piece in text_pieces(batch.column(1)):
                starts, ends, first = piece.words()
                ids, _ = word_ids(piece)
                n_words = np.diff(first)
                leads = (piece.data & 0xC0) != 0x80
                inside = ~SPACE[piece.data]
                inside[piece.end] = False
                n_repeat = repeated_words(ids, first)
                raw = piece.data.tobytes()
                n_dup = [repeated_lines(raw[s:e]) for s, e in zip(piece.start.tolist(), piece.end.tolist())]
                n_chars = _per_text(leads, piece.start, piece.end)
                by_class, by_word, few = distances(piece, langs[piece.lo:piece.hi], refs, min_common)
                failed = (n_words < 20) | (100 * n_repeat > 30 * n_words)
                odd = ((by_class > max_class) & (n_chars >= min_chars)
                       | ((by_word > max_word) | few) & (n_words >= min_words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.lo, piece.hi - piece.lo), pa.array(n_words.astype(np.int64)),
                     pa.array(_per_text(leads & inside, piece.start, piece.end)),
                     pa.array(_per_text(_SYMBOLS[piece.data], piece.start, piece.end)),
                     pa.array(n_dup, pa.int64()), pa.array(n_repeat.astype(np.int64)),
                     pa.array(by_class), pa.array(by_word), pa.array(failed), pa.array(~failed & ~odd)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "class_distance", "word_distance", "base_failed", "kept"]
    schema = (f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
              "n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean")
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, schema)
