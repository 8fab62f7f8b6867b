"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit a linear classifier on hashed byte
n-grams predicts on which side a text lies. A text gets the language whose
codeword loses least against the predicted bits, where bits that were learned
well weigh more. Texts nearly as close to a second codeword are flagged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.arrays import Texts, ranges, text_pieces
from riskspark.session import ensure_checkpoint_dir

#: Hashed n-gram features, and the sizes of the n-grams in bytes.
FEATURES, GRAMS = 4096, (2, 3)
#: Bounds of the training sample: documents per language, and of all languages (a fit solves
#: for as many unknowns, so the latter bounds its memory: about 1 GB at 4,000).
TRAIN_PER_LANGUAGE, TRAIN_TOTAL = 400, 4000
#: Languages whose sample ids are sent to all executors at most; more are joined by shuffle.
BROADCAST_LANGUAGES = 1000
RIDGE = 0.05
SHARPNESS = 4.0
#: A second codeword within this loss of the nearest makes a text ambiguous, at most; the gap
#: is half the least one that a learned document has when it is left out.
AMBIGUOUS = 0.1
#: A loss of the nearest codeword (1: bits that say nothing) from which a text is far from every
#: language, at least; above that, ``FAR_RATIO`` times the most of the left-out documents.
FAR, FAR_RATIO = 0.7, 1.25
#: Left-out documents, decoded rightly, that these need; with fewer nothing is flagged.
CALIBRATE_ON = 20
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
# ASCII in lower case, all but letters as spaces; other bytes as they are
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter (the pattern also meets signs such as a raised 2)."""
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


def grams(piece: Texts) -> np.ndarray:
    """Feature vectors (square roots of n-gram shares, unit length), one row per text."""
    data = _FOLD[piece.data]
    capital = np.zeros(len(data), bool)  # Latin-1 capitals: second byte 80-9E after C3
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    data = np.where(capital, data + 32, data).astype(np.uint32)
    n = len(piece.start)
    counts = np.zeros((n, FEATURES))
    for size in GRAMS:
        code = np.full(max(len(data) - size + 1, 0), size, np.uint32)
        for k in range(size):
            code = (code * np.uint32(0x01000193)) ^ data[k:len(data) - size + 1 + k]
        slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        lengths = np.clip(np.minimum(piece.end + 1, len(data)) - piece.start - size + 1, 0, None)
        text = np.repeat(np.arange(n), lengths)
        counts += np.bincount(text * FEATURES + slot[ranges(piece.start, lengths)],
                              minlength=n * FEATURES).reshape(n, FEATURES)
    x = np.sqrt(counts)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """Codewords of ``n`` classes, rows of -1 and 1.

    Up to six classes: every way to part them in two. More: random columns, the
    best of several draws by the least distance of two codewords.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        masks = [m for m in range(1, 1 << n, 2) if m != (1 << n) - 1]
        return np.array([[1.0 if m >> k & 1 else -1.0 for m in masks] for k in range(n)])
    bits = math.ceil(10 * math.log2(n))
    best, best_gap = None, -1.0
    for draw in range(20):
        c = np.random.Generator(np.random.PCG64(draw)).choice([-1.0, 1.0], (n, bits))
        gap = ((bits - c @ c.T) / 2 + np.eye(n) * bits).min()
        if gap > best_gap:
            best, best_gap = c, gap
    return best


def code_losses(margins: np.ndarray, codes: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Weighted squared hinge loss of each text's bits (row) against each codeword."""
    out = np.zeros((len(margins), len(codes)))
    for k in range(len(codes)):
        out[:, k] = np.square(np.maximum(0, 1 - margins * codes[k])) @ trust
    return out


def calibrate(loss: np.ndarray, truth: np.ndarray, least: int = CALIBRATE_ON) -> tuple[float, float]:
    """The ambiguity gap and the limit of the nearest loss, from left-out documents that were
    decoded rightly; so no such document would be flagged."""
    right = loss.argmin(axis=1) == truth
    if right.sum() < least:
        return 0.0, math.inf
    ordered = np.sort(loss[right], axis=1)
    gap = min(AMBIGUOUS, float((ordered[:, 1] - ordered[:, 0]).min()) / 2)
    return gap, max(FAR, FAR_RATIO * float(ordered[:, 0].max()))


@dataclass
class Model:
    """Languages, their codewords, a column of feature weights per bit, bias, and bit weights;
    the ambiguity gap and the loss from which a text is far from every language."""

    langs: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    gap: float = AMBIGUOUS
    far: float = math.inf

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest codeword, its score, whether a second is nearly as near, and
        whether even the nearest is far."""
        if self.codes.shape[1] == 0:
            return np.zeros(len(x), int), np.ones(len(x)), np.zeros(len(x), bool), np.zeros(len(x), bool)
        loss = code_losses(x @ self.weights + self.bias, self.codes, self.trust)
        order = np.argsort(loss, axis=1, kind="stable")
        at = np.arange(len(x))
        weight = np.exp(-SHARPNESS * (loss - loss.min(axis=1, keepdims=True)))
        score = weight[at, order[:, 0]] / weight.sum(axis=1)
        gap = loss[at, order[:, 1]] - loss[at, order[:, 0]]
        return order[:, 0], score, gap < self.gap, loss[at, order[:, 0]] > self.far


def fit_bits(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Regularised least squares for each column of targets -1 / 1 (dual form).

    Returns weights, bias, the trust in each bit, from its leave-one-out error, and the
    left-out predictions of every row (about the same means).
    """
    x = x.astype(np.float64)
    mean, base = x.mean(axis=0), y.mean(axis=0)
    centred = x - mean
    gram = centred @ centred.T
    inverse = np.linalg.inv(gram + RIDGE * np.eye(len(x)))
    alpha = inverse @ (y - base)
    weights = centred.T @ alpha
    left_out = y - alpha / np.diag(inverse)[:, None]
    error = np.clip((left_out * y <= 0).mean(axis=0), 1e-3, 0.499)
    trust = np.log((1 - error) / error)
    return weights, base - mean @ weights, trust / trust.sum(), left_out


def held_out(doc_id) -> F.Column:
    """Documents never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _sample_ids(rows: DataFrame, per_language: int, total: int) -> tuple[list[str], DataFrame]:
    """Languages, and ``(lang, doc_id)`` of the smallest id hashes of each.

    A language's count of ids sets a cut-off hash that some four times as many ids
    pass as are wanted, so the ranking sees a few thousand ids, however many rows
    there are, or share an id.
    """
    spark = rows.sparkSession
    ids = rows.select("lang", "doc_id").filter(F.col("doc_id").isNotNull())
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(
        F.approx_count_distinct("doc_id").alias("n")).collect()}
    langs = sorted(sizes)
    wanted = max(1, min(per_language, total // max(1, len(langs))))
    cuts = spark.createDataFrame(
        [(lang, min((1 << 63) - 1, (4 * wanted << 64) // max(1, n) - (1 << 63))) for lang, n in sizes.items()],
        "lang string, cut long")
    if len(langs) <= BROADCAST_LANGUAGES:
        cuts = F.broadcast(cuts)
    by_hash = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    return langs, (ids.withColumn("_hash", F.xxhash64("doc_id", F.lit(7))).join(cuts, "lang")
                   .filter(F.col("_hash") <= F.col("cut")).select("lang", "doc_id", "_hash").distinct()
                   .withColumn("_rank", F.row_number().over(by_hash))
                   .filter(F.col("_rank") <= wanted).select("lang", "doc_id"))


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, total: int = TRAIN_TOTAL) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: at most ``per_language`` documents of each
    language (those of the smallest id hashes) that are not held out, and about ``total``
    of all. Rows without an id are not learned from; of rows that share an id and a language
    the first text in order is.

    The sample is chosen by ids alone, its texts become feature vectors in the
    tasks that read them, and one task fits all bits on that bounded sample; only
    the fitted weights come back.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    langs, chosen = _sample_ids(rows, per_language, total)
    if not langs:
        return Model([], np.zeros((0, 0)), np.zeros((FEATURES, 0)), np.zeros(0), np.zeros(0))
    chosen = chosen.checkpoint()
    codes = codewords(len(langs))
    if len(langs) <= BROADCAST_LANGUAGES:
        chosen = F.broadcast(chosen)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch.column(1), max_rows=128):
                x = grams(piece)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.lo, piece.hi - piece.lo),
                     pa.array([row.tobytes() for row in x], pa.binary())], ["lang", "x"])

    def fit(sample: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(b, np.float32) for b in sample["x"]])
        truth = np.searchsorted(langs, sample["lang"])
        weights, bias, trust, left_out = fit_bits(x, codes[truth])
        gap, far = calibrate(code_losses(left_out, codes, trust), truth)
        return pd.DataFrame({"bit": range(len(bias)), "w": [w.astype(np.float32).tobytes() for w in weights.T],
                             "bias": bias, "trust": trust, "gap": gap, "far": far})

    if codes.shape[1] == 0:
        return Model(langs, codes, np.zeros((FEATURES, 0)), np.zeros(0), np.zeros(0))
    sample = (rows.join(chosen, ["doc_id", "lang"], "left_semi")
              .groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text"))
    fitted = (sample.mapInArrow(vectors, "lang string, x binary")
              .groupBy().applyInPandas(fit, "bit int, w binary, bias double, trust double, gap double, far double")
              .orderBy("bit").collect())
    weights = np.stack([np.frombuffer(r["w"], np.float32) for r in fitted], axis=1)
    return Model(langs, codes, weights, np.array([r["bias"] for r in fitted]),
                 np.array([r["trust"] for r in fitted]), fitted[0]["gap"], fitted[0]["far"])


def language_column(text, model: Model) -> F.Column:
    """``struct(lang_pred, score, ambiguous, far)`` of a text column; other columns stay where they are."""
    names = np.array([*model.langs, UNKNOWN], object)

    def predict(texts: pa.Array) -> pa.Array:
        parts = []
        for piece in text_pieces(texts, max_rows=128):
            n = piece.hi - piece.lo
            letters = np.array([has_letter(t) for t in texts.slice(piece.lo, n).to_pylist()])
            known = letters & bool(model.langs)
            part = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n, bool), np.zeros(n, bool)
            if known.any():
                part = tuple(np.where(known, a, b) for a, b in zip(model.decode(grams(piece)), part))
            parts.append(part)
        nearest, score, unsure, far = (np.concatenate(p) for p in zip(*parts)) if parts else ([], [], [], [])
        return pa.StructArray.from_arrays(
            [pa.array(list(names[nearest]) if len(nearest) else [], pa.string()), pa.array(score, pa.float64()),
             pa.array(unsure, pa.bool_()), pa.array(far, pa.bool_())],
            names=["lang_pred", "score", "ambiguous", "far"])

    return F.arrow_udf(predict, "lang_pred string, score double, ambiguous boolean, far boolean",
                       F.ArrowUDFType.SCALAR)(F.col(text) if isinstance(text, str) else text)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Language of every document of ``docs(doc_id, text, lang)``; ``lang`` is only learned from.

    Returns, one row per input row, ``doc_id, held_out, lang_pred, score, ambiguous, far``
    (``ambiguous``: a second language is nearly as near; ``far``: even the nearest is not near).
    ``lang_pred`` is ``und`` (score 0) for null text, for a text without a letter,
    and if there was nothing to learn from; with one language learned it is that
    one. Codewords equally near are taken in the order of their languages. A null
    ``doc_id`` is not held out; repeated rows each come back; empty input gives no
    rows; other columns are ignored. A text of any length counts whole.
    """
    fitted = model or train(docs)
    return docs.select("doc_id", held_out("doc_id").alias("held_out"),
                       language_column("text", fitted).alias("_found")).select(
        "doc_id", "held_out", "_found.lang_pred", "_found.score", "_found.ambiguous", "_found.far")
