"""SimHash near-duplicates: fingerprints and tiled exact comparison.

Every document gets a 64-bit fingerprint of its word shingles. Distinct
fingerprints are dealt into cells by the population counts of their two halves;
two fingerprints within ``radius`` bits lie in cells whose counts differ by at
most ``radius`` in sum, so all other cell pairs are skipped. A cell is cut into
tiles of bounded size, each pair of tiles is one row, and a task compares it
exactly with exclusive-or and bit counts. Of each tile pair's links only a
spanning forest is kept, which keeps components whole without listing all pairs
of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.arrays import ranges, text_pieces
from riskspark.llm.components import component_roots
from riskspark.session import ensure_checkpoint_dir

TILE_ROWS = 4096
_BLOCK = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprints_of(texts, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """Fingerprints (uint64) of the texts of one piece; no word: zero."""
    data = _LOWER[texts.data]
    starts, ends, first = texts.words()
    lengths = ends - starts
    # the words again, one space after each
    joined = data[ranges(starts, lengths + 1)] if len(starts) else data[:0]
    at = np.cumsum(lengths + 1) - lengths - 1
    joined[at + lengths] = 32
    n_words = np.diff(first)
    n_shingles = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    left = ranges(first[:-1], n_shingles)
    right = np.minimum(left + shingle, np.repeat(first[1:], n_shingles)) - 1
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[s:e], seed) for s, e in zip(at[left].tolist(), (at + lengths)[right].tolist())),
        np.uint64, len(left))
    out = np.zeros(len(n_words), np.uint64)
    some = np.flatnonzero(n_shingles)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at_doc = (np.cumsum(n_shingles) - n_shingles)[some]
        ones = np.add.reduceat(bits, at_doc, axis=0, dtype=np.int32)
        major = (2 * ones > n_shingles[some][:, None]).astype(np.uint8)
        out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp)``; ``fp`` is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(piece.lo, piece.hi - piece.lo),
                     pa.array(fingerprints_of(piece, shingle, seed).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of ``a`` and ``b`` that differ in ``radius`` bits or fewer."""
    rows, cols = [], []
    for lo in range(0, len(a), _BLOCK):
        differ = (a[lo:lo + _BLOCK, None] ^ b[None, :]).view(np.uint64)  # bit counts of signed numbers drop the sign
        near = np.bitwise_count(differ) <= radius
        i, j = np.nonzero(near)
        rows.append(i + lo)
        cols.append(j)
    return np.concatenate(rows), np.concatenate(cols)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``(node, root)`` that connect what the edges ``(u, v)`` connect."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = flat[:len(u)], flat[len(u):]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _links_of_tiles(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, same = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            us, vs = [], []
            for k, diagonal in enumerate(same):
                a = np.asarray(left[k].values, np.int64)
                b = a if diagonal else np.asarray(right[k].values, np.int64)
                i, j = close_pairs(a, b, radius)
                if diagonal:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    u, v = forest(a[i], b[j])
                    us.append(u)
                    vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])
    return run


def fingerprint_links(fps: DataFrame, radius: int = 4, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Distinct ``fps(fp)`` -> ``(u, v)``: a forest of each tile pair's links within ``radius`` bits."""
    high = F.bit_count(F.shiftrightunsigned("fp", 32)).cast("int")
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    dealt = fps.select("fp", high.alias("high"), low.alias("low"))
    # at most 33 x 33 cells, so this table may go to every executor
    cells = dealt.groupBy("high", "low").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("tiles")).checkpoint()
    tiles = (dealt.join(F.broadcast(cells), ["high", "low"])
             .withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
             .groupBy("high", "low", "tile").agg(F.collect_list("fp").alias("fps")).checkpoint())
    steps = [(h, w) for h in range(radius + 1) for w in range(-radius, radius + 1)
             if h + abs(w) <= radius and (h > 0 or w >= 0)]
    near = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in steps]))
    partner = (tiles.select(F.col("high").alias("lh"), F.col("low").alias("ll"), F.col("tile").alias("lt"),
                            F.col("fps").alias("left"), near.alias("step"))
               .withColumn("high", F.col("lh") + F.col("step.h"))
               .withColumn("low", F.col("ll") + F.col("step.w"))
               .join(F.broadcast(cells), ["high", "low"]))
    own = (F.col("step.h") == 0) & (F.col("step.w") == 0)
    partner = partner.withColumn("tile", F.explode(F.sequence(
        F.when(own, F.col("lt")).otherwise(F.lit(0).cast("long")), F.col("tiles") - 1)))
    pairs = partner.join(tiles, ["high", "low", "tile"]).select(
        "left", F.col("fps").alias("right"), (own & (F.col("tile") == F.col("lt"))).alias("same"))
    return pairs.mapInArrow(_links_of_tiles(radius), "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, seed: int = 42,
                       tile_rows: int = TILE_ROWS) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``.

    Returns ``doc_id, fp, component_id``, one row per input row: the fingerprint
    (signed long) and the smallest ``doc_id`` reachable over links of at most
    ``radius`` bits. Null or wordless texts have fingerprint zero and link like
    any other; texts under ``shingle`` words are one shingle; repeated rows each
    come back; a null ``doc_id`` is never the smallest unless it is alone. Empty
    input gives no rows; other columns are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    prints = fingerprints(docs, shingle, seed).checkpoint()
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    links = fingerprint_links(nodes.select("fp"), radius, tile_rows)
    roots = component_roots(links)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")
