"""Line dedup by pairwise alignment: shared lines find the pairs, patience diff aligns them.

Documents become sequences of line hashes. The shortest runs of lines, forward
and backward from each line, that reach the size of a block are evidence of
overlap: each document that has a run is paired with the first document that has
it, so a run shared by n documents gives n - 1 pairs. Every line of a block that
two documents share lies in such a run of it, so each block has a partner that
holds it. Each pair's sequences are aligned with patience diff, again and again on
what is still unmatched; the common blocks of these alignments go from the later
document. Only hashes travel; the texts are shuffled once, to be cut.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.arrays import PrefixHash, mix
from riskspark.session import ensure_checkpoint_dir

#: Characters that a common block must have to be deleted.
MIN_BLOCK_CHARS = 50


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places ``(i, j)``, ascending in both, of patience diff.

    Equal ends are matched; then the elements that occur once on each side and
    of these a longest increasing chain; then what lies between, the same way. In
    a range without such an element the rarest common one's occurrences are matched
    in their order.
    """
    matched = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        place: dict[int, int] = {}
        for j in range(b0, b1):
            place[b[j]] = -1 if b[j] in place else j
        mine: dict[int, int] = {}
        for i in range(a0, a1):
            if place.get(a[i], -1) >= 0:
                mine[a[i]] = -1 if a[i] in mine else i
        chain = _longest_chain([(i, place[x]) for x, i in mine.items() if i >= 0])
        if not chain:
            chain = _rarest_common(a, a0, a1, b, b0, b1)
        if not chain:
            continue
        matched += chain
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *chain], [*chain, (a1, b1)]):
            if i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
    return sorted(matched)


def _rarest_common(a: list[int], a0: int, a1: int, b: list[int], b0: int, b1: int) -> list[tuple[int, int]]:
    """The occurrences in both ranges of the common element that has fewest, in their order."""
    left: dict[int, list[int]] = {}
    right: dict[int, list[int]] = {}
    for i in range(a0, a1):
        left.setdefault(a[i], []).append(i)
    for j in range(b0, b1):
        if b[j] in left:
            right.setdefault(b[j], []).append(j)
    if not right:
        return []
    rarest = min(right, key=lambda x: (len(left[x]) + len(right[x]), left[x][0]))
    return list(zip(left[rarest], right[rarest]))


def _longest_chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain ascending in both places, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    under = [-1] * len(pairs)
    pairs = sorted(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        under[k] = top_at[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(j)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = j, k
    chain = []
    k = top_at[-1] if top_at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = under[k]
    return chain[::-1]


def shortest_runs(sizes: np.ndarray, starts: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges ``[start, end)`` of the shortest runs of at least ``min_chars`` characters
    that begin at each line, and of those that end at each line.

    ``starts`` are the sequences' first lines, and the end. A run lies in one
    sequence. Each line of a longer run lies in a shortest one inside it.
    """
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    least = max(min_chars, 1)
    lines = np.arange(len(sizes))
    which = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = np.searchsorted(upto, upto[:-1] + least)
    ahead = end <= starts[1:][which]
    start = np.searchsorted(upto, upto[1:] - least, "right") - 1
    back = start >= starts[:-1][which]
    return np.concatenate([lines[ahead], start[back]]), np.concatenate([end[ahead], lines[back] + 1])


def _tuples(seq: list[int], sizes: list[int], min_chars: int) -> list[tuple[int, int, tuple[int, ...]]]:
    start, end = shortest_runs(np.array(sizes, np.int64), np.array([0, len(seq)]), min_chars)
    return [(s, e, tuple(seq[s:e])) for s, e in zip(start.tolist(), end.tolist())]


def _places(b: list[int], size: dict[int, int], min_chars: int) -> dict[tuple[int, ...], int]:
    """Where ``b`` has each of its shortest runs first, in lines that ``size`` knows."""
    places: dict[tuple[int, ...], int] = {}
    part: list[int] = []
    for j, x in enumerate([*b, None]):
        if x in size:
            part.append(x)
        elif part:
            for s, _, run in _tuples(part, [size[k] for k in part], min_chars):
                places.setdefault(run, j - len(part) + s)
            part = []
    return places


def common_blocks(a: list[int], sizes: list[int], b: list[int], min_chars: int) -> list[int]:
    """Places in ``a`` inside common blocks (runs that an alignment matches without a gap) of at least
    ``min_chars`` characters.

    Patience diff runs again on what is still unmatched of ``a`` until a round gives no block, so blocks that moved
    or are repeated are aligned too. Where its chain of anchors still runs past a shared run (a run that overlaps an
    aligned block, or whose lines also stand elsewhere), the run is aligned with its own place in ``b``.
    """
    out: set[int] = set()
    left: list[int | None] = list(a)
    while found := _aligned_blocks(left, sizes, b, min_chars):
        out.update(found)
        for k in found:
            left[k] = None
    if len(out) < len(a):
        places = _places(b, dict(zip(a, sizes)), min_chars)
        for s, e, run in _tuples(a, sizes, min_chars):
            if run in places and not out.issuperset(range(s, e)):
                j = places[run]
                out.update(s + k for k in _aligned_blocks(a[s:e], sizes[s:e], b[j:j + e - s], min_chars))
    return sorted(out)


def _aligned_blocks(a: list[int], sizes: list[int], b: list[int], min_chars: int) -> list[int]:
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[k] for k in block) >= min_chars:
                out += block
            block = []
        block.append(i)
        last = (i, j)
    return out


def _align(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                later, sizes, at, first = (part.column(k).to_pylist() for k in (2, 3, 4, 5))
                removed = [[at[r][k] for k in common_blocks(later[r], sizes[r], first[r], min_chars)]
                           for r in range(part.num_rows)]
                some = np.flatnonzero([len(x) for x in removed])
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(some), part.column(1).take(some),
                         pa.array([removed[k] for k in some], pa.list_(pa.int32()))], ["doc_id", "row", "places"])
    return run


def line_sequences(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, row, hashes, sizes, places`` of the lines that aren't blank.

    Lines are compared without blanks at their ends; ``row`` is a hash of the text.
    """
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    kept = F.filter(F.transform(trimmed, lambda x, i: F.struct(
        F.xxhash64(x).alias("hash"), F.char_length(x).alias("size"), i.alias("place"))), lambda s: s["size"] > 0)
    return (docs.select("doc_id", F.xxhash64("text").alias("row"), kept.alias("lines")).filter(F.size("lines") > 0)
            .select("doc_id", "row", F.col("lines.hash").alias("hashes"), F.col("lines.size").alias("sizes"),
                    F.col("lines.place").alias("places")))


def _run_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column(2), batch.column(3)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            codes = mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            start, end = shortest_runs(sizes.flatten().to_numpy(zero_copy_only=False), starts, min_chars)
            key = PrefixHash(codes).of(start, end)
            doc = np.searchsorted(starts, start, "right") - 1
            order = np.lexsort((key, doc))
            doc, key, lines = doc[order], key[order], np.minimum(end - start, 2)[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
            if len(doc):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[new])), batch.column(1).take(pa.array(doc[new])),
                     pa.array(lines[new].astype(np.int32)), pa.array(key[new].view(np.int64))],
                    ["doc_id", "row", "lines", "key"])
    return run


def block_evidence(sequences: DataFrame, min_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """``doc_id, row, lines, key``: the different shortest runs of ``min_chars`` characters
    of each document; ``lines`` is 1 for one line, else 2."""
    kind = sequences.schema["doc_id"].dataType.simpleString()
    return sequences.select("doc_id", "row", "hashes", "sizes").mapInArrow(
        _run_keys(min_chars), f"doc_id {kind}, row long, lines int, key long")


def rare_evidence(sequences: DataFrame) -> DataFrame:
    """``doc_id, row, lines, key``: the different lines and pairs of consecutive lines of
    each document, of any size."""
    following = F.transform(F.col("hashes"), lambda x, i: F.struct(
        F.lit(2).alias("lines"), F.xxhash64(x, F.get("hashes", i + 1)).alias("key")))
    single = F.transform(F.col("hashes"), lambda x: F.struct(F.lit(1).alias("lines"), x.alias("key")))
    return sequences.select("doc_id", "row", F.explode(F.array_distinct(F.concat(
        single, F.slice(following, 1, F.greatest(F.size("hashes") - 1, F.lit(0)))))).alias("e")).select(
        "doc_id", "row", "e.lines", "e.key")


def overlapping_pairs(sequences: DataFrame, rare: int | None = None, min_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """``doc_id, row, first_id, first_row``: each document with the first documents it
    shares evidence with, by default every shortest run of ``min_chars`` characters.

    With ``rare`` the evidence is instead any line in at most so many documents and any
    two consecutive lines; a block may then lack a partner that holds it.
    """
    evidence = block_evidence(sequences, min_chars) if rare is None else rare_evidence(sequences)
    # the smallest id comes first, a null one last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    # written, so that the join's two sides are plain shuffles, which adaptive execution
    # can split where very many documents have one line
    shared = (evidence.groupBy("lines", "key").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
              .filter((F.col("n") > 1) & (F.lit(rare is None) | (F.col("lines") > 1) | (F.col("n") <= (rare or 0))))
              .select("lines", "key", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"))
              .checkpoint())
    return (evidence.join(shared, ["lines", "key"])
            .filter((F.col("first_id") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("first_id").isNotNull()))
            .select("doc_id", "row", "first_id", "first_row").distinct())


def remove_aligned_lines(docs: DataFrame, rare: int | None = None, min_chars: int = MIN_BLOCK_CHARS) -> DataFrame:
    """Delete from each document of ``docs(doc_id, text)`` the blocks of lines that it
    has in common with an earlier document: with ``rare`` None all of them, however
    frequent, else those of the pairs that ``overlapping_pairs`` finds with it.

    Returns all columns of ``docs`` with ``text`` cut, and ``n_lines`` (lines that
    aren't blank), ``n_removed`` and ``kept_lines``, one row per input row. Blocks
    are judged on the input; blank lines stay. Null text stays null; texts without
    a line have nothing to share; rows of one ``doc_id`` don't affect each other; a
    null ``doc_id`` is later than any. Empty input gives no rows. Columns of the
    input named like the three added ones are replaced.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    sequences = line_sequences(docs).checkpoint()
    later = sequences.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "hashes", "sizes", "places")
    first = sequences.select(F.col("doc_id").alias("_fid"), F.col("row").alias("_frow"),
                             F.col("hashes").alias("_first")).dropDuplicates(["_fid", "_frow"])
    later = later.dropDuplicates(["_id", "_row"])
    pairs = overlapping_pairs(sequences, rare, min_chars)
    aligned = (pairs.join(first, (F.col("first_id") == F.col("_fid")) & (F.col("first_row") == F.col("_frow")))
               .join(later, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
               .select("doc_id", "row", "hashes", "sizes", "places", "_first"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    removed = (aligned.mapInArrow(_align(min_chars), f"doc_id {kind}, row long, places array<int>")
               .groupBy("doc_id", "row").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("_places"))
               .select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_places"))
    added = ("n_lines", "n_removed", "kept_lines")
    # the input's other columns travel as one, so their names can't clash
    others = [c for c in docs.columns if c not in ("text", *added)]
    rows = docs.select("text", F.struct(*others).alias("_in")).withColumns({
        "_text_id": F.col("_in.doc_id"), "_text_row": F.xxhash64("text")})
    joined = rows.join(removed, F.col("_text_id").eqNullSafe(F.col("_id")) & (F.col("_text_row") == F.col("_row")),
                       "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.array_contains("_places", i))
    text = F.when(F.col("_places").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    full = F.size(F.filter(lines, lambda x: F.char_length(F.btrim(x, F.lit(" \t\r\x0b\x0c"))) > 0))
    n_lines = F.coalesce(F.when(F.col("text").isNotNull(), full), F.lit(0)).cast("long")
    n_removed = F.when(F.col("_places").isNull(), F.lit(0)).otherwise(F.size("_places")).cast("long")
    return joined.select(
        *[text.alias("text") if c == "text" else F.col("_in").getField(c).alias(c)
          for c in docs.columns if c not in added],
        n_lines.alias("n_lines"), n_removed.alias("n_removed"), (n_lines - n_removed).alias("kept_lines"))
