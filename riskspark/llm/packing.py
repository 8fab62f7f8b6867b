"""Best-fit packing of documents into sequences by bin completion.

Only lengths matter to a packing, and there are at most ``capacity`` of them. So
the search works on the counts of each length, not on documents: a filling (a
multiset of lengths for one sequence) is used for as many sequences as the
counts allow. Documents then look up their place: each piece has a rank among
those of its length, and a filling owns ranges of ranks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.tokens import BYTE_BPE, WordTable, byte_bpe_ids, tokenizer_file, word_runs
from riskspark.session import ensure_checkpoint_dir

#: A filling: (length, copies) by falling length. A plan: (filling, number of sequences).
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: for each k, lengths over ``capacity - k`` stand alone and
    what lengths of at least k exceed the space beside the other large ones needs more."""
    n = np.zeros(capacity + 2, np.int64)
    for length, count in counts.items():
        n[length] = count
    total = n * np.arange(capacity + 2)
    n_upto, sum_upto = np.cumsum(n), np.cumsum(total)
    half, best = capacity // 2, 0
    for k in range(0, half + 1):
        large = n_upto[capacity] - n_upto[half]
        beside = n_upto[capacity - k] - n_upto[half]
        beside_sum = sum_upto[capacity - k] - sum_upto[half]
        small_sum = sum_upto[half] - (sum_upto[k - 1] if k else 0)
        rest = small_sum - (beside * capacity - beside_sum)
        best = max(best, int(large) + max(0, -int(-rest // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: each length goes where it leaves the least space."""
    open_: dict[int, list[tuple[Filling, int]]] = {capacity: []}
    done: Plan = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        spaces = sorted(s for s in open_ if s >= length and open_[s])
        new = []
        for space in spaces:
            most = space // length
            while left and open_[space]:
                filling, n = open_[space].pop()
                copies = min(most, left)
                used = min(n, left // copies)
                if used < n:
                    open_[space].append((filling, n - used))
                new.append((space - copies * length, ((*filling, (length, copies)), used)))
                left -= used * copies
        most = capacity // length
        if left >= most:
            new.append((capacity - most * length, (((length, most),), left // most)))
            left %= most
        if left:
            new.append((capacity - left * length, (((length, left),), 1)))
        for space, group in new:
            open_.setdefault(space, []).append(group)
    for groups in open_.values():
        done.extend(groups)
    return done


def fillings(counts: dict[int, int], lengths: list[int], largest: int, capacity: int, most_waste: int,
             width: int, effort: int) -> list[tuple[int, Filling]]:
    """The best ``width`` undominated fillings around ``largest`` as (waste, filling), least waste first.

    A filling is dominated if some of its lengths could give way to one available length that is as
    long together, or longer and still fits: what it frees can go wherever the longer one would have gone.
    ``lengths``: the available ones, rising. ``effort`` bounds the sets looked at.
    """
    available = 0
    for length in lengths:
        available |= 1 << length
    found: list[tuple[int, Filling]] = []
    seen = 0

    def dominated(chosen: list[int], space: int) -> bool:
        used = Counter(chosen)
        one, several, any_ = 0, 0, 1  # sums of one, of two or more, of any number of the chosen, as bits
        for length in chosen:
            several |= (one | several) << length
            one |= 1 << length
        free = available
        for length, n in used.items():
            if counts[length] - (length == largest) <= n:
                free &= ~(1 << length)
        longer = 0
        for step in range(1, space + 1):
            longer |= (one << step) | (several << step)
        return bool((several | longer) & free)

    def search(chosen: list[int], space: int, upto: int) -> None:
        nonlocal seen
        k = bisect_right(lengths, min(upto, space)) - 1
        full = True
        while k >= 0 and seen < effort and not (len(found) >= width and found[-1][0] == 0):
            length = lengths[k]
            used = chosen.count(length) + (length == largest)
            if counts[length] > used:
                full = False
                seen += 1
                search([*chosen, length], space - length, length)
                if length == space:  # it fills the sequence alone, so it dominates all other ends
                    return
            k -= 1
        if full and space <= most_waste and (not found or not dominated(chosen, space)):
            whole = Counter(chosen)
            whole[largest] += 1
            found.append((space, tuple(sorted(whole.items(), reverse=True))))
            found.sort(key=lambda f: f[0])
            del found[width:]

    search([], capacity - largest, largest)
    return found


def complete_bins(counts: dict[int, int], capacity: int, width: int = 6, effort: int = 400,
                  expansions: int = 2_000) -> Plan:
    """Branch and bound by bin completion: a plan of few sequences for ``counts`` of each length.

    The largest length left is completed by each undominated filling in turn, the fullest first, used for
    as many sequences as the counts allow. A branch ends where its waste leaves no way below the incumbent,
    which is best-fit at first. The search stops when the lower bound is met or after ``expansions`` steps;
    every length is packed in any case, the limits bound effort only.
    """
    counts = {length: n for length, n in counts.items() if n}
    if not counts:
        return []
    bound, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    n_best = sum(n for _, n in best)
    total = sum(length * n for length, n in counts.items())
    left, path = dict(counts), []

    def options(waste: int) -> Iterator[tuple[int, Filling]]:
        lengths = sorted(left)
        spare = (n_best - 1) * capacity - total - waste  # more waste than this can't beat the incumbent
        if spare < 0:
            return iter(())
        return iter(fillings(left, lengths, lengths[-1], capacity, spare, width, effort))

    def change(filling: Filling, n: int) -> None:
        for length, copies in filling:
            left[length] = left.get(length, 0) - n * copies
            if not left[length]:
                del left[length]

    # each level: the fillings not tried yet, the one in use, its number, the waste so far
    stack = [[options(0), None, 0, 0]]
    while stack and n_best > bound and expansions:
        level = stack[-1]
        if level[1] is not None:
            change(level[1], -level[2])
            path.pop()
            level[1] = None
        waste, filling = next(level[0], (0, None))
        if filling is None:
            stack.pop()
            continue
        expansions -= 1
        spare = (n_best - 1) * capacity - total - level[3]
        n = min(left[length] // copies for length, copies in filling)
        if waste:
            n = min(n, max(1, spare // waste))
        if n * waste > spare:
            continue
        change(filling, n)
        path.append((filling, n))
        level[1], level[2] = filling, n
        if left:
            stack.append([options(level[3] + n * waste), None, 0, level[3] + n * waste])
        else:
            used = sum(m for _, m in path)
            if used < n_best:
                best, n_best = list(path), used
    return best


def places(plan: Plan) -> np.ndarray:
    """The plan as rows (length, first rank, first sequence, sequences, offset), by length and rank:
    piece ``rank`` of a length is copy ``(rank - first rank) // sequences`` in its sequence."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for filling, n in plan:
        offset = 0
        for length, copies in filling:
            rows.append((length, taken[length], sequence, n, offset))
            taken[length] += n * copies
            offset += length * copies
        sequence += n
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5)


def _cut(column: pa.Array, ids, capacity: int, last_id: int, with_ids: bool) -> Iterator[tuple]:
    """(row, piece, start, length, crc32[, ids]) of each text of an Arrow column."""
    end = np.uint32(last_id).tobytes()
    for run in word_runs(column):
        known = ids.get(run.words)
        codes, first = run.codes.tolist(), run.first.tolist()
        for row in range(run.hi - run.lo):
            data = b"".join([known[c] for c in codes[first[row]:first[row + 1]]]) + end
            n = len(data) // 4
            cut = n % capacity or capacity
            starts = [0, *range(cut, n, capacity)]
            for piece, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                part = data[4 * a:4 * b]
                yield (run.lo + row, piece, a, b - a, zlib.crc32(part), *((part,) if with_ids else ()))


def document_pieces(docs: DataFrame, capacity: int = 1024, last_id: int = 2, tokenizers: str | None = None,
                    with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids]`` and ``task, nth``: the piece's place among the
    pieces of its length that its task made."""
    from pyspark import TaskContext
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    fields += (", ids binary" if with_ids else "") + ", task int, nth long"

    def cut(batches):
        path = tokenizer_file(BYTE_BPE, tokenizers)

        def make(words):
            out = [ids.astype("<u4").tobytes() for ids in byte_bpe_ids(path, words, False)]
            return out, sum(map(len, out))
        ids, task, so_far = WordTable(make), TaskContext.get().partitionId(), Counter()

        def batch_of(rows, doc_id):
            row, *columns = map(list, zip(*rows))
            lengths = columns[2]
            nth = []
            for length in lengths:
                nth.append(so_far[length])
                so_far[length] += 1
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.record_batch([doc_id.take(pa.array(row)),
                                    *[pa.array(c, t) for c, t in zip(columns, types)],
                                    pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                                   names=[f.split()[0] for f in fields.split(", ")])
        for batch in batches:
            doc_id, rows, size = batch.column(0), [], 0
            for row in _cut(batch.column(1), ids, capacity, last_id, with_ids):
                rows.append(row)
                size += 40 + 4 * row[3] * with_ids
                if size > 8 << 20:
                    yield batch_of(rows, doc_id)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows, doc_id)
    return source.mapInArrow(cut, fields)


def pack_documents(docs: DataFrame, capacity: int = 1024, last_id: int = 2, tokenizers: str | None = None,
                   with_ids: bool = False) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences of at most ``capacity`` ids, as few as the search finds.

    Returns one row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if
    asked for, ``ids`` (little-endian unsigned 32-bit). A document's ids end with ``last_id``; only a
    document of more than ``capacity`` ids is cut, its first piece takes what is left over.
    ``tokenizers`` is the folder of the tokenizer files (null: the installed package's).

    Null and empty texts have the one id ``last_id``; a very long text gives one row per ``capacity`` ids;
    repeated rows, rows without id and equal lengths are pieces like any other and are told apart by their
    place in the input, not by their key. An empty table gives no rows. Other columns are ignored.

    The driver holds a count per length (at most ``capacity`` rows). Each change of filling uses up a length
    but for fewer copies than the filling has of it, so the table of places sent to the tasks is bounded by
    the capacity too, whatever the number of documents.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    pieces = document_pieces(docs, capacity, last_id, tokenizers, with_ids).checkpoint()
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(complete_bins(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(F.col("length").alias("_length"), F.col("task").alias("_task"),
                              F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = (pieces.join(offsets, (F.col("length") == F.col("_length")) & (F.col("task") == F.col("_task")))
              .withColumn("rank", F.col("nth") + F.col("_before")).drop("_length", "_task", "_before", "nth", "task"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.select(*out).schema)

    def place(batches):
        lengths, firsts, sequences, numbers, offset_of = table.value.T
        key = (lengths << 44) + firsts
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(key, (length << 44) + rank, "right") - 1
            i = rank - firsts[k]
            yield pa.record_batch([*[batch.column(c) for c in out], pa.array(sequences[k] + i % numbers[k]),
                                   pa.array(offset_of[k] + i // numbers[k] * length)],
                                  names=[*out, "sequence_id", "offset"])
    return ranked.select(*out, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")
