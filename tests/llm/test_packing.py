"""Packing: pieces and digests text by text, places without gaps, the search against all packings."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest

from riskspark.llm.packing import best_fit, complete_bins, fillings, lower_bound, pack_documents
from riskspark.llm.tokens import BYTE_BPE, byte_bpe, tokenizer_file


def brute_pieces(rows, capacity):
    """(doc_id, piece, start, length, crc32) of every row, each text encoded whole."""
    out = Counter()
    tokenizer = byte_bpe(tokenizer_file(BYTE_BPE), False)
    for row in rows:
        ids = [*tokenizer.encode(row[1] or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % capacity or capacity
        starts = [0, *range(cut, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            out[(row[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    return out


def check(got, rows, capacity):
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == brute_pieces(rows, capacity)
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def fewest(lengths, capacity):
    """The least number of sequences, by trying every place for every piece."""
    lengths = tuple(sorted(lengths, reverse=True))

    @cache
    def least(k, spaces):
        if k == len(lengths):
            return len(spaces)
        best = least(k + 1, tuple(sorted((*spaces, capacity - lengths[k]))))
        for i, space in enumerate(spaces):
            if space >= lengths[k] and (not i or spaces[i - 1] != space):
                best = min(best, least(k + 1, tuple(sorted((*spaces[:i], space - lengths[k], *spaces[i + 1:])))))
        return best
    return least(0, ())


def packed(plan, capacity):
    used = Counter()
    for filling, n in plan:
        assert n > 0 and sum(length * copies for length, copies in filling) <= capacity
        for length, copies in filling:
            used[length] += n * copies
    return used, sum(n for _, n in plan)


def test_search_finds_the_least_number():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts = Counter(lengths)
        used, n = packed(complete_bins(counts, capacity), capacity)
        want = fewest(lengths, capacity)
        assert used == counts and n == want
        assert lower_bound(counts, capacity) <= want
        used, fit = packed(best_fit(counts, capacity), capacity)
        assert used == counts and fit >= want


def test_search_beats_best_fit_on_full_sequences():
    """Full sequences cut at random: the search puts them together again, best fit often doesn't."""
    rng, least, fit = random.Random(6), 0, 0
    for _ in range(40):
        counts = Counter()
        for _ in range(12):
            a, b = sorted(rng.sample(range(1, 60), 2))
            counts.update([a, b - a, 60 - b])
        least += packed(complete_bins(counts, 60), 60)[1] == 12
        fit += packed(best_fit(counts, 60), 60)[1] == 12
    assert least == 40 and fit < 30


def test_fillings_are_undominated():
    # 6 beside 4 is full; 3 + 1 gives way to 4, 2 + 2 too
    assert fillings({6: 1, 4: 1, 3: 1, 2: 2, 1: 1}, [1, 2, 3, 4, 6], 6, 10, 10, 9, 1000) == [(0, ((6, 1), (4, 1)))]
    found = fillings({7: 1, 2: 1, 1: 2}, [1, 2, 7], 7, 10, 10, 9, 1000)
    assert found == [(0, ((7, 1), (2, 1), (1, 1)))]


def test_many_documents_of_few_lengths():
    """The plan's size follows the number of lengths, not of documents."""
    rng = random.Random(2)
    small = {length: rng.randint(1, 50) for length in range(1, 1025)}
    large = {length: 10 ** 7 * n for length, n in small.items()}
    plan = complete_bins(large, 1024)
    used, n = packed(plan, 1024)
    assert used == large
    assert n <= 1.005 * lower_bound(large, 1024) and n <= packed(best_fit(large, 1024), 1024)[1]
    assert len(plan) < 7_200


@pytest.mark.parametrize("capacity", [16, 1024])
def test_documents_table(spark, capacity):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = pack_documents(table.repartition(3), capacity).collect()
    n = check(got, table.select("doc_id", "text").collect(), capacity)
    counts = Counter(r["length"] for r in got)
    assert n <= packed(best_fit(counts, capacity), capacity)[1]
    assert n <= 1.01 * lower_bound(counts, capacity) + 1


def test_special_tokens_and_ids(spark, documents):
    rows = [(1, "a<|endoftext|> b <|endoftext|>"), (2, "  two  spaces "), (3, "é  x\n\n y"), (4, "word " * 3000)]
    got = pack_documents(documents(rows), with_ids=True).collect()
    check(got, rows, 1024)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    assert 50256 in np.frombuffer(next(r["ids"] for r in got if r["doc_id"] == 1), "<u4")


def test_odd_rows(documents, odd_rows, clashing):
    check(pack_documents(documents(odd_rows)).collect(), odd_rows, 1024)
    check(pack_documents(clashing).collect(), odd_rows, 1024)
    assert pack_documents(documents([])).count() == 0
    assert check(pack_documents(documents([(None, None)] * 3000)).collect(), [(None, None)] * 3000, 1024) == 3
