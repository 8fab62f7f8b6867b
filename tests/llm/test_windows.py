"""Suffix-array and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from riskspark.llm import windows
from riskspark.llm.arrays import BYTE_CODE, PrefixHash, Texts, sliding_min
from riskspark.llm.substring import remove_repeated_words
from riskspark.llm.suffix import common_prefix, equal_windows, merge_sort, remove_repeated_bytes

SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def earliest(rows, units, size):
    first = {}
    for doc_id, text in rows:
        u = units(text)
        for i in range(len(u) - size + 1):
            key = tuple(u[i:i + size]) if isinstance(u, list) else u[i:i + size]
            rank = (doc_id is None, doc_id or 0)
            first[key] = min(first.get(key, rank), rank)
    return first


def covered(rows, units, size):
    first = earliest(rows, units, size)
    for doc_id, text in rows:
        u = units(text)
        gone = [False] * len(u)
        for i in range(len(u) - size + 1):
            key = tuple(u[i:i + size]) if isinstance(u, list) else u[i:i + size]
            if first[key] < (doc_id is None, doc_id or 0):
                gone[i:i + size] = [True] * size
        yield doc_id, u, gone


def brute_bytes(rows, size):
    out = []
    for doc_id, u, gone in covered(rows, lambda t: (t or "").encode(), size):
        spans, kept = [], bytes(b for b, g in zip(u, gone) if not g)
        for i, g in enumerate(gone):
            if g and (i == 0 or not gone[i - 1]):
                spans.append([i, i + 1])
            elif g:
                spans[-1][1] = i + 1
        out.append((doc_id, len(u), tuple(map(tuple, spans)), kept))
    return out


def brute_words(rows, size):
    return [(doc_id, len(u), sum(gone), " ".join(w for w, g in zip(u, gone) if not g))
            for doc_id, u, gone in covered(rows, lambda t: words_of(t or ""), size)]


def corpus(n=60, seed=3):
    """Texts of few words with shared passages, copies, near copies and periodic stretches."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)] + ["é", "漢字"]
    passage = " ".join(rng.choices(vocabulary, k=90))
    rows = []
    for k in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 140)))
        if k % 3 == 0:
            cut = rng.randint(0, len(text))
            text = text[:cut] + " " + passage + "\n" + text[cut:]
        if k % 7 == 0 and rows:
            text = rng.choice(rows)[1]
        if k % 11 == 0:
            text = "ab " * rng.randint(60, 90)
        rows.append((k, text))
    rng.shuffle(rows)
    return rows


def key(row):
    return (row[0] is None, row[0] or 0, str(row[1:]))


def found_bytes(df):
    return sorted(((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["removed"]), bytes(r["kept"]))
                   for r in df.collect()), key=key)


def found_words(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=key)


@pytest.mark.parametrize("batch_bytes, hot", [(4 << 20, 1 << 14), (3000, 40)])
def test_against_brute_force(documents, monkeypatch, batch_bytes, hot):
    """Also with many small batches and minimisers dealt as single windows."""
    monkeypatch.setattr(windows, "HOT_WINDOWS", hot)
    monkeypatch.setattr(windows.covered_by_earlier, "__defaults__", (batch_bytes,))
    rows = corpus()
    docs = documents(rows)
    assert found_bytes(remove_repeated_bytes(docs)) == sorted(brute_bytes(rows, 50), key=key)
    assert found_words(remove_repeated_words(docs)) == sorted(brute_words(rows, 50), key=key)


def test_odd_rows(documents, odd_rows, clashing):
    long_ = "many words of a long text that come again " * 20
    rows = [(r[0], r[1]) for r in odd_rows] + [(10, long_), (11, long_), (None, long_), (11, long_)]
    docs = documents(rows)
    short = [r for r in rows if len(r[1] or "") < 100_000]
    want = sorted(brute_bytes(short, 50), key=key)
    assert [r for r in found_bytes(remove_repeated_bytes(docs)) if r[0] not in (4, 5)] == want
    want = sorted(brute_words(short, 50), key=key)
    assert [r for r in found_words(remove_repeated_words(docs)) if r[0] not in (4, 5)] == want
    assert remove_repeated_bytes(clashing).count() == len(odd_rows)
    assert remove_repeated_words(clashing).count() == len(odd_rows)
    empty = documents([])
    assert remove_repeated_bytes(empty).count() == 0 and remove_repeated_words(empty).count() == 0


def test_merge_sort_orders_suffixes():
    rng = random.Random(5)
    data = np.frombuffer("".join(rng.choices("ab", k=600)).encode(), np.uint8)
    at = np.arange(550)
    segment = np.array([rng.randint(0, 3) for _ in at])
    order = merge_sort(data, PrefixHash(BYTE_CODE[data]), at, segment, 50)
    raw = data.tobytes()
    keys = [(segment[k], raw[k:k + 50]) for k in order]
    assert keys == sorted(keys)
    assert sorted(order.tolist()) == list(range(550))
    a, b = np.array([0, 5, 7]), np.array([3, 5, 20])
    want = []
    for i, j in zip(a, b):
        n = 0
        while n < 50 and raw[i + n] == raw[j + n]:
            n += 1
        want.append(n)
    assert common_prefix(PrefixHash(BYTE_CODE[data]), a, b, 50).tolist() == want


class Counted(np.ndarray):
    """An array that counts the elements looked up in it."""

    looked_up = 0

    def __getitem__(self, at):
        out = np.asarray(self).__getitem__(at)
        Counted.looked_up += np.size(out)
        return out


def test_suffix_sort_looks_up_each_hash_a_few_times(monkeypatch):
    """Not once per comparison: the work on a bucket grows with its windows, whatever they share."""
    monkeypatch.setattr(Counted, "looked_up", 0)
    rng = random.Random(8)
    raw = b" ".join(rng.choice((b"one passage that many texts have", b"another", b"more")) for _ in range(400))
    data = np.frombuffer(raw, np.uint8)
    prefix = PrefixHash(BYTE_CODE[data])
    prefix.sums = prefix.sums.view(Counted)
    at = np.arange(len(data) - 50)
    order = merge_sort(data, prefix, at, np.zeros(len(at), np.int64), 50)
    keys = [raw[k:k + 50] for k in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == at.tolist()
    assert Counted.looked_up <= 4 * len(at)


def test_equal_windows_by_their_bytes(monkeypatch):
    """Windows that only share a hash are told apart, in a family and beside another one."""
    raw = b"x" * 60 + b"y" * 60 + b"x" * 60
    data = np.frombuffer(raw, np.uint8)
    win = np.concatenate([np.arange(10), 60 + np.arange(10), 120 + np.arange(10)])
    family = np.repeat([0, 1, 0], 10)
    units = windows.byte_units(Texts(0, 1, data, np.array([0]), np.array([len(raw)])))
    group = equal_windows(units, win, family, 50)
    assert [len(set(group[family == f])) for f in (0, 1)] == [1, 1] and group[0] != group[10]
    units.codes = np.zeros_like(units.codes)  # every hash alike
    group = equal_windows(units, win, np.zeros(30, np.int64), 50)
    assert len(set(group[[0, 9, 20, 29]])) == 1 and len({group[0], *group[10:20]}) == 2


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 100, 57).astype(np.uint64)
    for width in (1, 2, 7, 27, 57):
        assert sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(58 - width)]


def test_whole_table(spark):
    """The registered queries over a whole table, by brute force."""
    from riskspark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, n, sum(e - s for s, e in spans), len(spans), sha(kept)) for i, n, spans, kept in brute_bytes(rows, 50)]
    assert sorted(map(tuple, QUERIES["op5_suffix_dedup"](spark, sf).collect())) == sorted(want)
    want = [(i, n, r, sha(kept.encode())) for i, n, r, kept in brute_words(rows, 50)]
    assert sorted(map(tuple, QUERIES["op10_substring_dedup"](spark, sf).collect())) == sorted(want)


def test_long_words_of_two_symbols(documents):
    """Words on which polynomial hashes of 64-bit integers agree are different words."""
    from riskspark.llm.substring import remove_repeated_words
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    side = [f"w{k}" for k in range(40)]
    texts = [" ".join([*side, middle, *side]) for middle in (one, other, one)]
    got = remove_repeated_words(documents(list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {0: 0, 1: 0, 2: 81}
