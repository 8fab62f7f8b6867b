"""Line dedup against a plain Python account of its rules."""

import random

from riskspark.llm.line_dedup import common_blocks, patience, remove_aligned_lines

BLANK = " \t\r\x0b\x0c"


def lines_of(text):
    return [(k, x.strip(BLANK)) for k, x in enumerate((text or "").split("\n")) if x.strip(BLANK)]


def brute(rows, rare, min_chars):
    """All pairs by evidence to the first document, one alignment each."""
    docs = {}
    for doc_id, text in rows:
        docs.setdefault((doc_id is None, doc_id, text), lines_of(text))
    evidence = {}
    for d, lines in docs.items():
        seq = [x for _, x in lines]
        for e in {(x,) for x in seq} | set(zip(seq, seq[1:])):
            evidence.setdefault(e, set()).add(d)
    rank = lambda d: (d[0], d[1] or 0)
    removed = {d: set() for d in docs}
    for e, who in evidence.items():
        if len(who) < 2 or (len(e) == 1 and len(who) > rare):
            continue
        lowest = min(map(rank, who))
        for first in [d for d in who if rank(d) == lowest][:1]:
            for d in who:
                if rank(d) > lowest:
                    a, b = [x for _, x in docs[d]], [x for _, x in docs[first]]
                    removed[d] |= {docs[d][k][0] for k in common_blocks(a, list(map(len, a)), b, min_chars)}
    return removed


def test_against_brute_force(documents):
    rng = random.Random(10)
    pool = [f"line {k} " + "x" * rng.randint(0, 30) for k in range(60)]
    common = ["a line that all have", "and one that follows it"]
    rows = []
    for k in range(70):
        lines = rng.sample(pool, rng.randint(0, 9)) if k % 2 else pool[k % 40:k % 40 + rng.randint(0, 8)]
        if k % 3 == 0:
            lines = lines[:2] + common[:1 + (k % 2)] + lines[2:]
        rows.append((k, "\n".join(x + rng.choice(["", " ", "\r"]) for x in lines) + rng.choice(["", "\n", "\n\n"])))
    rows += [(100, rows[4][1]), (101, rows[4][1]), (None, rows[4][1])]
    got = remove_aligned_lines(documents(rows), rare=6, min_chars=20).collect()
    want = brute(rows, 6, 20)
    assert any(want.values())
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        gone = want[(r["doc_id"] is None, r["doc_id"], text)]
        assert r["n_lines"] == len(lines_of(text)) and r["n_removed"] == len(gone), r
        assert r["text"] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        assert r["kept_lines"] == r["n_lines"] - r["n_removed"]


def test_patience():
    a, b = list("abcdXefg"), list("abQcdefYg")
    assert [(a[i], b[j]) for i, j in patience(a, b)] == [(c, c) for c in "abcdefg"]
    assert patience([], [1]) == [] and patience([1, 2], [3]) == []
    # moved lines: the longest chain in order wins
    assert [i for i, _ in patience([1, 2, 3, 9, 4], [9, 1, 2, 3, 4])] == [0, 1, 2, 4]
    rng = random.Random(1)
    for _ in range(300):
        a, b = rng.choices(range(9), k=rng.randint(0, 14)), rng.choices(range(9), k=rng.randint(0, 14))
        m = patience(a, b)
        assert all(a[i] == b[j] for i, j in m)
        assert all(i < k and j < n for (i, j), (k, n) in zip(m, m[1:]))
        assert patience(a, a) == [(k, k) for k in range(len(a))]


def test_blocks():
    a, b = [1, 2, 3, 4, 5], [1, 2, 9, 4, 8, 5]
    assert common_blocks(a, [10, 10, 10, 30, 5], b, 20) == [0, 1, 3]
    assert common_blocks(a, [10] * 5, b, 21) == []


def test_a_frequent_line_alone_is_no_evidence(documents):
    notice = "This very common notice stands in all of the documents."
    rows = [(k, f"own line {k}\n{notice}\nother line {k}") for k in range(12)]
    assert sum(r["n_removed"] for r in remove_aligned_lines(documents(rows), rare=5).collect()) == 0
    assert sum(r["n_removed"] for r in remove_aligned_lines(documents(rows), rare=12).collect()) == 11
    # a group of copies is found however large it is
    copies = [(k, "first line of the copies, which is long enough\nsecond line of the copies") for k in range(12)]
    got = {r["doc_id"]: r["n_removed"] for r in remove_aligned_lines(documents(copies), rare=5).collect()}
    assert got == {0: 0, **{k: 2 for k in range(1, 12)}}


def test_odd_rows(documents, odd_rows, clashing):
    got = remove_aligned_lines(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["text"] is None and r["n_lines"] == 0 for r in got if r["doc_id"] == 1)
    assert sorted(r["text"] for r in got if r["doc_id"] == 6) == ["same row"] * 2
    out = remove_aligned_lines(clashing)
    assert out.count() == len(odd_rows) and set(clashing.columns) <= set(out.columns)
    assert remove_aligned_lines(documents([])).count() == 0


def all_pairs(rows, min_chars):
    """Lines inside runs of ``min_chars`` characters that any earlier document has."""
    removed = []
    for doc_id, text in rows:
        a, gone = lines_of(text), set()
        for other, earlier in rows:
            if other is None or (doc_id is not None and other >= doc_id):
                continue
            b = [x for _, x in lines_of(earlier)]
            for i in range(len(a)):
                for j in range(len(b)):
                    n = 0
                    while i + n < len(a) and j + n < len(b) and a[i + n][1] == b[j + n]:
                        n += 1
                    if sum(len(x) for _, x in a[i:i + n]) >= min_chars:
                        gone |= {k for k, _ in a[i:i + n]}
        removed.append(gone)
    return removed


def test_against_all_pairs(documents):
    rng = random.Random(31)
    pool = [f"l{k} " + "y" * rng.choice([0, 3, 8, 15, 30]) for k in range(14)]
    rows = [(k if k < 50 else None, "\n".join(rng.choices(pool, k=rng.randint(0, 9)) + [f"own {k}"])) for k in range(53)]
    want = dict(zip(rows, all_pairs(rows, 25)))
    assert sum(map(bool, want.values())) > 10
    got = remove_aligned_lines(documents(rows), min_chars=25).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in got) == sorted(
        (i is None, i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i, t])) for i, t in rows)


def removed_of(documents, texts):
    return [r["n_removed"] for r in sorted(remove_aligned_lines(documents(list(enumerate(texts)))).collect(),
                                           key=lambda r: r["doc_id"])]


def test_a_long_line_goes_however_frequent(documents):
    notice = "This very common notice stands in all of the documents."
    assert removed_of(documents, [f"own line {k}\n{notice}\nother line {k}" for k in range(150)]) == [0] + [1] * 149


def test_a_block_is_found_in_a_document_that_holds_it_whole(documents):
    a, b, c = ("a" * 20, "b" * 20, "c" * 20)
    texts = [f"{a}\n{b}", f"{b}\n{c}", f"{a}\n{b}\n{c}", f"{a}\n{b}\n{c}"]
    assert removed_of(documents, texts) == [0, 0, 0, 3]
    x, y = "x" * 60, "y" * 60
    assert removed_of(documents, [f"{y}\none\n{x}", f"{x}\ntwo\n{y}", f"{x}\nthree\n{y}"]) == [0, 2, 2]


def test_a_block_that_a_document_holds_twice(documents):
    block = ["first line of the block, long enough", "second line of the block"]
    a, b = ["u1", *block, "u2"], ["v1", *block, "v2", *block, "v3"]
    assert patience(list(range(4)), [7, 1, 2, 8, 1, 2, 9]) == [(1, 1), (2, 2)]
    assert removed_of(documents, ["\n".join(b), "\n".join(a)]) == [0, 2]
    assert removed_of(documents, ["\n".join(a), "\n".join(b)]) == [0, 4]


def test_alignment_decides(documents, monkeypatch):
    """Nothing is deleted that no alignment returns."""
    from riskspark.llm import line_dedup
    block = ["first line of the block, long enough", "second line of the block"]
    a, b = ["u1", *block, "u2", *block], ["v1", *block, "v2"]
    sizes = [len(x) for x in a]
    assert common_blocks(a, sizes, b, 50) == [1, 2, 4, 5]
    monkeypatch.setattr(line_dedup, "patience", lambda x, y: [])
    assert common_blocks(a, sizes, b, 50) == []
    monkeypatch.undo()
    rng = random.Random(12)
    for _ in range(400):  # every shared run is found: moved, repeated, overlapping
        a, b = rng.choices(range(6), k=rng.randint(0, 12)), rng.choices(range(6), k=rng.randint(0, 12))
        want = {k for i in range(len(a)) for j in range(len(b)) for n in range(2, 13)
                if a[i:i + n] == b[j:j + n] and i + n <= len(a) and j + n <= len(b) for k in range(i, i + n)}
        assert common_blocks(a, [30] * len(a), b, 50) == sorted(want)
