"""Cross-tokenizer alignment: whole texts encoded by both tokenizers, groups and counts one by one."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskspark.llm.token_alignment import align_tokenizers
from riskspark.llm.tokens import (BYTE_BPE, PIECE_BPE, byte_bpe, byte_bpe_bytes, piece_bpe, piece_bpe_bytes,
                                  tokenizer_file)

A, B = tokenizer_file(BYTE_BPE), tokenizer_file(PIECE_BPE)
PARTS = [" ", "  ", "\n", "\t", "a", "b", "'s", "é", "ü", "漢", " ", " ", "　", "\x00", "12", ".", ",",
         "<|endoftext|>", "<s>", "</s>", "<0x41>", "😀", "the", " the", "\x85", "​", "ﬁ", "Ａ", "é", "\r", "<unk>",
         "\x1c", "\x7f", '"', " ancient", " Wort", " überall"]


def groups(text):
    """(A tokens, B tokens) of each group of a text, None if its tokens aren't its bytes."""
    whole = (" " + text).encode()
    a, b = byte_bpe(A, True).encode(" " + text, add_special_tokens=False).ids, piece_bpe(B).encode(text)
    sides = []
    for ids, of in ((a, byte_bpe_bytes(A)), (b, piece_bpe_bytes(B))):
        if b"".join(of[i] for i in ids) != whole:
            return None
        end, ends = 0, []
        for i in ids:
            end += len(of[i])
            ends.append(end)
        sides.append((ids, ends))
    out, at = [], [0, 0]
    for cut in sorted(set(sides[0][1]) & set(sides[1][1])):
        to = [side[1].index(cut) + 1 for side in sides]
        out.append(tuple(tuple(sides[s][0][at[s]:to[s]]) for s in (0, 1)))
        at = to
    return out


def brute(texts):
    found = [groups(t) if t else None for t in texts]
    count = Counter((a[-1], b[-1]) for g in found if g for a, b in g)
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for g in found:
        if not g:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links),
                    sum(count[x] == highest[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out, count


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("batch_bytes", [200, 8 << 20])
def test_against_whole_texts(spark, documents, batch_bytes):
    texts = random_texts(batch_bytes, 1_500) + ["a▁b c", "▁", None, "", " ", "  x ", "x" * 5_000]
    docs, pairs = align_tokenizers(documents(list(enumerate(texts))).repartition(3), batch_bytes=batch_bytes)
    want, count = brute(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in docs.collect()}
    assert [got[i] for i in range(len(texts))] == want
    rows = pairs.collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in rows} == dict(count)
    of_a, of_b = byte_bpe_bytes(A), piece_bpe_bytes(B)
    assert any(r["exact"] for r in rows) and any(not r["exact"] for r in rows)
    assert all(of_a[r["a_id"]] == of_b[r["b_id"]] for r in rows if r["exact"])


def test_documents_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    want, _ = brute([t for _, t in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in align_tokenizers(table)[0].collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}
    assert sum(w[2] > 0 for w in want) > 0.9 * len(want)


def test_odd_rows(spark, documents, odd_rows, clashing):
    want, _ = brute([r[1] for r in odd_rows])
    expected = Counter((r[0], *w) for r, w in zip(odd_rows, want))
    assert Counter(map(tuple, align_tokenizers(documents(odd_rows))[0].collect())) == expected
    clash = clashing.withColumns({c: F.lit("x") for c in ("links", "pairs", "counts", "code", "n_a", "best")})
    assert Counter(map(tuple, align_tokenizers(clash)[0].collect())) == expected
    docs, pairs = align_tokenizers(documents([]))
    assert docs.count() == 0 and pairs.count() == 0
    nothing = align_tokenizers(documents([(1, None), (2, "")]))[0].collect()
    assert [tuple(r)[1:] for r in nothing] == [(0, 0, 0, 0, 0, 0, "")] * 2
