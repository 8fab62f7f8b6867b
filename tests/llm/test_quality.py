"""Quality counts against brute force; distances and verdicts."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskspark.llm.arrays import text_pieces
from riskspark.llm.quality import js_distance, quality_rules, references, repeated_words, word_ids

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
    inside = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k:k + 8])] > 1:
            inside |= set(range(k, k + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts(documents):
    rng = random.Random(12)
    rows = []
    for k in range(120):
        words = rng.choices(["a", "bé", "#x", "漢", "|", "<>", "long" * 5], k=rng.randint(0, 60))
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n"]) for w in words)
        if k % 3 == 0:
            text = (text[:40] + "\n") * 3 + text
        rows.append((k, text))
    got = {r["doc_id"]: r for r in quality_rules(documents(rows)).collect()}
    for k, text in rows:
        assert tuple(got[k][c] for c in COLUMNS) == brute(text), (k, text)
    assert not any(r["kept"] and r["base_failed"] for r in got.values())


def test_repeated_words_of_colliding_hashes(monkeypatch):
    """With a useless hash the windows themselves decide."""
    import riskspark.llm.quality as q
    texts = ["a b c d e f g h i a b c d e f g h", "a b c d e f g h i j k l", "x " * 12]
    piece = next(text_pieces(pa.array(texts)))
    ids, _ = word_ids(piece)
    first = piece.words()[2]
    want = [brute(t)[4] for t in texts]
    assert repeated_words(ids, first).tolist() == want
    monkeypatch.setattr(q, "mix", lambda h: h * np.uint64(0))
    assert repeated_words(ids, first).tolist() == want


def test_js_distance():
    p, q = np.array([[1.0, 0], [1, 1], [0, 0], [3, 1]]), np.array([1.0, 1])
    def js(a, b):
        m = [(x + y) / 2 for x, y in zip(a, b)]
        kl = lambda u: sum(x * math.log2(x / z) for x, z in zip(u, m) if x)
        return math.sqrt((kl(a) + kl(b)) / 2)
    assert js_distance(p, q) == pytest.approx([js([1, 0], [.5, .5]), 0, 0, js([.75, .25], [.5, .5])])
    assert js_distance(np.array([[1.0, 0]]), np.array([0.0, 5])) == pytest.approx([1.0])


def test_references_count_every_document(documents):
    rows = [(k, "the cat the", "en") for k in range(5)] + [(9, "le chat", "fr"), (10, "??", None)]
    refs = references(documents(rows))
    assert set(refs.classes) == {"en", "fr", None}
    assert refs.words["en"] == {b"the": 0, b"cat": 1} and refs.word_counts["en"] == [10, 5, 0]
    assert refs.classes["en"].sum() == 55 and refs.classes[None].sum() == 55 + 7 + 2
    assert refs.word_counts[None][0] == 10 and sum(refs.word_counts[None]) == 18


def test_verdicts(spark):
    """Clean labelled documents stay, most bad ones go."""
    from riskspark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_quality"](spark, sf).collect() if r["doc_id"] in good]
    clean = [r["kept"] for r in rows if good[r["doc_id"]] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if good[r["doc_id"]] == 0]
    assert np.mean(clean) > 0.99 and np.mean(bad) < 0.1


def test_common_words_of_any_length(documents):
    refs = references(documents([(k, "собственный также 我們的世界", "ru") for k in range(3)]))
    assert len(refs.words["ru"]) == 3 and refs.word_counts["ru"] == [3, 3, 3, 0]


def test_texts_without_common_words_go(spark):
    """Random words and texts of another language; the given clean ones stay (above)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    refs = references(docs)
    rng = random.Random(5)
    letters = {"en": "abcdefghijklmnop", "fr": "abcdéfghijklmnop", "de": "abcdefghijklmnöp", "es": "abcdefghijklñnop"}
    rows = [(k, " ".join("".join(rng.choices(letters[lang], k=rng.randint(4, 9))) for _ in range(120)), lang)
            for lang in letters for k in range(10)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality_rules(made, refs, max_class=2.0).collect()
    assert not any(r["base_failed"] or r["kept"] for r in got)
    for true, told in ((a, b) for a in letters for b in letters if a != b):
        some = docs.filter(docs.lang == true)
        as_other = some.select("doc_id", "text").selectExpr("doc_id", "text", f"'{told}' AS lang")
        rows = [r for r in quality_rules(as_other, refs, max_class=2.0).collect()
                if r["n_words"] >= 50 and not r["base_failed"]]
        assert np.mean([r["kept"] for r in rows]) < 0.1, (true, told)


def test_odd_rows(documents, odd_rows, clashing):
    got = quality_rules(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 9))
    assert quality_rules(clashing).count() == len(odd_rows)
    assert quality_rules(documents([])).count() == 0
    unlabelled = documents([(1, "some words " * 30, None)])
    assert quality_rules(unlabelled).first()["n_words"] == 60
