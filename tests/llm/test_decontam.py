"""Benchmark decontamination: matches, proximity and odd tables."""

import random
import re

from riskspark.llm.decontam import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items):
    phrases = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            phrases.setdefault(tuple(w[k:k + 10]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in phrases:
                    hit |= set(range(k, k + n))
                    found |= phrases[tuple(w[k:k + n])]
        out.append((doc_id, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"])
                   for r in df.collect()), key=str)


def test_against_brute_force(spark, documents):
    rng = random.Random(6)
    vocabulary = [f"t{k}" for k in range(12)] + ["Ää", "É"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 9, 10, 11, 25])))) for k in range(25)]
    items += [(3, items[4][1]), (100, items[7][1]), (100, items[7][1]), (101, None), (102, "never seen words")]
    rows = []
    for k in range(60):
        text = " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))
        if k % 2:
            text += ", " + (rng.choice(items)[1] or "").upper().replace("Ä", "ä") + "! " + text[:20]
        rows.append((k, text))
    rows += [(60, None), (61, ""), (5, rows[5][1]), (5, "another text of this id " + items[9][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate(documents(rows), bench)) == brute(rows, items)
    assert got(decontaminate(documents(rows), bench, lists=3)) == brute(rows, items)


def test_odd_rows(spark, documents, odd_rows, clashing):
    bench = spark.createDataFrame([(1, "same row"), (2, ""), (None, None)], "item_id long, text string")
    rows = [(r[0], r[1]) for r in odd_rows]
    assert got(decontaminate(documents(odd_rows), bench)) == brute(rows, [(1, "same row")])
    assert decontaminate(clashing, bench.selectExpr("*", "'x' AS terms", "'y' AS pid")).count() == len(rows)
    assert decontaminate(documents([]), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(documents(odd_rows), bench.limit(0)).collect())


def edits(p):
    """A phrase as a predicate on word sequences: equal but for one word changed, missing or added."""
    def holds(w):
        n = len(p)
        if len(w) == n:
            return sum(a != b for a, b in zip(w, p)) <= 1
        long, short = (w, list(p)) if len(w) > n else (list(p), w)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1:] == short for k in range(len(long)))
    return holds


def brute_near(rows, items):
    phrases = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if len(w) >= 5 else 0):
            phrases.setdefault(tuple(w[k:k + 10]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, found = words(text), set()
        for p, ids in phrases.items():
            if not ids <= found and any(edits(p)(w[k:k + n]) for n in (len(p) - 1, len(p), len(p) + 1)
                                        for k in range(max(0, len(w) - n + 1))):
                found |= ids
        out.append((doc_id, ",".join(sorted(found))))
    return sorted(out, key=str)


def near(df):
    return sorted(((r["doc_id"], ",".join(r["near_items"])) for r in df.collect() if r["n_near"] == len(
        r["near_items"])), key=str)


def test_proximity_against_brute_force(spark, documents):
    rng = random.Random(16)
    vocabulary = [f"t{k}" for k in range(8)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([4, 5, 6, 9, 10, 11, 13])))) for k in range(20)]
    items += [(50, "one word of this is never there " + " ".join(vocabulary[:3])), (51, "a a a a a a"),
              (52, "two words unseen alpha beta " + items[5][1])]
    rows = [(200, "one word of this is NOT there t0 t1 t2"), (201, "a a a a a"), (202, "word of this is never there t0 t1 t2"),
            (203, "a a b a a a"), (204, "one word of this is there t0 t1 t2"), (205, None), (206, "")]
    for k in range(120):
        w = words(items[k % 20][1])
        at = rng.randrange(len(w))
        for _ in range(rng.choice([0, 1, 1, 1, 2])):
            at = min(at, len(w) - 1)
            w[at:at + rng.choice([0, 1])] = rng.choice([[], ["x"], [rng.choice(vocabulary)]])
            at = rng.randrange(len(w))
        rows.append((k, " ".join(rng.choices(vocabulary, k=rng.randint(0, 3)) + w + rng.choices(vocabulary, k=rng.randint(0, 3)))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate(documents(rows), bench)
    assert near(found) == brute_near(rows, items)
    assert got(found) == brute(rows, items)


def test_one_edit_at_every_place(spark, documents):
    text = "the quick brown fox jumps over a lazy sleeping dog".split()
    rows = [(0, " ".join(text))]
    for k in range(10):
        rows += [(100 + k, " ".join(text[:k] + ["other"] + text[k + 1:])), (200 + k, " ".join(text[:k] + text[k + 1:])),
                 (300 + k, " ".join(text[:k] + ["more"] + text[k:]))]
    rows += [(400, " ".join(text[:3] + text[5:])), (401, " ".join(text[::-1]))]
    bench = spark.createDataFrame([(1, " ".join(text))], "item_id long, text string")
    found = {r["doc_id"]: (r["contaminated"], r["n_near"]) for r in decontaminate(documents(rows), bench).collect()}
    assert found[0] == (True, 1) and found[300] == (True, 1)  # a word ahead leaves the phrase whole
    assert all(v == (False, 1) for k, v in found.items() if 100 <= k < 400 and k != 300)
    assert found[400] == found[401] == (False, 0)


def test_words_are_made_once_for_counting(spark, monkeypatch):
    """The words of odd texts, and a counting pass whose plan makes them once, without a match object per word."""
    from pyspark.sql import functions as F

    from riskspark.llm import decontam
    texts = [None, "", " ", "\x00a\x7f", "..A1b ÉÄé z-Z\n", "\U0001F600 x\U0001F600Y", "one", "\tTab\r\n0:9"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["w"] for r in rows.select("doc_id", decontam.words(F.col("text")).alias("w")).collect()}
    assert got == {k: words(t) for k, t in enumerate(texts)}
    plan = rows.select(F.explode(decontam.words(F.col("text")))).where("col > ''")._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan
