"""Language ID: held-out accuracy, codewords, odd rows."""

import zlib

import numpy as np

import pytest

from riskspark.llm.langid import (AMBIGUOUS, FAR, FEATURES, RIDGE, SHARPNESS, UNKNOWN, calibrate, codewords,
                                  fit_bits, identify, train)


def test_held_out_accuracy(spark):
    from riskspark.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_language_id"](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_labels_are_not_inputs(documents):
    """A text gets one prediction, whatever its own label and id are."""
    rows = [(k, ("the cat and the dog " if k % 2 else "der hund und die katze ") * 4, ["de", "en"][k % 2])
            for k in range(60)]
    rows += [(100, rows[1][1], "de"), (101, rows[1][1], None), (102, rows[1][1], "xx")]
    held = {k for k in range(200) if zlib.crc32(str(k).encode()) % 3 == 1}
    learned = [r for r in rows if r[0] not in (100, 102) or r[0] in held]
    model = train(documents(learned))
    got = {r["doc_id"]: r["lang_pred"] for r in identify(documents(rows), model).collect()}
    assert got[100] == got[101] == got[102] == got[1] == "en" and got[0] == "de"


def test_codewords():
    for n in (2, 3, 4, 6, 7, 20, 60):
        c = codewords(n)
        gap = ((c.shape[1] - c @ c.T) / 2)[~np.eye(n, dtype=bool)].min()
        assert c.shape[0] == n and gap >= max(1, c.shape[1] // 5)
    assert codewords(1).shape == (1, 0)


def test_odd_rows(documents, odd_rows, clashing):
    got = identify(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    und = [r for r in got if r["doc_id"] in (1, 2, 3, 9)]
    assert all(r["lang_pred"] == UNKNOWN and r["score"] == 0 for r in und)
    assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert identify(clashing).count() == len(odd_rows)
    assert identify(documents([])).count() == 0
    no_labels = identify(documents([(1, "some words", None), (2, "12 34 ² ½", None)])).collect()
    assert {r["lang_pred"] for r in no_labels} == {UNKNOWN}
    one = identify(documents([(k, "some words", "en") for k in range(9)] + [(20, "12", "en")])).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in one} == {**{k: "en" for k in range(9)}, 20: UNKNOWN}


def plain_grams(text):
    """Unit vector of the square roots of hashed byte 2- and 3-gram counts, one gram at a time; a
    space ends the text."""
    data = bytearray(text.encode() + b" ")
    for k, b in enumerate(data):
        if b < 128:
            data[k] = ord(chr(b).lower()) if chr(b).isalpha() else 32
        elif k and data[k - 1] == 0xC3 and 0x80 <= b <= 0x9E:
            data[k] = b + 32
    x = np.zeros(FEATURES)
    for size in (2, 3):
        for k in range(len(data) - size + 1):
            code = size
            for b in data[k:k + size]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ b
            x[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    x = np.sqrt(x)
    return x / max(np.linalg.norm(x), 1e-12)


LINES = {"de": "der hund und die katze gehen nach hause weil es regnet ", "en": "the dog and the cat walk home in the rain ",
         "fr": "le chien et le chat rentrent parce que la pluie tombe "}


def _labelled(n):
    rng = np.random.default_rng(5)
    return [(k, " ".join(rng.permutation(LINES[lang].split())[:6]), lang)
            for k in range(n) for lang in [sorted(LINES)[k % 3]]]


def test_equals_a_plain_fit_and_decode(documents):
    """Ridge by the normal equations and decoding by loops, from the same rows."""
    rows = _labelled(90)
    texts = [r[1] for r in rows] + ["the katze et hund", "zzz qqq", "é"]
    got = identify(documents(rows + [(1000 + k, t, None) for k, t in enumerate(texts)])).collect()
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    langs, codes = sorted(LINES), codewords(3)
    x = np.array([plain_grams(r[1]) for r in learned])
    truth = np.array([langs.index(r[2]) for r in learned])
    y = codes[truth]
    c, base = x - x.mean(axis=0), y.mean(axis=0)
    ridge = RIDGE * np.eye(FEATURES)
    weights = np.linalg.solve(c.T @ c + ridge, c.T @ (y - base))
    left_out = np.array([base + c[k] @ np.delete(c, k, 0).T @ np.linalg.solve(
        np.delete(c, k, 0) @ np.delete(c, k, 0).T + RIDGE * np.eye(len(c) - 1), np.delete(y - base, k, 0))
        for k in range(len(c))])
    error = np.clip((left_out * y <= 0).mean(axis=0), 1e-3, 0.499)
    trust = np.log((1 - error) / error)
    trust /= trust.sum()

    def losses(margins):
        return [sum(t * max(0, 1 - m * b) ** 2 for t, m, b in zip(trust, margins, code)) for code in codes]

    gap, far = calibrate(np.array([losses(m) for m in left_out]), truth)
    by_id = {r["doc_id"]: r for r in got}
    for k, t in enumerate(texts):
        loss = losses(base + (plain_grams(t) - x.mean(axis=0)) @ weights)
        low = sorted(loss)
        share = np.exp(-SHARPNESS * (np.array(loss) - low[0]))
        r = by_id[1000 + k]
        assert r["lang_pred"] == langs[int(np.argmin(loss))]
        assert r["score"] == pytest.approx(share.max() / share.sum(), abs=1e-3)
        if abs(low[1] - low[0] - gap) > 1e-3 and abs(low[0] - far) > 1e-3:
            assert (r["ambiguous"], r["far"]) == (low[1] - low[0] < gap, low[0] > far)


def test_left_out_documents_set_the_gap():
    loss = np.array([[0.1, 0.9], [0.8, 0.74], [0.5, 0.1]])
    assert calibrate(loss, np.array([0, 1, 1]), 3) == (pytest.approx(0.03), pytest.approx(0.925))
    assert calibrate(loss[:1], np.array([0]), 1) == (AMBIGUOUS, FAR)
    assert calibrate(loss, np.array([1, 0, 0]), 1) == (0.0, float("inf"))
    assert calibrate(loss, np.array([0, 1, 1])) == (0.0, float("inf"))
    weights, bias, trust, left_out = fit_bits(np.eye(4)[[0, 1, 0, 1]], np.array([[1.0], [-1], [1], [-1]]))
    assert left_out.shape == (4, 1) and trust.sum() == pytest.approx(1)


def test_sample_is_bounded(spark, documents):
    """Repeated ids and rows without an id neither fill the sample nor are learned from twice."""
    from riskspark.llm.langid import _sample_ids
    rows = [(None, "no id", "en")] * 500 + [(7, f"same id {k}", "en") for k in range(500)]
    rows += [(k, "a text", lang) for k in range(100, 1100) for lang in ("en", "de")]
    langs, chosen = _sample_ids(documents(rows), 50, 4000)
    assert langs == ["de", "en"]
    counts = {r["lang"]: r["count"] for r in chosen.groupBy("lang").count().collect()}
    assert counts == {"de": 50, "en": 50}
    _, fewer = _sample_ids(documents(rows), 50, 60)
    assert fewer.count() == 60
    assert set(map(tuple, fewer.collect())) <= set(map(tuple, chosen.collect()))
