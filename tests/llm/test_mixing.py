"""Mixing: targets by the resharing rule step by step, budgets and cuts."""

import random
import re

import pytest

from riskspark.llm.mixing import mix_sources


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight; cut what is above the cap and reshare it, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    excess, open_ = float(sum(sizes.values())), set(order)
    while excess > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                excess += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
    return target


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("rows_per_range", [2, 10_000])
def test_targets_and_budgets(documents, rows_per_range):
    rng = random.Random(8)
    rows = []
    for k in range(400):
        source = rng.choice(["hot"] * 6 + ["b", "c", "tiny", "é", None, "Z"])
        n = rng.randint(0, 3) if source == "tiny" else rng.randint(0, 40)
        rows.append((k, " ".join(["w"] * n), "en", source))
    got = {r["doc_id"]: r for r in mix_sources(documents(rows), rows_per_range=rows_per_range).collect()}
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + size_of(text)
    want = brute_targets(sizes)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for source in sizes:
        mine = [got[i] for i, _, _, s in rows if s == source]
        assert all(r["target"] == pytest.approx(want[source]) for r in mine)
        assert all(r["source_size"] == sizes[source] for r in mine)
        # each source takes its budget to the word, and at most one document in part
        budget = int(mine[0]["target"])
        assert sum(r["taken"] for r in mine) == budget
        assert sum(r["taken"] % r["size"] > 0 for r in mine if r["size"]) <= 1
    assert all(r["taken"] <= 3 * r["size"] for r in got.values())
    assert all(got[i]["size"] == size_of(t) for i, t, *_ in rows)


def test_reruns_and_ranges_agree(documents):
    rows = [(k, "w " * (k % 17), "en", "ab"[k % 3 == 0]) for k in range(200)]
    one = sorted((r["doc_id"], r["taken"]) for r in mix_sources(documents(rows), rows_per_range=3).collect())
    two = sorted((r["doc_id"], r["taken"]) for r in mix_sources(documents(rows[::-1]).repartition(5)).collect())
    assert one == two


def test_odd_rows(documents, odd_rows, clashing):
    got = mix_sources(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3, 9)} == {0}
    assert mix_sources(clashing).count() == len(odd_rows)
    assert mix_sources(documents([])).count() == 0
    nothing = mix_sources(documents([(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert all(r["taken"] == 0 and r["target"] == 0 for r in nothing)
    alone = mix_sources(documents([(1, "a b c", "en", "a"), (1, "a b c", "en", "a")])).collect()
    assert [r["taken"] for r in alone] == [3, 3]


def test_rows_without_an_id_fill_no_range(spark, documents, monkeypatch):
    import riskspark.llm.mixing as mixing
    monkeypatch.setattr(mixing, "COPIES_PER_TASK", 100)
    rng = random.Random(2)
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "w " * rng.randint(0, 9), "en", "ab"[k % 5 == 0])
            for k in range(6000)]
    got = mixing.mix_sources(documents(rows), rows_per_range=50).collect()
    sizes = {s: sum(size_of(t) for _, t, _, x in rows if x == s) for s in "ab"}
    want = brute_targets(sizes)
    assert sorted(str((r["doc_id"], r["source"], r["size"])) for r in got) == sorted(
        str((i, s, size_of(t))) for i, t, _, s in rows)
    for s in "ab":
        mine = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in mine) == int(want[s] + 1e-9)
        assert sum(r["taken"] % r["size"] > 0 for r in mine if r["size"]) <= 1
        # whole documents in order of their keys, then one in part, then none
        assert len({r["taken"] // r["size"] for r in mine if r["size"]}) <= 2
    again = mixing.mix_sources(documents(rows[::-1]).repartition(7), rows_per_range=500).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
