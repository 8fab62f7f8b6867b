"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash

from riskspark.llm.components import component_roots
from riskspark.llm.simhash import close_pairs, fingerprint_links, forest, simhash_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def brute_components(prints, radius=4):
    """Smallest id of each id's component."""
    ids = sorted(prints, key=lambda i: (i is None, i or 0))
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if a != b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)), key=lambda i: (i is None, i or 0))
                root[y] = x
    return {i: find(i) for i in ids}


def test_against_brute_force(documents):
    rng = random.Random(2)
    base = [" ".join(rng.choices(["The", "the", "a", "Ée", "x1", "word", "of"], k=rng.randint(0, 60))) for _ in range(40)]
    rows = list(enumerate(base))
    for k in range(40, 90):
        words = rng.choice(base).split()
        if words:
            words[rng.randrange(len(words))] = "other"
        rows.append((k, " ".join(words)))
    got = {r["doc_id"]: r for r in simhash_components(documents(rows), tile_rows=8).collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(prints)


def test_odd_rows(documents, odd_rows, clashing):
    got = simhash_components(documents(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    zero = [r for r in got if r["doc_id"] in (1, 2, 3, 9)]
    assert all(r["fp"] == 0 and r["component_id"] == 1 for r in zero)
    assert {r["component_id"] for r in got if r["doc_id"] == 6} == {6}
    assert simhash_components(clashing).count() == len(odd_rows)
    assert simhash_components(documents([])).count() == 0


def test_links_of_dense_tiles_keep_components(spark):
    """Signed fingerprints, cells around the whole range, tiles smaller than a group."""
    rng = random.Random(4)
    values = set()
    for _ in range(30):
        seed = rng.getrandbits(64)
        for _ in range(12):
            value = seed
            for _ in range(rng.randint(0, 3)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    values |= {0, 1, (1 << 64) - 1, (1 << 64) - 2}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile_rows=5)
    roots = {r["node"]: r["root"] for r in component_roots(links).collect()}
    want = brute_components({v: v % (1 << 64) for v in signed})
    groups = lambda f: sorted(sorted(v for v in signed if f(v) == g) for g in {f(v) for v in signed})
    assert groups(lambda v: roots.get(v, v)) == groups(want.get)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7)], "u long, v long")
    roots = {r["node"]: r["root"] for r in component_roots(edges).collect()}
    assert {roots[k] for k in range(301)} == {0} and roots[1001] == 1000 and 7 in roots
    assert component_roots(edges.limit(0)).count() == 0


def test_close_pairs_and_forest():
    a = np.array([0, 15, 31, -1], np.int64)
    i, j = close_pairs(a, a, 4)
    assert set(zip(i.tolist(), j.tolist())) == {(0, 0), (1, 1), (2, 2), (3, 3), (0, 1), (1, 0), (1, 2), (2, 1)}
    node, root = forest(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(node.tolist(), root.tolist())) == {3: 1, 5: 1, 9: 8}
