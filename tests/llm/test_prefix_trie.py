"""Prefix trie: every node against a dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from riskspark.llm.prefix_trie import conversation_trie, ordered_turns, shared_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    """The contract's conversations: the family's first turns, then the conversation's own."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5
        out[c] = tuple(own.get(c - rest if c >= 0 else c + rest, [])[:h] + turns[h:])
    return out


def brute(convs):
    members = defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        size = len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * size
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items())


def trie(spark, rows, **kw):
    return Counter(map(tuple, shared_prefix_trie(spark.createDataFrame(rows, SCHEMA), **kw).collect()))


def random_rows(seed):
    """Few different turns, so many paths share a part; null and equal turn numbers, odd ids."""
    rng = random.Random(seed)
    rows = [(None, 1, "user", "no conversation"), (3, None, None, None), (3, None, None, None)]
    for c in [*range(-7, 45), 2 ** 40, 2 ** 40 + 1]:
        for t in range(rng.randint(1, 14)):
            turn = None if rng.random() < .03 else max(0, t - (rng.random() < .05))
            rows.append((c, turn, rng.choice(["user", "user", None]) if rng.random() < .2 else "user",
                         rng.choice("ab") if t % 4 == 1 else "é" * (t % 3)))
    return rows


@pytest.mark.parametrize("block", [1, 3, 4, 50])
def test_against_prefixes(spark, block):
    rows = random_rows(block)
    assert trie(spark, rows, block=block) == brute(rebuilt(rows))


def test_copies_of_one_conversation(spark):
    """A group of identical conversations is one path; its members' ids are all in the digest."""
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(300) for t in range(6)]
    assert trie(spark, rows) == brute(rebuilt(rows))


def test_plain_trie_without_families(spark):
    turns = [(c, p, b"%d" % (p if p < 3 else c), 10) for c in range(9) for p in range(1, 3 + c % 3)]
    got = conversation_trie(
        spark.createDataFrame([(c, 2 + c % 3) for c in range(9)] + [(9, 0)], "conv_id long, length long"),
        spark.createDataFrame(turns, "conv_id long, position long, digest binary, size long"))
    convs = {c: tuple(("", ("%d" % (p if p < 3 else c)).ljust(10)) for p in range(1, 3 + c % 3)) for c in range(9)}
    assert Counter(map(tuple, got.collect())) == brute({**convs, 9: ()})


def test_long_conversation_is_ordered_in_stretches(spark):
    n = 9_500
    rows = [(1, t, "user", str(t)) for t in range(n)] + [(1, None, "user", "first")]
    random.Random(1).shuffle(rows)
    own = ordered_turns(spark.createDataFrame(rows, SCHEMA))
    want = [hashlib.sha256(b"4:user" + x.encode()).digest() for x in ["first", *map(str, range(n))]]
    assert [bytes(r["digest"]) for r in own.orderBy("position").collect()] == want
    assert trie(spark, rows)[(1, 0, None, 1, 1, 1, 0, hashlib.sha256(b"").hexdigest())] == 1


def test_odd_tables(spark):
    assert trie(spark, []) == Counter()
    assert trie(spark, [(None, 0, "user", "x")]) == Counter()
    rows = [(1, 0, None, None)]  # no base, its own turn is within its first h: turnless
    assert trie(spark, rows) == brute(rebuilt(rows))
    rows = random_rows(9)
    names = ["position", "digest", "size", "k", "n", "h", "base", "given", "length", "depth", "t1", "salt", "speaker", "total"]
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in names})
    assert Counter(map(tuple, shared_prefix_trie(clash).collect())) == brute(rebuilt(rows))
