"""Bucketed case store: what a write touches, crashes, two writers, expiry."""

import uuid

import pytest
from pyspark.sql import functions as F

from riskspark.operators.cases import CaseStore
from riskspark.session import shared_dir

CASE = ("case_id string, account_id long, risk_score double, severity string, typology string, "
        "confidence double, is_demo boolean, report string")


def rows(spark, ids, report, demo=False):
    return spark.createDataFrame([(f"C{i}", i, float(i), "LOW", None, 0.0, demo, report) for i in ids], CASE)


@pytest.fixture
def store(spark):
    return CaseStore(spark, shared_dir(spark, f"buckets-{uuid.uuid4().hex}"), buckets=8, lease=0.5)


def reports(store):
    return {r["case_id"]: r["report"] for r in store.read().collect()}


def test_one_case_rewrites_one_bucket(spark, store):
    store.save(rows(spark, range(100), "a"))
    before = store._current()["folders"]
    store.save(rows(spark, [7], "b"))
    after = store._current()["folders"]
    assert len(before) == 8 and set(before) == set(after) and sum(before[b] != after[b] for b in before) == 1
    assert reports(store) == {f"C{i}": "b" if i == 7 else "a" for i in range(100)}
    assert CaseStore(spark, store.root, buckets=3).save(rows(spark, [8], "c")) == 3  # the store's own 8 hold
    assert store._current()["buckets"] == 8 and reports(store)["C8"] == "c" and len(reports(store)) == 100
    assert store.save(rows(spark, [], "none")) == 4 and len(reports(store)) == 100


def test_unfinished_writes_are_not_seen(spark, store):
    store.save(rows(spark, range(5), "a"))
    rows(spark, [1], "lost").withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{store.root}/data/2-dead")
    fs, path = store._path("manifests/v=2+s-0")     # a writer died while it wrote its manifest
    out = fs.create(path, False)
    out.write(bytearray(b'{"buckets": 8, "fol'))
    out.close()
    fs, claim = store._path("claims/v=3")           # another one after its claim
    fs.createNewFile(claim)
    assert set(reports(store).values()) == {"a"} and not store.has_batch("s-0")
    assert store.save(rows(spark, [1], "b"), "s-0") == 4 and reports(store)["C1"] == "b"
    assert store.save(rows(spark, [1], "replayed"), "s-0") == 4 and reports(store)["C1"] == "b"


def test_of_two_writers_none_is_lost(spark, store):
    store.save(rows(spark, range(3), "a"))
    publish, other = store._publish, CaseStore(spark, store.root)
    raced = []

    def late(*args):
        if not raced:
            raced.append(other.save(rows(spark, [1], "other")))
        return publish(*args)

    store._publish = late
    assert store.save(rows(spark, [2], "mine")) == 3 and raced == [2]
    assert reports(store) == {"C0": "a", "C1": "other", "C2": "mine"}


def test_clear_and_expire(spark, store):
    assert store.expire() == 0
    store.save(rows(spark, range(20), "a"))
    assert store.seed(rows(spark, [3, 50], "demo", True)) == 1
    assert store.clear_uploaded() == 19 and reports(store) == {"C3": "demo", "C50": "demo"}
    assert store.expire(keep=1) == 2 and reports(store) == {"C3": "demo", "C50": "demo"}
    assert store.clear_uploaded() == 0 and len(store._published()) == 2
