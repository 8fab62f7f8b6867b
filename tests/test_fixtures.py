"""The account fixture against a plain computation, and its partitions."""

import datetime as dt
import random

import pytest

from riskspark.sources import fixtures


def write(spark, path, n_lines):
    """Customers with and without orders, one hot; null and repeated keys."""
    rnd, day = random.Random(2), dt.datetime(2000, 1, 1)
    orders = [(k, 1 if k % 3 == 0 else rnd.choice([2, 3, 4, None]), rnd.choice("FO"), day + dt.timedelta(k), "2-HIGH")
              for k in range(1, 61)]
    orders += [(None, 2, "O", None, None), (60, 1, "F", day, "1-URGENT")]
    lines = [(rnd.choice([None, 60, *range(1, 66)]), rnd.choice([None, *range(5)]), rnd.choice([None, *range(7)]),
              rnd.choice([None, 1.5, 2.25, 8.0]), rnd.choice(["R", "N", None])) for _ in range(n_lines)]
    spark.createDataFrame([(k, f"c{k}", 5.0, "BUILDING") for k in [*range(1, 8), 5, None]],
                          "c_custkey long, c_name string, c_acctbal double, c_mktsegment string") \
        .write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, "
                                  "o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_extendedprice double, "
                                 "l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    return orders, lines


@pytest.mark.parametrize("rows_per_partition", [250_000, 40])
def test_accounts_equal_a_plain_computation(spark, tmp_path, monkeypatch, rows_per_partition):
    monkeypatch.setattr(fixtures, "ROWS_PER_PARTITION", rows_per_partition)
    orders, lines = write(spark, str(tmp_path), 400)
    got = fixtures.accounts(spark, str(tmp_path))
    rows = got.collect()
    assert sorted(str(r["account_id"]) for r in rows) == sorted(map(str, [*range(1, 8), 5, None]))
    for r in rows:
        own = [o for o in orders if o[1] is not None and o[1] == r["account_id"]]
        mine = [x for o in own for x in lines if x[0] is not None and x[0] == o[0]]
        if not own:
            assert r["F115"] is None and r["F527"] is None
            continue
        assert r["F115"] == pytest.approx(sum(o[4] in ("1-URGENT", "2-HIGH") for o in own) / len(own))
        keyed = [o for o in own if o[0] is not None]
        last = max(o[0] for o in keyed)
        assert r["F2082"] in {0.0 if o[2] == "F" else 1.0 for o in keyed if o[0] == last}
        assert r["F527"] == pytest.approx(len({x[1] for x in mine} - {None}) / len(mine))
        assert r["F531"] == pytest.approx(len({x[2] for x in mine} - {None}) / len(mine))
        total = sum(x[3] for x in mine if x[3] is not None)
        assert r["F1692"] == pytest.approx(sum(x[3] for x in mine if x[3] and x[4] == "R") / total)
    if rows_per_partition == 40:  # the partitions follow the rows, not the session's setting
        assert "10), REPARTITION_BY_NUM" in got._jdf.queryExecution().toString()
