"""Fixture views over the driver tables (FIXTURES.md §4).

``accounts`` turns the order/line-item star schema into one wide account row
per customer; ``scored`` adds a fixed probability so scoring and rules can be
checked before a model exists; ``doc_features`` and ``entity_attributes``
feed learning and network operators. Each is a pure DataFrame plan: the
line-item join shuffles on the order key, every aggregate is partial/final by
customer and slice, which spreads a hot customer over ``SLICES`` tasks; distinct
suppliers and parts are counted in the same shuffle. The number of shuffle
partitions follows the rows, so a task's memory doesn't grow with the tables.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REFERENCE_DATE = "2001-08-01"
RECENT_SINCE = "2000-08-01 00:00:00"
FIXED_THRESHOLD = 0.45

SEGMENT_OCCUPATION = {  # raw text on purpose: exercises strip / lower-casing
    "AUTOMOBILE": " SelfEmployed",
    "BUILDING": "Salaried ",
    "FURNITURE": "student",
    "HOUSEHOLD": "housewife",
    "MACHINERY": "Agriculture",
}

#: Rows of a shuffle partition of the account tables, and slices of a customer's rows.
ROWS_PER_PARTITION, SLICES = 250_000, 8

STANDING_DAYS = ((7, "L7D"), (14, "L14D"), (31, "L31D"), (90, "L90D"),
                 (180, "L180D"), (365, "L365D"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _days_to_ref(ts: Column) -> Column:
    return F.datediff(F.lit(REFERENCE_DATE).cast(T.DateType()), ts.cast(T.DateType()))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer with the account feature columns of FIXTURES.md §4.1."""
    orders = table(spark, sf_dir, "orders")
    lineitem = table(spark, sf_dir, "lineitem")
    customer = table(spark, sf_dir, "customer")

    tables = [t.select(F.lit(i).alias("t")) for i, t in enumerate((lineitem, orders, customer))]
    rows = reduce(DataFrame.union, tables).groupBy("t").count().agg(F.max("count")).first()[0] or 0
    n = max(1, math.ceil(rows / ROWS_PER_PARTITION))
    slices = SLICES if n > 1 else 1

    def sliced(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(slices)).alias("slice")

    # numeric buffer keeps this a HashAggregate (a string max_by forces a sort aggregate)
    still_open = F.when(F.col("o_orderstatus") == "F", F.lit(0.0)).otherwise(F.lit(1.0))
    o = orders.select("*", sliced("o_orderkey")).repartition(n, "o_custkey", "slice").groupBy("o_custkey", "slice").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("n_urgent"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.max_by(still_open, F.col("o_orderkey")).alias("last_open"),
        F.max("o_orderkey").alias("last_key"),
        F.count_if(F.col("o_orderdate") > F.lit(RECENT_SINCE).cast(T.TimestampNTZType()))
        .alias("n_recent"),
    ).repartition(n, "o_custkey").groupBy("o_custkey").agg(
        F.sum("n_orders").alias("n_orders"), F.sum("n_urgent").alias("n_urgent"),
        F.min("first_order").alias("first_order"), F.max("last_order").alias("last_order"),
        F.max_by("last_open", "last_key").alias("last_open"), F.sum("n_recent").alias("n_recent"))
    lines = lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice",
                            "l_returnflag").repartition(n, "l_orderkey") \
        .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").repartition(n, "l_orderkey"),
              "l_orderkey")
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(F.lit(0.0))
    none = F.lit(None).cast(T.DoubleType())
    # a line three times: with its sums, under its supplier and under its part; equal values meet in one slice
    values = lines.select("o_custkey", F.inline(F.array(
        F.struct(sliced("l_orderkey"), F.lit("line").alias("kind"), F.lit(None).cast("long").alias("value"),
                 F.col("l_extendedprice").alias("total"), returned.alias("back")),
        *[F.struct(sliced(c), F.lit(kind).alias("kind"), F.col(c).cast("long").alias("value"),
                   none.alias("total"), none.alias("back"))
          for kind, c in (("supp", "l_suppkey"), ("part", "l_partkey"))])))
    distinct = values.repartition(2 * n, "o_custkey", "slice").groupBy("o_custkey", "slice", "kind", "value").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total").alias("total"), F.sum("back").alias("back"))
    l_agg = distinct.groupBy("o_custkey", "slice").agg(
        F.sum(F.when(F.col("kind") == "line", F.col("rows")).otherwise(0)).alias("n_lines"),
        F.count_if(F.col("value").isNotNull() & (F.col("kind") == "supp")).alias("n_supp"),
        F.count_if(F.col("value").isNotNull() & (F.col("kind") == "part")).alias("n_part"),
        F.sum("total").alias("ext_total"), F.sum("back").alias("ext_returned"),
    ).repartition(n, "o_custkey").groupBy("o_custkey").agg(
        *[F.sum(c).alias(c) for c in ("n_lines", "n_supp", "n_part", "ext_total", "ext_returned")])

    last_days = _days_to_ref(F.col("last_order"))
    standing = None
    for days, label in STANDING_DAYS:
        standing = (F.when(last_days <= days, F.lit(label)) if standing is None
                    else standing.when(last_days <= days, F.lit(label)))
    standing = F.when(F.col("last_order").isNull(), F.lit(None).cast(T.StringType())) \
        .otherwise(standing.otherwise(F.lit("G365D")))

    occupation = None
    for seg, text in SEGMENT_OCCUPATION.items():
        cond = F.col("c_mktsegment") == seg
        occupation = F.when(cond, F.lit(text)) if occupation is None else occupation.when(cond, F.lit(text))

    c = customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    base = (c.join(o, c.c_custkey == o.o_custkey, "left")
            .join(l_agg.withColumnRenamed("o_custkey", "l_custkey"),
                  F.col("c_custkey") == F.col("l_custkey"), "left"))
    f115 = F.col("n_urgent").cast(T.DoubleType()) / F.col("n_orders")
    target = (F.col("c_acctbal") < 0) & F.coalesce(f115 >= 0.4, F.lit(False))
    return base.select(
        F.col("c_custkey").alias("account_id"),
        f115.alias("F115"),
        F.floor(_days_to_ref(F.col("first_order")) / F.lit(30.0)).cast(T.DoubleType()).alias("F2956"),
        F.when(F.col("c_acctbal") < 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("F670"),
        F.col("last_open").alias("F2082"),
        F.nullif(F.col("n_recent"), F.lit(0)).cast(T.DoubleType()).alias("F3043"),
        standing.alias("F3889"),
        occupation.alias("F3891"),
        (F.lit(18) + F.col("c_custkey") % 60).cast(T.DoubleType()).alias("F3894"),
        (F.col("n_supp").cast(T.DoubleType()) / F.col("n_lines")).alias("F527"),
        (F.col("n_part").cast(T.DoubleType()) / F.col("n_lines")).alias("F531"),
        (F.col("ext_returned") / F.col("ext_total")).alias("F1692"),
        F.when(target, F.lit(1)).otherwise(F.lit(0)).alias("F3924"),
        F.when(target & (F.col("c_custkey") % 20 != 0), F.lit(1.0)).otherwise(F.lit(0.0))
        .alias("F3912"),
        F.lit(None).cast(T.DoubleType()).alias("F9001"),
        F.col("c_name").alias("F9002"),
    )


def fixed_probability(df: DataFrame) -> Column:
    """p = .35 coalesce(F115,.5) + .30 F670 + .15 (1 - coalesce(F2082,.4)) + .20 t."""
    t = (F.when(F.col("F2956").isNull(), F.lit(0.5))
         .when(F.col("F2956") > 80, F.lit(0.0))
         .otherwise((F.lit(80.0) - F.col("F2956")) / F.lit(80.0)))
    return (F.lit(0.35) * F.coalesce(F.col("F115"), F.lit(0.5))
            + F.lit(0.30) * F.col("F670")
            + F.lit(0.15) * (F.lit(1.0) - F.coalesce(F.col("F2082"), F.lit(0.4)))
            + F.lit(0.20) * t)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``accounts`` plus fixed probabilities ``p`` and ``p2`` (model comparison)."""
    acc = accounts(spark, sf_dir)
    with_p = acc.select("*", fixed_probability(acc).alias("p"))
    return with_p.select("*", (F.lit(0.9) * F.col("F3912") + F.lit(0.1) * F.col("p")).alias("p2"))


def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` x ``labels``: y = 1 - quality and plain character counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = docs.join(labels, "doc_id")
    text = F.col("text")
    return j.select(
        F.col("doc_id").alias("account_id"),
        F.length(text).cast(T.DoubleType()).alias("n_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, " ", ""))).cast(T.DoubleType())
        .alias("n_spaces"),
        (F.length(text) - F.length(F.regexp_replace(text, "[0-9]", ""))).cast(T.DoubleType())
        .alias("n_digits"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).cast(T.DoubleType())
        .alias("n_upper"),
        (F.length(text) - F.length(F.regexp_replace(text, "\n", "")) + F.lit(1))
        .cast(T.DoubleType()).alias("n_lines"),
        (F.lit(1) - F.col("quality")).cast(T.IntegerType()).alias("y"),
    )


def entity_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite edges (entity, attribute) from ``events`` (FIXTURES.md §4.4).

    The attribute is (props.k, hour of ts, 10-minute slot). Two users sharing
    an attribute are linked *through* it; the pair list itself is never built.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "props")
    k = F.get_json_object("props", "$.k")
    attr = F.concat_ws("|", k, F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH"),
                       F.floor(F.minute("ts") / 10).cast("string"))
    return ev.select(F.col("user_id").alias("entity"), attr.alias("attribute")).distinct()


def entity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User score for N2-N3: 100 x share of 'error' events x 2, capped at 100."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type")
    share = F.avg(F.when(F.col("event_type") == "error", F.lit(1.0)).otherwise(F.lit(0.0)))
    return ev.groupBy(F.col("user_id").alias("entity")).agg(
        F.least(F.lit(100.0), F.lit(100.0) * share * F.lit(2.0)).alias("score"))


_PERSISTED: dict = {}


def persisted(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Build a fixture once per Spark application and checkpoint it.

    ``checkpoint()`` writes the rows to the shared ``spark.checkpoint.dir``: the
    data survives lost executors and every query on top starts from a short
    plan (deep plans made analysis and cache matching dominate at small scale).
    """
    from riskspark.session import ensure_checkpoint_dir

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    df = _PERSISTED.get(key)
    if df is None:
        ensure_checkpoint_dir(spark)
        df = build(spark, sf_dir).checkpoint()
        _PERSISTED[key] = df
    return df


def accounts_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persisted(spark, sf_dir, "accounts", accounts)


def scored_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(s, d):
        acc = accounts_p(s, d)
        with_p = acc.select("*", fixed_probability(acc).alias("p"))
        return with_p.select("*", (F.lit(0.9) * F.col("F3912") + F.lit(0.1) * F.col("p")).alias("p2"))
    return persisted(spark, sf_dir, "scored", build)
