"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Every document gets a random but reproducible key (a digest of its id). Rows
that agree in id, source and size can't be told apart in the result, so they
are counted first and written out at the end, however many there are. Within
a source the key space is cut into equal ranges, as many as the source has
``ROWS_PER_RANGE`` rows; digests are uniform, so the ranges are even however
large one source is. Range totals are summed up per source to give each range
its offset, a window inside each range adds the rest, and the mix is cut where
the running sum reaches the source's budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import ensure_checkpoint_dir

ROWS_PER_RANGE = 2_000
#: Equal rows (one id, source and size) that a task writes from one counted row.
COPIES_PER_TASK = 10_000
#: Most sources whose table is sent to all executors; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: F.Column) -> F.Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3,
                   copies: str | None = None) -> DataFrame:
    """One row per source: ``source, source_size, source_rows, target``. A row stands for
    as many documents as its column ``copies`` says (``source_rows`` counts it once).

    Sources in code point order (null last) weigh ``weights``, repeating. The
    total size is shared by weight, no source above ``cap`` times its size; what
    is above is reshared by weight among the others. In the order of
    ``cap * size / weight`` the capped sources come first, so two running sums
    over the sources (a table of one row per source) give the fixed point.
    """
    size = F.col("size") if copies is None else F.col("size") * F.col(copies)
    per_source = sized.groupBy("source").agg(
        F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          ((F.row_number().over(names) - 1) % len(weights) + 1).cast("int"))
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    t = (per_source.withColumn("_weight", weight.cast("long"))
         .withColumn("_most", F.col("source_size") * cap)
         .withColumn("_ratio", F.col("_most") / F.col("_weight"))
         .withColumn("_left", F.sum("source_size").over(everything)
                     - F.coalesce(F.sum("_most").over(before), F.lit(0)))
         .withColumn("_left_weight", F.sum("_weight").over(everything)
                     - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
         .withColumn("_capped", F.col("_ratio") <= F.col("_left") / F.col("_left_weight")))
    open_ = ~F.col("_capped")
    t = (t.withColumn("_share", F.max(F.when(open_, F.col("_left"))).over(everything))
         .withColumn("_share_weight", F.max(F.when(open_, F.col("_left_weight"))).over(everything)))
    target = F.when(F.col("_capped"), F.col("_most").cast("double")).otherwise(
        (F.col("_weight") * F.col("_share")) / F.col("_share_weight"))
    return t.select("source", "source_size", "source_rows", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3,
                seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Mix ``docs(doc_id, text, source)``: how many words of each document the mix takes.

    Returns ``doc_id, source, size, source_size, target, taken, epochs`` (one row
    per input row; ``epochs`` whole repeats, the rest of ``taken`` is the first
    words of the text). Every document is taken ``floor(budget / source_size)``
    times; the rest of the budget goes to documents in key order, the last one
    in part, so a source's taken words equal ``floor(target)``.

    Null text counts 0 words; a null source is a source of its own; repeated rows
    each count; rows of one id are ordered by size, those of one size may swap, which
    shows in no result. A text of any length counts whole. A range holds its share of
    the different (id, size) of a source, so rows without an id (or with one repeated
    id) add as many entries to their range as they have sizes. Empty input gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    sized = (docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
             .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_copies"))
             .withColumn("_key", F.md5(F.concat(F.lit(f"{seed}:"),
                                                F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
             .checkpoint())
    targets = source_targets(sized, weights, cap, "_copies").checkpoint()
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    position = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / float(1 << 32)
    ranged = (sized.withColumnRenamed("source", "_source")
              .join(targets, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
              .withColumn("_range", F.floor(position * F.ceil(F.col("source_rows") / rows_per_range))))
    group = ["source", "_range"]
    words = F.col("size") * F.col("_copies")
    in_range = (Window.partitionBy(*group).orderBy("_key", "size", F.col("doc_id").isNull())
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (ranged.groupBy(*group).agg(F.sum(words).alias("_sum"))
               .withColumn("_offset", F.coalesce(F.sum("_sum").over(
                   Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)))
               .select(F.col("source").alias("_s"), F.col("_range").alias("_r"), "_offset"))
    placed = (ranged.withColumn("_before", F.coalesce(F.sum(words).over(in_range), F.lit(0)))
              .join(offsets, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - F.col("epochs") * F.col("source_size")
    here = F.greatest(F.lit(0), F.least(words, rest - F.col("_offset") - F.col("_before")))
    whole = F.when(F.col("size") > 0, F.floor(here / F.col("size"))).otherwise(F.lit(0)).cast("long")
    counted = (placed.withColumn("epochs", epochs.cast("long")).withColumn("_here", here.cast("long"))
               .withColumn("_whole", whole)
               .select("doc_id", "source", "size", "source_size", "target", "epochs", "_here", "_whole", "_copies")
               .checkpoint())
    return _written_out(counted)


def _written_out(counted: DataFrame) -> DataFrame:
    """A row for each of the ``_copies``: the first ``_whole`` take another whole text, the
    next one what is left of ``_here``. Many copies are cut into parts that any task can take."""
    part = (counted.filter(F.col("_copies") > COPIES_PER_TASK)
            .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1,
                                                      F.lit(COPIES_PER_TASK).cast("long"))))
            .repartition("doc_id", "source", "size", "_from"))
    parts = counted.filter(F.col("_copies") <= COPIES_PER_TASK).withColumn(
        "_from", F.lit(0).cast("long")).unionByName(part)
    last = F.least(F.col("_copies"), F.col("_from") + COPIES_PER_TASK) - 1
    rows = parts.withColumn("_copy", F.explode(F.sequence("_from", last)))
    more = (F.when(F.col("_copy") < F.col("_whole"), F.col("size"))
            .when(F.col("_copy") == F.col("_whole"), F.col("_here") - F.col("_whole") * F.col("size"))
            .otherwise(F.lit(0)))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       (F.col("epochs") * F.col("size") + more).cast("long").alias("taken"), "epochs")
