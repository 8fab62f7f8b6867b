"""Corpus pipeline: the stages that turn ``documents`` into a training mix.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps;
a caller may write a stage's result and read it again as the next one's input.
All stages but the last return the columns of ``documents``. Rows with a null
``doc_id`` or text, repeated rows and empty tables go through; what each stage
does with them stands in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.decontam import contaminated_rows
from riskspark.llm.langid import UNKNOWN, language_column, train
from riskspark.llm.line_dedup import remove_aligned_lines
from riskspark.llm.mixing import WORD, mix_sources
from riskspark.llm.simhash import simhash_components

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the input doesn't have."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language: null text, texts without a letter, ambiguous
    texts and texts far from every language go. The model, the gap of ambiguity and the
    limit of distance are learned from the input's ``lang`` so that no left-out learned
    document goes; if there is none to learn from, only texts without a letter go."""
    model = train(docs)
    name = _unused(docs, "_found")
    found = docs.withColumn(name, language_column("text", model))
    known = F.col(f"{name}.lang_pred") != UNKNOWN
    if not model.langs:
        known = F.col("text").rlike(r"\p{L}")
    unsure = F.col(f"{name}.ambiguous") | F.col(f"{name}.far")
    return found.filter(known & ~unsure).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts blocks of lines that an earlier document has; ``n_chars`` follows. A
    document of which no line is left goes; one that never had a line stays."""
    cut = remove_aligned_lines(docs)
    stays = (F.col("n_removed") == 0) | (F.col("kept_lines") > 0)
    out = cut.filter(stays)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest ``doc_id`` of each near-duplicate component.
    Of rows with one ``doc_id`` the one with the first text stays; rows without a
    ``doc_id`` can't be told apart and all stay."""
    found = simhash_components(docs).checkpoint()
    id_, n = _unused(docs, "_keep"), _unused(docs, "_rows")
    keep = (found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias(n)).select(F.col("doc_id").alias(id_), n).checkpoint())
    kept = docs.join(keep, F.col("doc_id") == F.col(id_))
    single = kept.filter(F.col(n) == 1).select(*docs.columns)
    single = single.unionByName(docs.filter(F.col("doc_id").isNull()))
    if keep.filter(F.col(n) > 1).isEmpty():
        return single
    rest = ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    several = (kept.filter(F.col(n) > 1).groupBy("doc_id")
               .agg(F.min(F.struct(*rest)).alias("_first")).select("doc_id", "_first.*"))
    return single.unionByName(several.select(*docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark phrase; null texts stay. Rows of one
    ``doc_id``, or without one, are judged each by their own text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    id_, row = _unused(docs, "_hit"), _unused(docs, "_hit_row")
    hit = contaminated_rows(docs, benchmark).select(F.col("doc_id").alias(id_), F.col("row").alias(row))
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(row)), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: each document it takes, with ``size, source_size,
    target, taken`` (words), ``epochs`` (whole repeats by budget) and ``text``, what the mix
    takes of it: the whole text as often as it goes into ``taken``, then its first words,
    joined by a space, for the rest; a newline stands between. Rows that agree in id, text and source
    are repeats of one document; rows that share only the id, or have none, are documents apart."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
                      F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = docs.select("doc_id", key.alias("key"), "text", "source")
    mix = (mix_sources(rows.select(F.col("key").alias("doc_id"), "text", "source"))
           .filter(F.col("taken") > 0).withColumnsRenamed({"doc_id": "_key", "source": "_source"}))
    # repeats carry one text, so any of them serves all
    texts = rows.filter(F.col("text").isNotNull()).dropDuplicates(["key", "source"])
    taken = texts.join(mix, (F.col("key") == F.col("_key")) & F.col("source").eqNullSafe(F.col("_source")))
    rest = F.col("taken") % F.col("size")
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, rest.cast("int"))
    text = F.concat_ws("\n", F.array_repeat("text", F.floor(F.col("taken") / F.col("size")).cast("int")),
                       F.when(rest > 0, F.array_join(words, " ")))
    return taken.select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", text.alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
]

#: Language ID, alignment and fingerprint links can't be expressed in SQL; tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
