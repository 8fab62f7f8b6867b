"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The training corpus is read twice. The first pass counts the benchmark's terms
in all documents; each benchmark phrase (a window of item words) is then
represented by its rarest terms. The second pass stores the postings of just
those terms: document, position and, for the two rarest, the words around. A
phrase's lists, each shifted by the term's offset in the phrase, are intersected
from the rarest on; what is left is compared word by word. Proximity matches are
places with one word changed, missing or added: one edit spares one of the two
rarest terms, so each of their postings is a place to look at, and the rest of
the phrase is compared with the words around, shifted by one beyond the edit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import ensure_checkpoint_dir

#: What stands between words: a word is a run of anything else.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Lists intersected for each phrase.
LISTS = 2
#: Fewest words of a phrase that is also looked for with one word changed, missing or added.
NEAR_WORDS = 5
#: Most rows of a benchmark table that is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case (null: none)."""
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    # split at the gaps, many times faster than extracting the words; a gap at either end leaves an empty string
    return F.coalesce(F.array_remove(F.split(lowered, GAP), ""), F.array().cast("array<string>"))


def _fit(small: DataFrame) -> DataFrame:
    """Mark a checkpointed benchmark table for broadcast if its size allows."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def benchmark_phrases(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """``benchmark(item_id, text)`` -> phrases ``(pid, terms)`` and ``(pid, item_id)``.

    A phrase is ``window`` consecutive words; an item with fewer words is one
    phrase, an item without words none. Equal phrases of several items are one.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_words") - window))
    cut = (items.withColumn("_at", F.explode(starts))
           .select("item_id", F.slice("_words", F.col("_at") + 1, window).alias("terms")).distinct().checkpoint())
    phrases = cut.select("terms").distinct().withColumn("pid", F.monotonically_increasing_id()).checkpoint()
    owners = cut.join(phrases, "terms").select("pid", "item_id").checkpoint()
    return phrases, owners


@dataclass
class Index:
    """Postings of the probe terms and what was learned while building them.

    ``postings(term, doc_id, row, pos, before, around)``: ``around`` are the words from
    ``before`` places ahead of ``pos`` on, null for terms that are no phrase's rarest two.
    ``docs(doc_id, row, n_words)`` has a row for each document; ``row`` is a hash
    of the text, which tells rows of one ``doc_id`` apart.
    ``probes(pid, rank, term, offset, terms, absent)`` are the rarest terms of each phrase
    that the corpus has; ``absent`` counts the phrase's words that it lacks.
    """

    postings: DataFrame
    docs: DataFrame
    probes: DataFrame


def build_index(docs: DataFrame, phrases: DataFrame, window: int = WINDOW, lists: int = LISTS,
                near: bool = True) -> Index:
    """Count the benchmark's terms over all ``docs(doc_id, text)``, choose each phrase's
    rarest terms and store the postings of these; without ``near`` only what exact matches need."""
    tokens = docs.select("doc_id", F.xxhash64("text").alias("row"), words(F.col("text")).alias("_words"))
    placed = phrases.select("pid", F.posexplode("terms").alias("offset", "term")).checkpoint()
    vocabulary = placed.select("term").distinct().checkpoint()
    # an expression, not a column: for a column the optimizer adds a filter that makes the words a second time
    counts = (docs.select(F.explode(words(F.col("text"))).alias("term")).join(_fit(vocabulary), "term")
              .groupBy("term").agg(F.count(F.lit(1)).alias("n")).checkpoint())
    # a phrase with a term that the corpus lacks (null count) occurs nowhere, with two of them not nearly
    ordered = (placed.join(counts, "term", "left").groupBy("pid")
               .agg(F.sort_array(F.collect_list(F.struct("n", "offset", "term"))).alias("all"))
               .withColumn("by_count", F.filter("all", lambda t: t["n"].isNotNull()))
               .withColumn("absent", F.size("all") - F.size("by_count"))
               .filter((F.col("absent") == 0) | ((F.col("absent") == 1) & (F.size("all") >= NEAR_WORDS) & F.lit(near))))
    # a phrase of fewer terms than lists repeats them
    rarest = F.transform(F.sequence(F.lit(0), F.lit((max(lists, 2) if near else lists) - 1)),
                         lambda k: F.get("by_count", (k % F.size("by_count")).cast("int")))
    probes = (ordered.select("pid", "absent", F.posexplode(rarest).alias("rank", "probe"))
              .select("pid", "rank", F.col("probe.term").alias("term"), F.col("probe.offset").alias("offset"), "absent")
              .join(phrases, "pid").checkpoint())
    # the empty string, which is no word, closes each document's list: its position is the word count
    wanted = (probes.groupBy("term").agg(F.min("rank").alias("best"))
              .unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(lists).alias("best")))
              .checkpoint())
    before = F.least(F.col("pos"), F.lit(window))
    postings = (tokens.select("doc_id", "row", "_words", F.posexplode(
                    F.concat("_words", F.array(F.lit("")))).alias("pos", "term"))
                .join(_fit(wanted), "term")
                .select("term", "doc_id", "row", "pos", before.alias("before"),
                        F.when(F.col("best") <= int(near), F.slice("_words", F.col("pos") - before + 1, 2 * window + 1))
                        .alias("around")).checkpoint())
    ends = postings.filter(F.col("term") == "").select("doc_id", "row", F.col("pos").cast("long").alias("n_words"))
    return Index(postings.filter(F.col("term") != ""), ends, probes)


def _shifted(index: Index, rank: int, wanted: Column) -> DataFrame:
    """The postings of the ``rank``-th rarest term of the wanted phrases, shifted to the phrase's start."""
    probes = _fit(index.probes.filter((F.col("rank") == rank) & wanted)
                  .select("pid", "term", "offset", "terms").checkpoint())
    return index.postings.join(probes, "term").withColumn("start", F.col("pos") - F.col("offset"))


def phrase_matches(index: Index, lists: int = LISTS) -> DataFrame:
    """Exact occurrences: ``pid, doc_id, row, start, length``, one row each."""
    key = ["pid", "row", "start"]
    whole = F.col("absent") == 0
    found = _shifted(index, 0, whole)
    for rank in range(1, lists):
        other = _shifted(index, rank, whole).select(*key, F.col("doc_id").alias("_doc"))
        same = [found[k] == other[k] for k in key] + [found["doc_id"].eqNullSafe(other["_doc"])]
        found = found.join(other, on=reduce(and_, same), how="left_semi")
    first = F.col("before") - F.col("offset") + 1
    # a start before the document or before the kept words can't hold the phrase
    exact = (F.col("start") >= 0) & (first >= 1) & (
        F.slice("around", F.greatest(first, F.lit(1)), F.size("terms")) == F.col("terms"))
    return found.filter(exact).select("pid", "doc_id", "row", "start", F.size("terms").alias("length")).distinct()


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """``doc_id, row`` of the different documents that ``decontaminate`` calls contaminated;
    ``row`` is the ``xxhash64`` of the text."""
    ensure_checkpoint_dir(docs.sparkSession)
    phrases, _ = benchmark_phrases(benchmark, window)
    return phrase_matches(build_index(docs, phrases, window, lists, near=False), lists).select("doc_id", "row").distinct()


def _one_edit() -> Column:
    """Whether the phrase stands around a posting with at most one word changed, missing or added.

    Words are compared at the phrase's places; if more than one differs, all that differ must lie on
    one side of the posting, and from the differing word next to it on all others agree one place off.
    """
    start, at = F.col("before") - F.col("offset"), F.col("offset")
    places = F.sequence(F.lit(0), F.size("terms") - 1)

    def same(j: Column, shift: int) -> Column:
        return F.get("around", start + j + shift).eqNullSafe(F.get("terms", j))

    differ = F.filter(places, lambda j: ~same(j, 0))

    def shifted(bad: Column) -> Column:
        first, last = F.get(bad, F.lit(0)), F.get(bad, F.size(bad) - 1)
        after = F.forall(places, lambda j: (j <= first) | same(j, -1)) | F.forall(
            places, lambda j: (j < first) | same(j, 1))
        ahead = F.forall(places, lambda j: (j >= last) | same(j, 1)) | F.forall(
            places, lambda j: (j > last) | same(j, -1))
        return (F.size(bad) <= 1) | ((first > at) & after) | ((last < at) & ahead)

    # one array, computed once and handed on as a lambda's argument
    return F.exists(F.array(differ), shifted)


def proximity_matches(index: Index) -> DataFrame:
    """``pid, doc_id, row``: documents that hold a phrase of ``NEAR_WORDS`` words or more, or hold
    it with one word changed, missing or added; found from its two rarest terms."""
    long = F.size("terms") >= NEAR_WORDS
    # words in common come first: cheap, and most places fail it
    alike = F.size(F.array_intersect("terms", "around")) >= F.size(F.array_distinct("terms")) - 1
    near = [_shifted(index, rank, long).filter(alike).filter(_one_edit()).select("pid", "doc_id", "row")
            for rank in (0, 1)]
    return near[0].unionByName(near[1]).distinct()


def _items_by_row(matches: DataFrame, owners: DataFrame, name: str) -> DataFrame:
    return (matches.join(_fit(owners), "pid").groupBy("doc_id", "row")
            .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias(name))
            .select(F.col("doc_id").alias(f"_d_{name}"), F.col("row").alias(f"_r_{name}"), name))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """Benchmark overlap of every document of ``docs(doc_id, text)``.

    Returns, one row per input row, ``doc_id, n_words, n_hit`` (words inside an
    occurrence of a benchmark phrase), ``n_items, items`` (ids of the items with
    occurring phrases, as strings, sorted), ``contaminated`` and ``n_near, near_items``
    (items with a phrase of ``NEAR_WORDS`` words or more that occurs or nearly does, with
    one word changed, missing or added; these alone don't make a document contaminated).
    Null or wordless
    texts have no words and no hits; repeated documents each come back; repeated
    benchmark rows count once, items without words never; a null ``doc_id`` is
    kept, a null ``item_id`` can't be reported and is left out. Texts of any length are
    read whole. Empty tables give no rows or no hits. Other columns are ignored.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    phrases, owners = benchmark_phrases(benchmark, window)
    index = build_index(docs, phrases, window, lists)
    matches = phrase_matches(index, lists).checkpoint()
    # covered words of overlapping and adjoining ranges, in order of their starts
    covered = F.aggregate(
        F.array_sort("ranges"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, r: F.struct(
            (acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], acc["upto"]))).alias("n"),
            F.greatest(acc["upto"], r["end"]).alias("upto")), lambda acc: acc["n"])
    hit = (matches.groupBy("doc_id", "row").agg(F.collect_set(F.struct(
        "start", (F.col("start") + F.col("length")).alias("end"))).alias("ranges"))
        .select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), covered.alias("n_hit")))
    out = index.docs.join(hit, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left")
    for name, some in (("items", matches), ("near_items", proximity_matches(index))):
        listed = _items_by_row(some, owners, name)
        out = out.join(listed, F.col("doc_id").eqNullSafe(F.col(f"_d_{name}"))
                       & (F.col("row") == F.col(f"_r_{name}")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    found, near = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("items", "near_items"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"),
                      found.alias("items"), (n_hit > 0).alias("contaminated"),
                      F.size(near).cast("long").alias("n_near"), near.alias("near_items"))
