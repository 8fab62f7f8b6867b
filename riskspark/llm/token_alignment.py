"""Cross-tokenizer alignment: which ids of two tokenizers end at the same bytes, and how often.

Tokenizer A is byte-level, tokenizer B works on pieces. Both token sequences of a
text cover the same bytes; offsets where tokens of both end cut them into groups,
and the last A and B token of a group are linked. Most groups are one A token and
the one B token of the same bytes. For these the B id follows from the A id
(the identity map), so their links are counted in a vector as long as the
vocabulary; only links of all other groups are counted by a shuffle of pairs.

A text is tokenized once. Each task writes, for batches of some megabytes of text,
the rows' links as codes: an A id of the identity map, or a place in the batch's
list of other pairs. Counts of the whole corpus go back to the batches as lists of
the same order, so neither texts nor single links travel twice.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.arrays import ranges
from riskspark.llm.tokens import (BYTE_BPE, PIECE_BPE, WordTable, byte_bpe_bytes, byte_bpe_ids, piece_bpe_bytes,
                                  piece_bpe_ids, tokenizer_file, word_runs)
from riskspark.session import ensure_checkpoint_dir

BATCH_BYTES = 2 << 20
_LOW = (1 << 32) - 1


class Ragged:
    """Byte strings in one array, taken by index."""

    def __init__(self, strings: list[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def take(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.start[ids], self.size[ids])]


@cache
def vocabularies(a_path: str, b_path: str) -> tuple[Ragged, Ragged, np.ndarray, Ragged]:
    """Bytes of A's and B's ids, the identity map (A id to the B id of the same bytes, or -1; a whole
    piece before a single-byte fallback) and the decimal numbers, each with a place for a separator."""
    a, b = byte_bpe_bytes(a_path), piece_bpe_bytes(b_path)
    from riskspark.llm.tokens import piece_bpe
    model = piece_bpe(b_path)
    first: dict[bytes, int] = {}
    for i in sorted(range(len(b)), key=lambda i: (model.is_byte(i), i)):
        if not (model.is_control(i) or model.is_unknown(i)):
            first.setdefault(b[i], i)
    same = np.array([first.get(x, -1) for x in a], np.int64)
    return Ragged(a), Ragged(b), same, Ragged([f"{i},".encode() for i in range(max(len(a), len(b)))])


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return (np.concatenate(lists).astype(np.int64) if len(lists) else np.empty(0, np.int64)), lengths


def _by(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given lengths."""
    sums = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return sums[ends] - sums[ends - lengths]


def align_words(words: list[bytes], a_ids: list, b_ids: list, vocabulary) -> list[tuple[bytes, bytes, int, int] | None]:
    """For each word (a space and what follows) its groups as text, its links as 64-bit codes, and the
    numbers of A and B tokens; None if the bytes of either token sequence are not the word's.

    A link of the identity map has the code ``-1 - a``, any other ``a << 32 | b``.
    """
    a_bytes, b_bytes, same, decimal = vocabulary
    a, n_a = _flat(a_ids)
    b, n_b = _flat(b_ids)
    size = np.fromiter(map(len, words), np.int64, len(words))
    good = (_by(a_bytes.size[a], n_a) == size) & (_by(b_bytes.size[b], n_b) == size)
    for ids, numbers, side in ((a, n_a, a_bytes), (b, n_b, b_bytes)):
        mine = ids[np.repeat(good, numbers)]
        text = np.frombuffer(b"".join([w for w, g in zip(words, good.tolist()) if g]), np.uint8)
        good[good] = _by(side.take(mine) != text, size[good]) == 0
        # the next side is compared on the words that are still right
    a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
    n_a, n_b, size = n_a[good], n_b[good], size[good]
    ends_a, ends_b = np.cumsum(a_bytes.size[a]), np.cumsum(b_bytes.size[b])
    last_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True))
    last_b = np.flatnonzero(np.isin(ends_b, ends_a, assume_unique=True))
    in_a, in_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    link_a, link_b = a[last_a], b[last_b]
    exact = (in_a == 1) & (in_b == 1) & (same[link_a] == link_b)
    code = np.where(exact, -1 - link_a, (link_a << 32) | link_b)
    # texts: A tokens of a group, then its B tokens
    group_a, group_b = np.repeat(np.arange(len(last_a)), in_a), np.repeat(np.arange(len(last_b)), in_b)
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
    ids[place_a], ids[place_b] = a, b
    mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
    text = decimal.take(ids)
    text_end = np.cumsum(decimal.size[ids])
    if len(ids):
        text[text_end - 1] = mark
    text, code_bytes = text.tobytes(), code.tobytes()
    word_end = np.cumsum(size)
    text_to = np.concatenate([[0], text_end])[np.cumsum(n_a + n_b)].tolist()
    code_to = (8 * np.searchsorted(ends_a[last_a], word_end, "right")).tolist()
    found = zip([text[x:y] for x, y in zip([0, *text_to], text_to)],
                [code_bytes[x:y] for x, y in zip([0, *code_to], code_to)], n_a.tolist(), n_b.tolist())
    return [next(found) if g else None for g in good.tolist()]


def _digest(texts: list[bytes], codes: list[int]) -> str:
    """SHA-256 of the joined group texts without the last separator, block by block."""
    state, block = hashlib.sha256(), 1 << 17
    for lo in range(0, len(codes), block):
        part = b"".join([texts[c] for c in codes[lo:lo + block]])
        state.update(part if lo + block < len(codes) else part[:-1])
    return state.hexdigest()


def _links(docs: DataFrame, tokenizers: str | None, batch_bytes: int) -> DataFrame:
    """One row per document with its links as codes, one per batch with its pairs and their counts,
    and at a task's end one with the counts of the identity map."""
    from pyspark import TaskContext
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = (f"batch long, is_doc boolean, doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, "
              "links binary, pairs array<long>, counts array<long>")

    def rows(**columns):
        n = len(next(iter(columns.values())))
        types = {"batch": pa.int64(), "is_doc": pa.bool_(), "doc_id": id_type[0], "n_a": pa.int64(), "n_b": pa.int64(),
                 "n_groups": pa.int64(), "groups_sha256": pa.string(), "links": pa.binary(),
                 "pairs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
        return pa.record_batch([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()],
                               names=list(types))
    id_type: list = [None]

    def encode(batches):
        a_path, b_path = tokenizer_file(BYTE_BPE, tokenizers), tokenizer_file(PIECE_BPE, tokenizers)
        vocabulary = vocabularies(a_path, b_path)
        same = vocabulary[2]

        def make(words):
            found = align_words(words, byte_bpe_ids(a_path, words, True), piece_bpe_ids(b_path, words), vocabulary)
            return found, sum(100 + len(f[0]) + len(f[1]) for f in found if f)  # two byte strings and a tuple each
        table, task, number = WordTable(make), TaskContext.get().partitionId(), 0
        identity = np.zeros(len(same), np.int64)
        for batch in batches:
            id_type[0] = batch.column(0).type
            for run in word_runs(batch.column(1), " ", batch_bytes):
                known = table.get(run.words)
                number += 1
                key = (task << 32) + number
                valid = np.fromiter((k is not None for k in known), bool, len(known))
                known = [k or (b"", b"", 0, 0) for k in known]
                texts = [k[0] for k in known]
                n_a = np.fromiter((k[2] for k in known), np.int64, len(known))
                n_b = np.fromiter((k[3] for k in known), np.int64, len(known))
                n_links = np.fromiter((len(k[1]) // 8 for k in known), np.int64, len(known))
                code = np.frombuffer(b"".join([k[1] for k in known]), np.int64)
                n_words = np.diff(run.first)
                right = _by(~valid[run.codes], n_words) == 0  # rows whose bytes are all the tokens' bytes
                occurs = np.bincount(run.codes[np.repeat(right, n_words)], minlength=len(known))
                weight = np.repeat(occurs, n_links)
                exact = code < 0
                np.add.at(identity, -1 - code[exact], weight[exact])
                used = ~exact & (weight > 0)
                pairs, place = np.unique(code[used], return_inverse=True)
                coded = np.where(exact, code, 0).astype("<i4")
                coded[used] = place
                link_start = np.cumsum(n_links) - n_links
                totals = [np.where(right, _by(x[run.codes], n_words), 0) for x in (n_a, n_b, n_links)]
                digests, links = [], []
                codes, first, right_list = run.codes.tolist(), run.first.tolist(), right.tolist()
                for k in range(run.hi - run.lo):
                    mine = slice(first[k], first[k + 1])
                    some = right_list[k] and first[k] < first[k + 1]
                    digests.append(_digest(texts, codes[mine]) if some else "")
                    c = run.codes[mine]
                    links.append(coded[ranges(link_start[c], n_links[c])].tobytes() if some else b"")
                n = run.hi - run.lo
                yield rows(batch=[key] * n, is_doc=[True] * n, doc_id=batch.column(0).slice(run.lo, n), n_a=totals[0],
                           n_b=totals[1], n_groups=totals[2], groups_sha256=digests, links=links)
                if len(pairs):
                    numbers = np.bincount(place, weight[used], len(pairs)).astype(np.int64)
                    yield rows(batch=[key], is_doc=[False], pairs=[pairs], counts=[numbers])
        seen = np.flatnonzero(identity)
        if len(seen):
            yield rows(is_doc=[False], pairs=[seen << 32 | same[seen]], counts=[identity[seen]])
    return source.mapInArrow(encode, schema)


def align_tokenizers(docs: DataFrame, tokenizers: str | None = None,
                     batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, DataFrame]:
    """Align both tokenizers' ids of ``docs(doc_id, text)``: a frame of documents and one of id pairs.

    Documents: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``; one link per group,
    its last A and B token. ``n_best`` links have the highest count of their B id, ``count_sum`` adds up the
    links' counts. Pairs: ``a_id, b_id, n, best, exact`` over all documents (``exact``: by the identity map).
    ``tokenizers`` is the folder of the tokenizer files (null: the installed package's).

    Null and empty texts, and texts that a tokenizer changes (U+2581, for instance), have no tokens: zeros and
    an empty digest, and they add nothing to the counts. Repeated rows and rows without id each count and stay;
    ties of counts are all best. A text of any length is one row of one batch, its words are looked up in
    blocks. An empty table gives no rows. Other columns are ignored.

    Bounded by the vocabularies: the identity counts and the highest count of each B id, which go to all
    tasks. All other counts stay distributed.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    coded = _links(docs, tokenizers, batch_bytes).checkpoint()
    pairs = (coded.filter(~F.col("is_doc")).select("batch", F.posexplode(F.arrays_zip("pairs", "counts")))
             .select("batch", F.col("pos").alias("code"), F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n")))
    total = pairs.groupBy("pair").agg(F.sum("n").alias("n"), F.max(F.col("batch").isNull()).alias("exact")).checkpoint()
    b_id = F.col("pair").bitwiseAND(F.lit(_LOW))
    highest = total.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))  # a row per B id at most
    counted = (total.withColumn("b_id", b_id).join(F.broadcast(highest), "b_id")
               .select("pair", F.shiftright("pair", 32).alias("a_id"), "b_id", "n", (F.col("n") == F.col("most")).alias("best"),
                       "exact"))
    # a pair of the identity map has one B id per A id: at most a row per A id
    exact = counted.filter("exact").select("a_id", "n", "best").collect()
    size = max((r["a_id"] for r in exact), default=-1) + 1
    identity, identity_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r in exact:
        identity[r["a_id"]], identity_best[r["a_id"]] = r["n"], r["best"]
    shared = spark.sparkContext.broadcast((identity, identity_best))
    others = pairs.filter(F.col("batch").isNotNull()).select(F.col("batch").alias("of_batch"), "code", "pair")
    lists = others.join(counted.select("pair", "n", "best"), "pair").select("of_batch", "code", "n", "best")
    rows = coded.filter("is_doc").select("batch", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = (f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")

    def sums(docs: pa.Table, counts: pa.Table) -> pa.Table:
        exact_n, exact_best = shared.value
        code = counts["code"].to_numpy()
        n, best = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        n[code], best[code] = counts["n"].to_numpy(), counts["best"].to_numpy()
        n_best, count_sum = [], []
        for links in docs["links"]:
            link = np.frombuffer(links.as_buffer(), "<i4")
            own, other = -1 - link[link < 0], link[link >= 0]
            n_best.append(int(exact_best[own].sum() + best[other].sum()))
            count_sum.append(int(exact_n[own].sum() + n[other].sum()))
        return pa.table([docs["doc_id"], docs["n_a"], docs["n_b"], docs["n_groups"], docs["n_groups"],
                         pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs["groups_sha256"]],
                        names=[f.split()[0] for f in out.split(", ")])
    aligned = rows.groupBy("batch").cogroup(lists.groupBy("of_batch")).applyInArrow(sums, out)
    return aligned, counted.drop("pair")
