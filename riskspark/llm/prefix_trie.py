"""Prefix trie of conversations by fixed-length block hashing.

A conversation is a sequence of turns; its trie nodes are its prefixes. A prefix's
signature is the exclusive-or of two 64-bit hashes of (position, SHA-256 of the
turn) over its turns, so signatures of prefixes are running sums and a block of
turns has the difference of two of them. Conversations are grouped block by
block: by the signature before a block, as one group whatever their number.
Where all of a group have the same turns in the block (no siblings diverge),
the conversation with the smallest id speaks for all; only the other
blocks are opened turn by turn for every member.

Sums over subtrees need no walk through the tree. The smallest member of a node
owns it, so a conversation owns the end of its path from some depth on, and
what lies below a node is what its members own.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import ensure_checkpoint_dir

BLOCK_TURNS = 4
#: Rows of one conversation that one window orders; more are ordered stretch by stretch.
STRETCH = 4_096
#: Parts into which the members of one group are dealt.
SALTS = 32


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, position, digest, size`` of ``turns(conv_id, turn, role, text)``: positions from 1 by turn
    (null first); rows of one turn number by role, start of the text and digest; null role or text is empty. Rows without ``conv_id`` belong to no
    conversation. A conversation is ordered in stretches of turn numbers, so a very long one is many tasks'."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"), role.alias("role"), F.substring(text, 1, 64).alias("head"))
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "digest")
    rows = rows.select("conv_id", "stretch", "digest", "size", F.row_number().over(inside).alias("nth")).checkpoint()
    before = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = rows.groupBy("conv_id", "stretch").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(offsets, (F.col("conv_id") == F.col("_conv")) & F.col("stretch").eqNullSafe(F.col("_stretch")))
    return placed.select("conv_id", (F.col("nth") + F.col("_before")).alias("position"), "digest", "size")


def share_first_turns(own: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Rebuild each conversation c: the first h turns of conversation ``c - c % family``, then its own turns
    after its first h, with h = crc32(c) % ``most``. Returns ``(conv_id, length)``, a row for each, and the
    turns ``conv_id, position, digest, size``."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % family
    sizes = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    base_n = sizes.select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"))
    convs = (sizes.withColumn("h", h).withColumn("base", base).join(base_n, F.col("base") == F.col("_base"), "left")
             .withColumn("given", F.least("h", F.coalesce("_n", F.lit(0))))
             .select("conv_id", "base", "h", "given",
                     (F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")).checkpoint())
    mine = (own.join(convs.select(F.col("conv_id").alias("_conv"), "h", "given"), F.col("conv_id") == F.col("_conv"))
            .filter(F.col("position") > F.col("h"))
            .select("conv_id", (F.col("position") - F.col("h") + F.col("given")).alias("position"), "digest", "size"))
    heads = own.filter((F.col("position") < most) & (F.col("conv_id") % family == 0))
    given = (heads.join(convs.select(F.col("conv_id").alias("_conv"), "base", "h"), F.col("conv_id") == F.col("base"))
             .filter(F.col("position") <= F.col("h"))
             .select(F.col("_conv").alias("conv_id"), "position", "digest", "size"))
    return convs.select("conv_id", "length"), mine.unionByName(given)


def conversation_trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """The trie of ``turns(conv_id, position, digest, size)``; ``convs(conv_id, length)`` has a row for each
    conversation, also for those without turns.

    Returns one row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root),
    ``n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` (see the query's contract). Positions must be
    1, 2, .. without gaps in each conversation; ties and repeated rows are settled by whoever numbers them.
    Identical conversations, however many, are one path. No conversation gives no node.

    Two prefixes are one node if their 128-bit signatures agree.
    """
    ensure_checkpoint_dir(turns.sparkSession)
    k = F.floor((F.col("position") - 1) / block)
    steps = turns.select("conv_id", "position", k.alias("k"), "size",
                         *[F.xxhash64(F.lit(seed), "position", "digest").alias(f"x{seed}") for seed in (1, 2)]).checkpoint()

    # blocks: their turns' sums, and the sums of all blocks before, stretch by stretch
    blocks = steps.groupBy("conv_id", "k").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"),
                                               F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    blocks = blocks.withColumn("stretch", F.floor(F.col("k") / STRETCH))
    inside = Window.partitionBy("conv_id", "stretch").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("*", F.coalesce(F.bit_xor("b1").over(inside), zero).alias("i1"),
                           F.coalesce(F.bit_xor("b2").over(inside), zero).alias("i2"),
                           F.coalesce(F.sum("bytes").over(inside), zero).alias("ibytes")).checkpoint()
    per_stretch = blocks.groupBy("conv_id", "stretch").agg(
        F.bit_xor("b1").alias("b1"), F.bit_xor("b2").alias("b2"), F.sum("bytes").alias("bytes"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    per_stretch = per_stretch.select(
        F.col("conv_id").alias("_conv"), F.col("stretch").alias("_stretch"),
        *[F.coalesce(F.bit_xor(b).over(earlier), zero).alias(f"o{b[1]}") for b in ("b1", "b2")],
        F.coalesce(F.sum("bytes").over(earlier), zero).alias("obytes"),
        F.sum("bytes").over(Window.partitionBy("conv_id")).alias("total"))
    s1, s2 = F.col("i1").bitwiseXOR(F.col("o1")), F.col("i2").bitwiseXOR(F.col("o2"))
    blocks = blocks.join(per_stretch, (F.col("conv_id") == F.col("_conv")) & (F.col("stretch") == F.col("_stretch"))).select(
        "conv_id", "k", s1.alias("s1"), s2.alias("s2"), "b1", "b2", "n", (F.col("ibytes") + F.col("obytes")).alias("upto"),
        "total", F.pmod("conv_id", F.lit(SALTS)).alias("salt"))

    # groups: who shares all turns before a block; dealt into parts first, so a group of any size is even
    group = ["k", "s1", "s2"]
    turns_of = F.struct("b1", "b2", "n")
    parts = blocks.groupBy(*group, "salt").agg(F.min("conv_id").alias("first"), F.min(turns_of).alias("low"),
                                               F.max(turns_of).alias("high"))
    groups = parts.groupBy(*group).agg(F.min("first").alias("speaker"),
                                       (F.min("low") == F.max("high")).alias("same"))
    dealt = parts.select(*group, "salt").join(groups, group)
    named = {c: f"_{c}" for c in (*group, "salt")}
    told = blocks.join(dealt.withColumnsRenamed(named), [F.col(c) == F.col(n) for c, n in named.items()]).select(
        "conv_id", "k", "s1", "s2", "upto", "total",
        F.when(F.col("same"), F.col("speaker")).otherwise(F.col("conv_id")).alias("speaker")).checkpoint()

    # opened turn by turn: the speakers' blocks
    opened = told.filter(F.col("conv_id") == F.col("speaker")).select(
        F.col("conv_id").alias("_conv"), F.col("k").alias("_k"), "s1", "s2", "upto")
    within = Window.partitionBy("conv_id", "k").orderBy("position")
    path = (steps.join(opened, (F.col("conv_id") == F.col("_conv")) & (F.col("k") == F.col("_k")))
            .select("conv_id", "k", F.col("position").alias("depth"), "size", "x1", "x2",
                    F.bit_xor("x1").over(within).bitwiseXOR(F.col("s1")).alias("t1"),
                    F.bit_xor("x2").over(within).bitwiseXOR(F.col("s2")).alias("t2"),
                    (F.sum("size").over(within) + F.col("upto")).alias("upto")).checkpoint())

    def spoken(members: DataFrame, *sums: str) -> DataFrame:
        """Sums over the members that each speaker's block stands for, added up per node."""
        weights = members.groupBy(F.col("speaker").alias("_conv"), F.col("k").alias("_k")).agg(
            *[F.sum(c).alias(c) for c in sums])
        return path.join(weights, (F.col("conv_id") == F.col("_conv")) & (F.col("k") == F.col("_k")))

    node = ["depth", "t1", "t2"]
    before1, before2 = F.col("t1").bitwiseXOR(F.col("x1")), F.col("t2").bitwiseXOR(F.col("x2"))
    nodes = spoken(told.withColumn("members", F.lit(1).cast("long")), "members", "total").groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.sum("total").alias("total"),
        F.first("size").alias("size"), F.first("upto").alias("upto"),
        F.first(before1).alias("p1"), F.first(before2).alias("p2")).checkpoint()
    children = nodes.filter(F.col("depth") > 1).groupBy(
        (F.col("depth") - 1).alias("_depth"), F.col("p1").alias("_t1"), F.col("p2").alias("_t2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    at = (F.col("depth") == F.col("_depth")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    nodes = nodes.join(children, at, "left").select(
        *nodes.columns, F.coalesce("n_children", zero).alias("n_children")).checkpoint()

    # chains: what each conversation owns, where it hangs, and whether its end is a leaf
    top = F.struct("depth", "p1", "p2", (F.col("upto") - F.col("size")).alias("above"))
    chains = nodes.groupBy("conv_id").agg(F.min(top).alias("top"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    chains = chains.select(F.col("conv_id").alias("owner"), "top.depth", "top.p1", "top.p2", "top.above", "leaf").checkpoint()
    owned = told.join(chains.select("owner", "above", "leaf"), F.col("conv_id") == F.col("owner"), "left").select(
        "speaker", "k", F.coalesce(F.col("total") - F.col("above"), zero).alias("own"), F.coalesce("leaf", zero).alias("leaves"))
    below = spoken(owned, "own", "leaves").groupBy(*node).agg(F.sum("own").alias("own"), F.sum("leaves").alias("n_leaves"))
    below = below.select(F.col("depth").alias("_depth"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "own", "n_leaves")
    hangs = chains.filter(F.col("depth") > 1).join(
        nodes.select((F.col("depth") + 1).alias("_depth"), "t1", "t2", F.col("conv_id").alias("parent")),
        (F.col("depth") == F.col("_depth")) & (F.col("p1") == F.col("t1")) & (F.col("p2") == F.col("t2"))).select(
        "owner", F.col("depth").alias("_top"), "parent")
    total_of = told.filter(F.col("k") == 0).select("conv_id", "total")
    # the root: two rows of totals
    root = convs.join(total_of, "conv_id", "left").join(
        chains.select("owner", "leaf"), F.col("conv_id") == F.col("owner"), "left").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("total").alias("total"),
        F.sum("leaf").alias("leaves")).first()
    first_turns = nodes.agg(F.sum("size").alias("bytes"), F.count_if(F.col("depth") == 1).alias("n_children")).first()

    # a node's subtree: all its members' bytes below the parent, less one copy of each node there
    above = F.col("upto") - F.col("size")
    copies = F.col("total") - F.col("n_convs") * above
    # the node's owner has its own chain from this depth on, not from its top
    filled = (nodes.join(below, at)
              .join(chains.select(F.col("owner").alias("_owner"), F.col("above").alias("_above"), F.col("depth").alias("_from")),
                    F.col("conv_id") == F.col("_owner"))
              .join(hangs, (F.col("conv_id") == F.col("owner")) & (F.col("depth") == F.col("_top")), "left")
              .withColumn("saved_tokens", copies - (F.col("own") - (above - F.col("_above"))))
              .select("conv_id", "depth", "t1", "t2", F.when(F.col("depth") > F.col("_from"), F.col("conv_id"))
                      .otherwise(F.col("parent")).alias("parent"), "n_convs", "n_children", "n_leaves", "saved_tokens"))
    filled = filled.withColumn("parent", F.coalesce("parent", F.lit(root["conv_id"]).cast("long")))
    if root["n_convs"]:
        filled = filled.unionByName(turns.sparkSession.createDataFrame(
            [(root["conv_id"], 0, 0, 0, None, root["n_convs"], first_turns["n_children"], max(root["leaves"] or 0, 1),
              (root["total"] or 0) - (first_turns["bytes"] or 0))],
            "conv_id long, depth long, t1 long, t2 long, parent long, n_convs long, n_children long, n_leaves long, "
            "saved_tokens long"))
    ends = _end_digests(convs, blocks, block)
    return filled.join(ends, (F.col("depth") == F.col("_depth")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")),
                       "left").select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                                      F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _end_digests(convs: DataFrame, blocks: DataFrame, block: int) -> DataFrame:
    """``_depth, _t1, _t2, ends_sha256``: the ids of the conversations that end at a node, streamed through
    SHA-256 in order. The digest of a list is a chain, so one task reads a node's ids, one at a time."""
    end = blocks.select("conv_id", F.col("k") * block + F.col("n"), F.col("s1").bitwiseXOR(F.col("b1")),
                        F.col("s2").bitwiseXOR(F.col("b2"))).toDF("conv_id", "_depth", "_t1", "_t2")
    length = convs.select(F.col("conv_id").alias("_conv"), "length")
    turned = end.join(length, (F.col("conv_id") == F.col("_conv")) & (F.col("_depth") == F.col("length")))
    zero = F.lit(0).cast("long")
    empty = convs.filter("length = 0").select("conv_id", zero.alias("_depth"), zero.alias("_t1"), zero.alias("_t2"))
    keys = ["_depth", "_t1", "_t2"]
    sorted_ids = (turned.select("conv_id", *keys).unionByName(empty).repartition(*keys)
                  .sortWithinPartitions(*keys, "conv_id").select(*keys, "conv_id"))

    def digests(batches):
        current, state = None, None

        def row(key, state):
            return pa.record_batch([*[pa.array([x], pa.int64()) for x in key], pa.array([state.hexdigest()])],
                                   names=[*keys, "ends_sha256"])
        for batch in batches:
            for *key, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if key != current:
                    if current is not None:
                        yield row(current, state)
                    current, state = key, hashlib.sha256(b"%d" % conv)
                else:
                    state.update(b",%d" % conv)
        if current is not None:
            yield row(current, state)
    return sorted_ids.mapInArrow(digests, "_depth long, _t1 long, _t2 long, ends_sha256 string")


def shared_prefix_trie(conversations: DataFrame, family: int = 5, most: int = 9, block: int = BLOCK_TURNS) -> DataFrame:
    """The trie of ``conversations(conv_id, turn, role, text)`` after each was given its family's first turns
    (``share_first_turns``); see ``conversation_trie`` for the columns.

    Null turns come first, a null role or text is empty, rows without ``conv_id`` belong to no conversation;
    equal turn numbers are ordered by role and text (its start, then its digest), repeated rows are turns of their own. Very long texts are
    hashed once where they are read; a very long conversation is ordered and summed up in stretches. An empty
    table gives no node. Other columns are ignored.
    """
    ensure_checkpoint_dir(conversations.sparkSession)
    own = ordered_turns(conversations).checkpoint()
    return conversation_trie(*share_first_turns(own, family, most), block)
