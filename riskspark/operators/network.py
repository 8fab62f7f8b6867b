"""Risk networks over shared attributes (N1-N4, C5), without building pair lists.

Entities sharing an attribute (device, ip, counterparty, a time slot ...) are
linked *through* the attribute node of a bipartite graph ``(entity,
attribute)``. Every operator works on that edge list with grouped partial
aggregates, so a hot attribute shared by a third of all entities costs one
aggregate row, never the quadratic pair list:

* one-hop propagation needs, per attribute, the best and second-best score
  (so an entity never counts itself);
* connected components link an attribute's entities to the smallest of them,
  contract that graph twice (every entity is replaced by its smallest neighbour),
  and finish what is left by alternating large-star / small-star rounds
  (O(log^2 n)), checkpointed to the shared folder each round and stopped when
  both ends of every edge share a parent.

Joins of edges with per-attribute aggregates are skewed by hot attributes; AQE
skew-join splitting (enabled in the session) divides the large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.config import CAMPAIGN_EXPOSURE_FACTOR, FLAG_THRESHOLD
from riskspark.functions.columns import map_lookup

#: Times that the linked entities are replaced by their smallest neighbours before the star rounds.
CONTRACTIONS = 2


def build_links(df: DataFrame, entity: str, attribute_cols: list[str]) -> DataFrame:
    """Bipartite edges ``(entity, attr_type, attribute)`` from attribute columns (NULLs skipped)."""
    parts = F.array(*[F.struct(F.lit(c).alias("attr_type"), F.col(c).cast("string").alias("attribute"))
                      for c in attribute_cols])
    return df.select(F.col(entity).alias("entity"), F.inline(parts)) \
        .where(F.col("attribute").isNotNull()).distinct()


def attribute_degrees(edges: DataFrame) -> DataFrame:
    """Entities per attribute (the hot attributes are visible here, never dropped)."""
    return edges.groupBy("attribute").agg(F.count(F.lit(1)).alias("degree"))


def propagate_one_hop(edges: DataFrame, scores: DataFrame, factor: float = 0.8,
                      cap: float = 100.0, factors: dict | None = None) -> DataFrame:
    """``(entity, score, propagated, is_mule)``: best ``factor x score`` over entities
    sharing an attribute.

    ``factors`` gives a factor per link type (``attr_type`` of ``build_links``), others
    count ``factor``. Per attribute the top score, how many hold it, and the best
    score below it are partial aggregates; an entity's view of an attribute excludes
    itself. ``is_mule`` marks entities whose own score reaches the flag threshold.
    """
    kind = F.col("attr_type") if "attr_type" in edges.columns else F.lit(None).cast("string")
    weight = F.coalesce(map_lookup(factors, kind), F.lit(factor)) if factors else F.lit(factor)
    s = edges.withColumns({"_kind": F.coalesce(kind, F.lit("")), "_factor": weight}).join(
        scores, "entity", "left").select(
        "entity", "_kind", "_factor", "attribute", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    on = ["_kind", "attribute"]
    top = s.groupBy(*on).agg(F.max("score").alias("m1"))
    s2 = s.join(top, on)
    stats = s2.groupBy(*on).agg(
        F.first("m1").alias("m1"),
        F.count_if(F.col("score") == F.col("m1")).alias("c1"),
        F.max(F.when(F.col("score") < F.col("m1"), F.col("score"))).alias("m2"),
        F.count(F.lit(1)).alias("n"))
    other_best = F.when(F.col("n") < 2, F.lit(None).cast("double")) \
        .when((F.col("score") < F.col("m1")) | (F.col("c1") > 1), F.col("m1")).otherwise(F.col("m2"))
    best = s.join(stats, on).groupBy("entity").agg(F.max(other_best * F.col("_factor")).alias("nb"))
    return scores.join(best, "entity", "left").select(
        "entity", "score", F.least(F.lit(cap), F.coalesce(F.col("nb"), F.lit(0.0))).alias("propagated"),
        (F.coalesce(F.col("score"), F.lit(0.0)) >= F.lit(FLAG_THRESHOLD)).alias("is_mule"))


def propagate(edges: DataFrame, scores: DataFrame, rounds: int = 3, factor: float = 0.8,
              cap: float = 100.0) -> DataFrame:
    """N2, r rounds: ``risk = max(own, factor x best neighbour risk)`` repeated (max-product
    paths of up to ``rounds`` hops). Each round is the one-hop operator on the previous
    round's risk, checkpointed to the shared folder; stops early when nothing changes."""
    from riskspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(scores.sparkSession)
    cur = scores.select("entity", F.col("score").alias("risk")).checkpoint()
    for _ in range(rounds):
        hop = propagate_one_hop(edges, cur.select("entity", F.col("risk").alias("score")), factor, cap)
        nxt = hop.select("entity", F.greatest(F.col("score"), F.col("propagated")).alias("risk")).checkpoint()
        changed = nxt.join(cur.withColumnRenamed("risk", "old"), "entity") \
            .where(F.col("risk") != F.col("old")).limit(1).count()
        cur = nxt
        if changed == 0:
            break
    return scores.join(cur, "entity", "left").select("entity", "score", "risk")


def _entity_links(edges: DataFrame) -> DataFrame:
    """Bipartite edges -> links ``(a, b)`` of entities, ``b < a``: every holder of an attribute with the smallest one.
    An attribute held by one entity gives none."""
    held = edges.select("entity", "attribute").where(F.col("entity").isNotNull() & F.col("attribute").isNotNull())
    smallest = held.groupBy("attribute").agg(F.min("entity").alias("b"))
    return (held.join(smallest, "attribute").where(F.col("entity") != F.col("b"))
            .select(F.col("entity").alias("a"), "b").distinct())


def _contract(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replace every entity by its smallest neighbour: ``(a, to)`` of those replaced, and the links between the others.

    Entities linked before have linked or equal successors, so components stay the same; the smallest entity
    of a component is never replaced."""
    smaller = links.groupBy("a").agg(F.min("b").alias("to")).checkpoint()
    of_b = smaller.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
    moved = links.join(smaller, "a").join(of_b, "b", "left").select("to", F.coalesce("to_b", "b").alias("other"))
    return smaller, moved.where(F.col("to") != F.col("other")).select(
        F.greatest("to", "other").alias("a"), F.least("to", "other").alias("b")).distinct().checkpoint()


def _large_star(e: DataFrame) -> DataFrame:
    """Connect every larger neighbour of u to the smallest node of u's closed neighbourhood."""
    m = e.groupBy("src").agg(F.min("dst").alias("m")) \
        .select("src", F.least(F.col("m"), F.col("src")).alias("m"))
    out = e.where(F.col("dst") > F.col("src")).join(m, "src").select(F.col("dst").alias("a"), F.col("m").alias("b"))
    return _undirected(out)


def _small_star(e: DataFrame) -> DataFrame:
    """Connect u and its smaller neighbours to the smallest of them."""
    small = e.where(F.col("dst") < F.col("src"))
    m = small.groupBy("src").agg(F.min("dst").alias("m"))
    out = small.join(m, "src").select(F.col("dst").alias("a"), F.col("m").alias("b")) \
        .unionByName(m.select(F.col("src").alias("a"), F.col("m").alias("b")))
    return _undirected(out)


def _undirected(pairs: DataFrame) -> DataFrame:
    p = pairs.where(F.col("a") != F.col("b"))
    both = p.select(F.col("a").alias("src"), F.col("b").alias("dst")) \
        .unionByName(p.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    return both.distinct()


def connected_components(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(entity, component)`` = smallest entity id reachable through shared attributes.

    An attribute's entities are linked to the smallest of them, a hot attribute is a
    star, never a clique. ``CONTRACTIONS`` times each entity is replaced by its smallest
    neighbour, which leaves little of a densely linked graph; alternating large-star /
    small-star (Kiveris et al., "Connected Components in MapReduce and Beyond",
    2014) finishes any rest, however long its paths, in O(log^2 n) rounds
    instead of one round per hop of the diameter. Each round is checkpointed to the
    shared folder; it stops when the two ends of every edge have the same parent
    (smallest node of the closed neighbourhood) and raises if that doesn't come about in
    ``max_rounds``. Entity ids may be of any type that has an order.
    """
    from riskspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(edges.sparkSession)
    links, steps = _entity_links(edges).checkpoint(), []
    while not links.isEmpty():
        if len(steps) == CONTRACTIONS:
            steps.append(_star_parents(links, max_rounds))
            break
        smaller, links = _contract(links)
        steps.append(smaller)
    found = edges.select("entity").distinct().select("entity", F.col("entity").alias("component"))
    for step in steps:
        found = found.join(step.withColumnRenamed("a", "component"), "component", "left").select(
            "entity", F.coalesce("to", "component").alias("component"))
    return found


def _star_parents(links: DataFrame, max_rounds: int) -> DataFrame:
    """``(a, to)``: the smallest entity of the component of every linked entity."""
    e = _undirected(links).checkpoint()
    for _ in range(max_rounds):
        e = _small_star(_large_star(e)).checkpoint()
        parent = e.groupBy("src").agg(F.min("dst").alias("p")) \
            .select("src", F.least(F.col("p"), F.col("src")).alias("p"))  # short plan over checkpointed e
        # converged when every edge joins two nodes with the same parent: labels are
        # then constant on each component (a forest of stars satisfies it)
        ends = e.join(parent, "src").join(
            parent.select(F.col("src").alias("dst"), F.col("p").alias("p_dst")), "dst")
        if ends.where(F.col("p") != F.col("p_dst")).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    return parent.select(F.col("src").alias("a"), F.col("p").alias("to")).checkpoint()


def component_summary(components: DataFrame, scores: DataFrame, edges: DataFrame,
                      flag: float = FLAG_THRESHOLD) -> DataFrame:
    """Per component size, mean risk, mules (score >= flag), exposure and hub.

    The hub is the entity with most attributes (ties: smallest id).
    """
    deg = edges.groupBy("entity").agg(F.countDistinct("attribute").alias("degree"))
    j = components.join(scores, "entity", "left").join(deg, "entity", "left") \
        .select("component", "entity", F.coalesce("score", F.lit(0.0)).alias("score"),
                F.coalesce("degree", F.lit(0)).alias("degree"))
    is_mule = F.col("score") >= F.lit(flag)
    return j.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.avg("score").alias("mean_risk"),
        F.count_if(is_mule).alias("mules"),
        F.coalesce(F.sum(F.when(is_mule, F.col("score") * F.lit(CAMPAIGN_EXPOSURE_FACTOR))), F.lit(0.0))
        .alias("exposure_lakh"),
        F.min(F.struct((-F.col("degree")).alias("d"), "entity")).alias("_hub")) \
        .withColumn("hub", F.col("_hub.entity")).drop("_hub")


def campaign_lookup(requested: DataFrame, summary: DataFrame, components: DataFrame,
                    default_score: float = 50.0) -> DataFrame:
    """Campaign of each requested entity; unknown entities get the default score."""
    comp = requested.select("entity").join(components, "entity", "left")
    return comp.join(summary, "component", "left").select(
        "entity", "component", F.coalesce(F.col("mean_risk"), F.lit(default_score)).alias("campaign_score"),
        F.coalesce(F.col("size"), F.lit(0)).alias("campaign_size"))


def ego_network(edges: DataFrame, scores: DataFrame, entity) -> DataFrame:
    """The entity, its attributes and every entity sharing one, with scores (0 when unknown)."""
    mine = edges.where(F.col("entity") == F.lit(entity)).select("attribute")
    around = edges.join(mine, "attribute").select("entity", "attribute")
    return around.join(scores, "entity", "left").select(
        "entity", "attribute", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
