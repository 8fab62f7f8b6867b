"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.session import ensure_checkpoint_dir


def component_roots(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)``, one row per node that has an edge.

    Each round every node points to its smallest neighbour (or itself), pointers
    are followed to their ends (each step doubles the way, so a chain of n nodes
    takes log n steps), and the edges are rewritten to these ends; equal edges and
    loops go. Only nodes smaller than all their neighbours are ends, so a component
    at least halves per round, and the loop ends when no edge is left. Minima are pre-aggregated in the map
    tasks; nodes with very many edges only make the joins uneven, which the
    skew join of adaptive execution splits. Null ends are dropped.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    links = edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct().checkpoint()
    labels = None
    while not links.isEmpty():
        near = (links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
                .groupBy("u").agg(F.min("v").alias("v"))
                .select(F.col("u").alias("node"), F.least("u", "v").alias("parent")))
        parents, moved = near.checkpoint(), True
        while moved:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            parents = parents.join(up, "parent").select(
                "node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")).checkpoint()
            moved = not parents.filter("moved").isEmpty()
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("root"))
        else:
            next_root = parents.select(F.col("node").alias("root"), "parent")
            labels = labels.join(next_root, "root", "left").select(
                "node", F.coalesce("parent", "root").alias("root")).checkpoint()
        pu = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        pv = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        links = (links.join(pu, "u").join(pv, "v").filter(F.col("pu") != F.col("pv"))
                 .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
                 .distinct().checkpoint())
    if labels is None:
        labels = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
