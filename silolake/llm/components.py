"""Connected components of a link table, by hooking and pointer jumping.

Each round works on the contracted graph (one vertex per component so far): a
vertex with a smaller neighbour hooks to the smallest one, the trees that arise
are flattened by pointer jumping, and the links are relabelled and made
distinct. The graph shrinks in every round, so a handful of rounds suffices;
each ends in a stored table. Sums per vertex are pre-aggregated, so a vertex
with very many links is no hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _flatten(parents: DataFrame) -> DataFrame:
    """(v, p) with every p the root of v: p moves up until nothing changes."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
        parents = stored(parents.join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")), "parents")
        if not parents.where("moved").limit(1).count():
            return parents.drop("moved")
        parents = parents.drop("moved")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each end of ``links`` (a, b): the smallest id that can be reached."""
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None  # (id, component) of all vertices that hooked so far
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).where("p < v")
        roots = _flatten(stored(hooks, "hooks"))
        if labels is None:
            labels = roots.select(F.col("v").alias("id"), F.col("p").alias("component"))
        else:
            moved = labels.join(roots.withColumnRenamed("v", "component"), "component", "left")
            labels = stored(moved.select("id", F.coalesce("p", "component").alias("component")).union(roots.select("v", "p")), "labels")
        to_a, to_b = (roots.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        edges = stored(edges.join(to_a, "a", "left").join(to_b, "b", "left")
                       .select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return labels.union(labels.select(F.col("component").alias("id"), "component")).distinct()
