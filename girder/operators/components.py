"""Connected components by repeated contraction of the link table (GR-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.shared import staged


def connected_components(links: DataFrame, left: str = "a", right: str = "b", jumps: int = 2) -> DataFrame:
    """Label every linked vertex with the smallest vertex of its component.

    links: undirected links between ids of one orderable type; self links, repeats
    and either direction are allowed, rows with a null end are ignored.
    Returns (id, component) for vertices that have a link to another vertex; an empty
    link table gives an empty result. Each round lets a vertex adopt its smallest
    neighbour, shortens the chains so made, and keeps only links between different
    labels, so the table shrinks geometrically; all rounds are joins and
    aggregations with map-side combining, written to the shared folder after each step, which keeps every plan small.
    """
    a, b = F.col(left), F.col(right)
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = staged(edges, "links")
    labels, left_over, vertices = None, edges.count(), None
    while left_over:
        ends = min(2 * left_over, vertices or 2 * left_over)
        parents = edges.select(F.col("b").alias("id"), F.col("a").alias("p")).groupBy("id").agg(F.min("p").alias("p"))
        roots = edges.select(F.col("a").alias("id")).distinct().join(parents, "id", "left_anti").select("id", F.col("id").alias("p"))
        parents = staged(parents.unionByName(roots), "parents", ends)
        for _ in range(jumps):
            up = parents.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            parents = staged(parents.join(up, "p", "left").select("id", F.coalesce("pp", "p").alias("p")), "parents", ends)
        named = labels
        if named is None:
            vertices = parents.count()
            labels = parents.select("id", F.col("p").alias("component"))
        else:
            up = parents.select(F.col("id").alias("component"), "p")
            labels = staged(named.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels", vertices)
        for end in ("a", "b"):
            up = parents.select(F.col("id").alias(end), "p")
            edges = edges.join(up, end).drop(end).withColumnRenamed("p", end)
        edges = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = staged(edges, "links", left_over)
        left_over = edges.count()
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
