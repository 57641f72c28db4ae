"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squelch.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b; comparable ids) -> node, label: the smallest node of the component, one
    row per node that has an edge.

    Alternates large-star and small-star steps: each node hands its neighbours to the smallest
    node it knows. Edges never grow in number, the rounds are about the logarithm of the longest
    path, and heavy nodes cost one pre-aggregated row per task, as a neighbour list is never
    gathered. Each round is checkpointed.
    """
    edges = cut(_oriented(edges))
    while True:
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger=True)
        after = cut(_oriented(_star(large, larger=False)))
        stable = after.join(edges, ["a", "b"], "left_anti").isEmpty() and edges.join(
            after, ["a", "b"], "left_anti"
        ).isEmpty()
        edges = after
        if stable:
            break
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges, ``a`` the larger end, no loops."""
    return (
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star (edges in both directions): neighbours larger than the node go to the smallest
    of the node and its neighbours. Small star (edges from larger to smaller): all smaller
    neighbours and the node itself do.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("_m", "a"))
    joined = edges.join(least, "a")
    if larger:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b"))
    moved = joined.select(F.col("b").alias("a"), F.col("_m").alias("b"))
    return moved.unionByName(least.select("a", F.col("_m").alias("b"))).filter(F.col("a") != F.col("b"))
