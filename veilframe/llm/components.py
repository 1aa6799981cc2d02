"""Connected components of a table of edges, by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is a shuffle of the edges that are left; the number of edges never grows, and the number of steps grows with
the logarithm of the nodes. Neighbours of a node are combined by a minimum, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's neighbours (all larger ones, or itself and the smaller ones) to its smallest neighbour or itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        tied = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("low").alias("a"), "b")
        return tied.where(F.col("a") != F.col("b")).distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    tied = down.join(low, "a").select(F.col("low").alias("a"), F.col("b")).unionByName(low.select(F.col("low").alias("a"), F.col("a").alias("b")))
    return tied.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges (a, b)``; the component is its smallest node."""
    current = materialize(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        facts = current.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("b").alias("ends")).first()
        inner = current.select("a").join(current.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        if facts["n"] == facts["ends"] and not inner:
            break  # every node hangs on one root, and no root hangs on another
        current = materialize(_star(_star(current, True), False), "edges")
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        current.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
