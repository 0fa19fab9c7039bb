"""Connected components of a graph in DataFrames, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour (itself included)."""
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("least"))
    return both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them. Edges have src > dst."""
    least = edges.groupBy("src").agg(F.min("dst").alias("least"))
    moved = edges.join(least, "src").where("dst <> least").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(least.select("src", F.col("least").alias("dst"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (src long, dst long): root is the least node that it reaches.

    Duplicate edges, loops and either direction are fine; null ends are dropped. An empty graph gives an
    empty result. The stars' joins are on a node, so that a hub is a skewed join, which AQE splits; its
    least neighbour is a partial aggregate. Each round is checkpointed; rounds grow with the logarithm
    of the longest path, and the loop ends when a round changes nothing.
    """
    ordered = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    current, mark = checkpointed(ordered.distinct()), None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(
                current.select(F.col("dst").alias("node"), F.col("dst").alias("root"))
            ).distinct()
        mark = seen
        current = checkpointed(_small_star(_large_star(current).distinct()))
