"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicspark.operators.shared import checkpoint_root


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them.  Edges come as (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return tied.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame, first: str, second: str) -> DataFrame:
    """``node`` and ``component`` (its smallest member) for every node that has an edge.

    Large-star and small-star rounds alternate until the edges are stars around the smallest nodes; the number of
    rounds grows with the logarithm of the component sizes, and each round's edges are checkpointed.  A hub's edges are
    only joined to one aggregated row, so a skewed join can split them.
    """
    checkpoint_root(edges.sparkSession)
    pairs = edges.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    pairs = pairs.filter("a <> b").distinct().checkpoint()
    seen = None
    while True:
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = tuple(mark)
        pairs = _small_star(_large_star(pairs)).checkpoint()
