"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labweave.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that can be reached; only nodes with an edge appear.

    ``edges`` has ``a`` and ``b``. Large-star and small-star steps alternate until the graph is one of stars, a number of rounds that
    grows with the logarithm of the nodes. Each step is an aggregate and a join on the node, so a hub's neighbours are never held together.
    """
    known = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(known):
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        pulled = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        known = stored(pulled.where("u <> v").distinct())
    return known.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(known.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one only, and that is no such node: each component is then a star."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counted = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return counted.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
