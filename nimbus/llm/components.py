"""Connected components of an edge table by alternating large and small stars.

Each round rewires edges towards the smallest neighbour; a component is a star
around its smallest node after a number of rounds that grows with the logarithm
of its size. The edge table is written to the shared folder after every round,
and the rounds end as soon as it holds nothing but stars: the driver keeps track
of every task of a round, so none is spent on a second look at the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbus.session import stored


def _stars(edges: DataFrame) -> bool:
    """True if every node hangs on one other node, and that one on no other: no round would change such edges (`u > v`)."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs")))
    found = ends.groupBy("node").agg(F.sum("hangs").alias("times"), F.min("hangs").alias("centre"))
    return not found.where("times > 1 OR (times = 1 AND centre = 0)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """`node, component` for all nodes of `links` (`a, b`); the component is its smallest node."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    while not _stars(edges):
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        lower = joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
