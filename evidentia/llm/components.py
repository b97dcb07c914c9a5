"""Connected components by alternating large-star and small-star steps over an edge table.

Each step moves edges towards the smallest node of a neighbourhood; minima are combined before the shuffle and joined
back with plain joins, so a node with very many edges is split by adaptive execution. Between rounds the edges are a
table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m"))
    moved = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    return moved.where("hi <> lo").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m")).select(F.col("hi").alias("w"), "m")
    joined = edges.join(least, F.col("hi") == F.col("w"))
    moved = joined.select(F.col("lo").alias("a"), "m").unionByName(least.select(F.col("w").alias("a"), "m"))
    return moved.where("a <> m").select(F.col("a").alias("hi"), F.col("m").alias("lo")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links, in any order and repeated -> (node, root) for every node with a link, root being the smallest node
    of its component; (root, root) is there too."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if (state.n, state.s) == mark or not state.n:
            break
        mark = (state.n, state.s)
        now = written(_small(_large(now)), "edges")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
