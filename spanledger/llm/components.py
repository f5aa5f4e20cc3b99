"""Connected components of an edge table, in rounds of star contraction.

Each round links every node to the smallest node it has met: all of a node's larger
neighbours go to its smallest neighbour (large star), then all its smaller neighbours and
itself do (small star), until nothing changes. Only the smallest neighbour of each node is
aggregated, never its list, so a node of any degree is summed map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node -> root, the smallest node of its component, from edges (a, b); each node of an edge appears once."""
    edges = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    while True:
        # Large star: for each node, its larger neighbours point to its smallest neighbour or itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = cut(large)
        # Small star: for each node, its smaller neighbours and itself point to the smallest of them.
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = _signature(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
