"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join. A node with very many edges is pre-aggregated before the shuffle; the minima are written
before they are joined, so that the join is one of two plain shuffles and adaptive execution can split that node's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has two columns u, v of one type that can be ordered and hashed. Returns (node, component): component is the smallest node reachable. Nodes without an edge are absent.
    Steps go on until none changes an edge, however many that takes (they grow with the square of the logarithm of the nodes at most)."""
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, after = None, _state(e)
    while after[0] and after != before:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lower).distinct()
        done, e = [e, least, large, lower], stored(small, "edges")
        before, after = after, _state(e)
        for x in done:
            discard(x)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
