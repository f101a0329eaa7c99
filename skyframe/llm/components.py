"""Connected components by alternating large and small stars, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select("low", "high")).toDF("node", "other")
    least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
    return both.join(least, "node").where("other > node").select(F.col("other").alias("high"), F.col("least").alias("low"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node itself, is tied to the smallest one."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    moved = edges.join(least, "high").where("low <> least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return moved.union(least.select("high", F.col("least").alias("low")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges(high, low)`` with ``high > low``; root is the smallest node.

    Rounds go on until nothing changes, about the logarithm of the longest path. Each is written to
    the shared folder; the driver sees a count and a checksum of the edges only.
    """
    edges = saved(edges.select("high", "low").distinct(), "edges")
    mark = None
    while True:
        signs = F.xxhash64("high", "low")
        seen = edges.agg(F.count("*"), F.sum(F.shiftright(signs, 24)), F.bit_xor(signs)).first()
        if seen == mark or not seen[0]:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(
                edges.select("low", "low").distinct()
            )
        mark = seen
        edges = saved(_small_star(_large_star(edges).distinct()).distinct(), "edges")
