"""Connected components of a graph given as edges, by alternating star contraction.

Each round joins every node's neighbours to the smallest of them; the number of rounds grows with
the logarithm of the graph. A node's smallest neighbour is an aggregate that is combined before the
shuffle, and the join that hands it out is one that Spark can split where a node has many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u > v)."""
    if large:
        seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = edges
    # Written, so that both sides of the join are dealt by it alone and a node with many edges can be split.
    least = stored(seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    met = seen.join(least, "u")
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    Nodes are longs. Edges may repeat, point either way or be loops; null ends are dropped.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (x != y)).distinct())
    sign = None
    for _ in range(max_rounds):
        now = stored(_star(_star(now, True), False))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == sign:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select("v", "v").distinct())
        sign = new
    raise RuntimeError(f"components had not settled after {max_rounds} rounds")
