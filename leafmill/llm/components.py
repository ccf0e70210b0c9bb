"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import cut


def _star(pairs: DataFrame, keep_larger: bool, parts: int | None) -> DataFrame:
    """One contraction of ``u, v`` with u > v.

    Large star ties each larger neighbour of a node to the least node among the
    node and its neighbours; small star does so with the smaller neighbours and
    the node itself.
    """
    if keep_larger:
        around = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs
    # the minima are written out, so that both sides of the join are plain
    # exchanges and a hub's rows can be split over tasks
    least = cut(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), parts)
    moved = around.join(least, "u")
    if keep_larger:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    moved = moved.where(F.col("u") > F.col("v"))
    return (moved.coalesce(parts) if parts else moved).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", parts: int | None = None) -> DataFrame:
    """``node, component`` of every node with an edge; component is its least node.

    Null ends and loops are left out. Rounds stop when the pairs do not change;
    their number grows with the logarithm of the longest chain. ``parts`` bounds
    the partitions between steps, for edges far fewer than a shuffle is made for.
    """
    pairs = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct(), parts)
    state = None
    while True:
        seen = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == state:
            break
        state = seen
        pairs = cut(_star(cut(_star(pairs, True, parts), parts), False, parts), parts)
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(pairs.select("v", "v").distinct())
