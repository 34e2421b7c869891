"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge; root is the least node of its component.

    ``edges`` has columns u and v of one orderable type.  Each round writes its edges into
    the shared folder; rounds stop when a round changes nothing, when each edge ends in a root.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        after = saved(_small_star(_large_star(now)), "edges")
        # done when no edge ends in a node that is itself hung somewhere, and no node hangs twice
        ends = after.select(F.col("u").alias("node"), F.lit(1).alias("hung"), F.lit(0).alias("holds")).unionByName(after.select(F.col("v").alias("node"), F.lit(0).alias("hung"), F.lit(1).alias("holds")))
        open_ends = ends.groupBy("node").agg(F.sum("hung").alias("hung"), F.max("holds").alias("holds")).where("hung > 1 or (hung = 1 and holds = 1)").limit(1).count()
        drop_saved(now)
        now = after
        if not open_ends:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
