"""Connected components of an edge table, without collecting nodes, edges or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkeep.llm.common import drop, stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge (u, v) touches and that is not its component's smallest node.

    Large-star and small-star steps alternate until the table stays the same, in O(log^2 n) rounds; each round is
    written to the shared folder, so plans stay short and lost executors cost one round at most; the round before it is
    deleted. A hub is an aggregate
    with partial sums and a skewed join, which adaptive execution splits.
    """
    now, mark = stage(edges.where("u <> v").distinct(), "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen[0] == 0 or seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, before = seen, now
        now = stage(_small_star(_large_star(before)), "edges")
        drop(before)  # no plan refers to it any more
