"""Connected components of an undirected graph by alternating large-star and small-star steps.

Every round re-links each node's neighbours to the smallest of them, first the larger neighbours, then the smaller
ones, until the edges are stars around each component's smallest node; the number of rounds is logarithmic in
practice. Minima are taken with map-side partial aggregation, written to the shared folder and joined back to the
edges by plain shuffles, so that adaptive execution can split the edges of a hub over tasks. With `each`, what a round
writes goes to as many partitions as the first edges need: few edges over a session's many shuffle partitions are,
round by round, thousands of empty tasks and files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The least number of partitions where they follow the number of edges.
PARTS = 12


def _large_star(edges: DataFrame, parts: int | None) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), parts)
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame, parts: int | None) -> DataFrame:
    down = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), parts)
    least = cut(down.groupBy("u").agg(F.min("v").alias("least")), parts)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges (v < u) are stars: every u once, and no v a u."""
    n = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).first()
    return n["n"] == n["u"] and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60, each: int | None = None) -> DataFrame:
    """node, root of every node of an edge (u, v: long); root is the component's smallest node. Self-loops and nulls are left out.

    each: edges of a partition of what the rounds write; without it there are as many partitions as shuffles have.
    """
    parts = each and max(PARTS, -(-edges.count() // each))
    now = cut(edges.select("u", "v").where("u <> v").distinct(), parts)
    if not now.isEmpty():
        for _ in range(max_rounds):
            now = cut(_small_star(_large_star(now, parts), parts), parts)
            if _settled(now):
                break
        else:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
