"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.operators.skew import stored

#: Alternations of the two steps after which something must be wrong: they need about the square of the logarithm of the links.
MAX_ROUNDS = 60


def connected_components(links: DataFrame) -> DataFrame:
    """`node`, `component` (smallest node reachable) of every node of the links (a, b), which may repeat or loop.

    Large-star and small-star alternate: each node hangs its larger, then its smaller neighbours on the smallest one it sees, until
    all links lead straight to a root. Every round is written to the shared folder, so lineage stays short and a lost executor
    costs one step. Minima are aggregated before the shuffle and stored, so that adaptive execution
    can split the join with them where a node has many links.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(MAX_ROUNDS):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = state
        links = stored(_small_star(_large_star(links)), "links")
    raise RuntimeError("components did not settle")


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them. Links lead from the larger to the smaller end."""
    low = stored(links.groupBy("a").agg(F.min("b").alias("low")), "lowest")
    hung = links.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
    return hung.unionByName(low.select("a", F.col("low").alias("b"))).distinct()
