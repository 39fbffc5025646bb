"""Connected components of an edge table, never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root) for every node of an edge, root being the smallest node reachable.

    Alternating large-star and small-star rounds until a round changes nothing, which is after a number
    of rounds that grows with the logarithm of the nodes; each one is written, so a lost executor costs
    a round at most, and deleted when the next one stands. A hub's rows are minimised by partial
    aggregation, and the joins have plain shuffles on both sides, which adaptive execution can split.
    Self-loops and null ends are dropped; an edge table without rows gives no rows.
    """
    live = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _sum(live)
    while True:
        both = live.union(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")), "low")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct(), "large")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = materialize(moved.union(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        discard(live, low, large, least)
        live, after = small, _sum(small)
        if after == before:
            break
        before = after
    return live.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(live.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
