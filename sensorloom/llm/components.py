"""Connected components of an edge table, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, release


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), for every node that has an edge.

    Alternating large-star and small-star steps: each node's larger neighbours,
    then its smaller ones, are tied to the smallest node near it, until each node
    has one smaller neighbour, and that one none. Every round is written to the
    shared folder, so lineage stays short and lost executors cost one round.
    Nothing but counts reaches the driver.
    """
    one = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(one(edges))
    for _ in range(most):
        size = now.count()
        lower = now.select("a").distinct()
        if not now.join(lower.withColumnRenamed("a", "b"), "b", "left_semi").take(1) and lower.count() == size:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = one(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        now, old = materialize(one(small), size), now
        release(old)
    raise RuntimeError(f"components did not settle in {most} steps")
