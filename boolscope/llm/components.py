"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, save, saved_path

MAX_ROUNDS = 60


def connected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) of every node in an edge, root being the smallest node reachable.

    Edges are pairs of longs in any order; loops and repeats are fine, nulls are dropped. Each round hangs every
    neighbourhood on its smallest node (Kiveris et al. 2014), so rounds grow with the logarithm of the longest
    path. A round's edges are a table in the shared folder, which lost executors can't take along, and minima are
    pre-aggregated, so that a hub's edges aren't gathered in a task. Nothing but a count and a checksum reaches the
    driver.
    """
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = save(e.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    spark, seen = e.sparkSession, None
    for _ in range(MAX_ROUNDS):
        n, total = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = (n, total)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last = saved_path(e)
        e = save(small, "edges")
        remove(spark, last)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
