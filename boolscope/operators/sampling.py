"""Draws by weight in constant time each: alias tables in buckets."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = "bucket long, slot long, id long, other long, share double, slots long, total double"


def _aliases(pdf: pd.DataFrame) -> pd.DataFrame:
    """One slot per item: its own share of the slot, and the other item that has the rest."""
    pdf = pdf.sort_values("id", ignore_index=True)
    n, total = len(pdf), float(pdf["w"].sum())
    left = pdf["w"].to_numpy(float) * n / total
    share, other = np.ones(n), np.arange(n)
    poor, rich = [i for i in range(n) if left[i] < 1], [i for i in range(n) if left[i] >= 1]
    while poor and rich:
        i, j = poor.pop(), rich[-1]
        share[i], other[i] = left[i], j
        left[j] -= 1 - left[i]
        if left[j] < 1:
            poor.append(rich.pop())
    ids = pdf["id"].to_numpy()
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[0], "slot": range(n), "id": ids, "other": ids[other], "share": share, "slots": n, "total": total})


def alias_table(weights: DataFrame, per_bucket: int = 10_000) -> DataFrame:
    """(bucket, slot, id, other, share, slots, total) from (id, w): in a bucket with so many slots, slot gives id with the
    probability share, else other; total is the bucket's weight.

    Items are dealt to buckets of per_bucket items about by a hash, and each bucket's table is made by itself, so no sum or order runs
    over all of them. Items of weight 0 or less, or null, are left out.
    """
    weights = weights.where("w > 0")
    buckets = max(1, math.ceil(weights.count() / per_bucket))
    dealt = weights.select("id", F.col("w").cast("double").alias("w"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandas(_aliases, SLOTS)


def masses(table: DataFrame) -> DataFrame:
    """(id, w): the weights that a table draws by."""
    one = F.col("total") / F.col("slots")
    both = F.array(F.struct("id", (one * F.col("share")).alias("w")), F.struct(F.col("other").alias("id"), (one * (1 - F.col("share"))).alias("w")))
    return table.select(F.inline(both)).groupBy("id").agg(F.sum("w").alias("w"))


def _uniform(*of: Column | int) -> Column:
    return F.pmod(F.xxhash64(*(F.lit(x) if isinstance(x, int) else x for x in of)), F.lit(1 << 40)) / float(1 << 40)


def draws(spark: SparkSession, table: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(draw, id): n draws with replacement, by ``picked``."""
    asked = spark.range(n).select(F.col("id").alias("draw"))
    return picked(asked, table, seed).select("draw", F.col("picked").alias("id"))


def picked(asked: DataFrame, table: DataFrame, seed: int = 0) -> DataFrame:
    """asked with picked, a draw with replacement for each row, by its number in the column draw. A bucket is drawn first, by an alias
    table of the buckets, then a slot of it; both are found by equality joins. The same seed and numbers give the same draws."""
    totals = table.groupBy("bucket").agg(F.max("total").alias("w"), F.max("slots").alias("of_bucket"))
    top = alias_table(totals.select(F.col("bucket").alias("id"), "w"), 1 << 62)
    many = top.count()
    kept = asked.columns
    if not many:
        return asked.select(*kept, F.lit(None).cast("long").alias("picked")).limit(0)
    top = top.select(F.col("slot").alias("k_top"), F.col("id").alias("first"), F.col("other").alias("second"), F.col("share").alias("p_top"))
    asked = asked.withColumn("k_top", F.floor(_uniform(seed, 1, F.col("draw")) * many)).join(top, "k_top")
    asked = asked.select(*kept, F.when(_uniform(seed, 2, F.col("draw")) < F.col("p_top"), F.col("first")).otherwise(F.col("second")).alias("bucket"))
    asked = asked.join(totals.select("bucket", "of_bucket"), "bucket")
    asked = asked.select(*kept, "bucket", F.floor(_uniform(seed, 3, F.col("draw")) * F.col("of_bucket")).alias("slot"))
    found = asked.join(table.select("bucket", "slot", "id", "other", "share"), ["bucket", "slot"])
    return found.select(*kept, F.when(_uniform(seed, 4, F.col("draw")) < F.col("share"), F.col("id")).otherwise(F.col("other")).alias("picked"))
