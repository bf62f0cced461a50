"""Pairs of the members of large buckets, block against block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked_pairs(rows: DataFrame, item: str, value: str, most: int) -> DataFrame:
    """``a < b, va, vb``: every pair of items of a bucket and their values, once for each bucket. rows: key, n (members of the bucket), item, value.

    A bucket is cut into blocks of about ``most`` members by the items' hashes, and every block meets itself and every other
    one, so that no task holds a bucket and no pair is left out."""
    blocks = F.ceil(F.col("n") / most).cast("int")
    rows = rows.select("key", F.col(item).alias("item"), F.col(value).alias("value"), (blocks - 1).alias("last"), F.pmod(F.xxhash64(item), blocks).cast("int").alias("own"))
    left = rows.select("key", F.col("own").alias("i"), F.explode(F.sequence("own", "last")).alias("j"), F.col("item").alias("x"), F.col("value").alias("vx"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.col("item").alias("y"), F.col("value").alias("vy"))
    met = left.join(right, ["key", "i", "j"]).where("x < y OR i < j AND x != y")
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("vx")).otherwise(F.col("vy")).alias("va"), F.when(first, F.col("vy")).otherwise(F.col("vx")).alias("vb"))
