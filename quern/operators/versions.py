"""Tables in which the last version of a key holds, and the last rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_version(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key: the greatest by ``order``. One aggregation that combines before the shuffle, so a key with very
    many versions costs no more than others; equal rows sent twice are one."""
    rest = [c for c in df.columns if c != key and c not in order]
    row = F.max(F.struct(*order, *rest)).alias("row")
    return df.groupBy(key).agg(row).select(*(key if c == key else F.col(f"row.{c}").alias(c) for c in df.columns))


def first_of_each(df: DataFrame, groups: list[str], order: list[Column], number: int) -> DataFrame:
    """The first ``number`` rows of each group. Spark keeps only so many of a group in each partition before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= number)
