"""Measures of records by level, until a record is rejected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extracted(df: DataFrame, levels: list[list[tuple[str, Column, Callable[[Column], Column] | None]]]) -> DataFrame:
    """Adds each measure's column and ``rejected_by``, the name of the first measure whose test holds (null if none).

    levels: the measures of each level as (name, value, test or None). A record that an earlier level rejected has null in the
    columns of later levels, and their values aren't computed for it. Use expressions that give null for bad values (try_divide,
    try_cast): a value of a measure with a test that comes out null isn't a rejection.
    """
    rejected = F.lit(None).cast("string")
    for level in levels:
        df = df.withColumns({"_rejected": rejected} | {name: F.when(rejected.isNull(), value) for name, value, _ in level})
        tests = [F.when(F.col("_rejected").isNull() & F.coalesce(test(F.col(name)), F.lit(False)), F.lit(name)) for name, _, test in level if test is not None]
        rejected = F.coalesce(F.col("_rejected"), *tests)
        df = df.withColumn("_next", rejected).drop("_rejected", "rejected_by").withColumnRenamed("_next", "rejected_by")
        rejected = F.col("rejected_by")
    return df
