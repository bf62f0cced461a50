"""Taking rows of groups up to a budget, without sorting a group in one task.

A group's rows have an order (a score, then an id). The running total before a row decides whether it is taken. Groups may
hold a third of all rows, so totals are built in two levels: all rows are cut into ranges of the total order of group, order
and id, the ranges' totals are small and get running sums, and only rows within one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.checkpoints import written


def with_total_before(df: DataFrame, groups: list[str], order: str, tie: str, size: str, descending: bool = True, ranges: int | None = None) -> DataFrame:
    """Adds ``before``: the sum of ``size`` over the rows of the group that come earlier by ``order`` and then ``tie`` (both in the
    same direction). Null sizes count as 0; null orders come last, null groups are one group.

    The ranges (as many as shuffle partitions, unless given) are cut at sampled places of the order, the tie included, so that
    they hold about equally many rows whatever the values' distribution: one outlier, a single value for all rows or one group
    with most rows make no range longer. A range's start is a row of its own in the running sum, so nothing is joined.
    """
    spark = df.sparkSession
    direction = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_last())
    number = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(number, *groups, direction(order), direction(tie)).withColumn("_cut", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    totals = ranged.groupBy(*groups, "_cut").agg(F.sum(F.coalesce(F.col(size), F.lit(0))).alias("_sum"))
    earlier = Window.partitionBy(*groups).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "_cut", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_added"), F.lit(0).alias("_mark"))
    rows = ranged.withColumns({"_added": F.coalesce(F.col(size), F.lit(0)), "_mark": F.lit(1)})
    both = rows.unionByName(starts, allowMissingColumns=True)
    inner = Window.partitionBy(*groups, "_cut").orderBy("_mark", direction(order), direction(tie)).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("before", F.sum("_added").over(inner)).where("_mark = 1").drop("_cut", "_added", "_mark")


def fill(df: DataFrame, groups: list[str], order: str, tie: str, size: str, target: str | Column) -> DataFrame:
    """Rows of each group from the best down, while the total before a row is below the group's target."""
    return with_total_before(df, groups, order, tie, size).where(F.col("before") < (F.col(target) if isinstance(target, str) else target)).drop("before")
