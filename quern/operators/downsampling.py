"""Downsampling of series to a bounded number of points that look like the whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points kept of each output point's range before triangles are compared.
PRESELECT = 4


def largest_triangles(x: np.ndarray, y: np.ndarray, number: int) -> np.ndarray:
    """Places of ``number`` points: the ends, and of each range between the point with the largest triangle with the point
    chosen before and the mean of the next range."""
    n = len(x)
    if n <= number or number < 3:
        return np.arange(n)
    edges = np.linspace(1, n - 1, number - 1).astype(int)
    chosen = [0]
    for i in range(number - 2):
        a, b = edges[i], max(edges[i] + 1, edges[i + 1])
        c, d = (edges[i + 1], max(edges[i + 1] + 1, edges[i + 2])) if i < number - 3 else (n - 1, n)
        px, py = x[chosen[-1]], y[chosen[-1]]
        area = np.abs((x[a:b] - px) * (y[c:d].mean() - py) - (y[a:b] - py) * (x[c:d].mean() - px))
        chosen.append(a + int(area.argmax()))
    return np.array([*chosen, n - 1])


def downsample(points: DataFrame, series: list[str], x: str, y: str, number: int = 2000) -> DataFrame:
    """At most ``number`` points of each series.

    A series can be any size: its x range is cut into PRESELECT x ``number`` parts, of which the least and the greatest y are
    kept by an aggregation; only those, a bounded number, meet in one task. Points without x or a finite y are left out.
    """
    rows = points.select(*series, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < float("inf")))
    spans = rows.groupBy(*series).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in series]
    joined = rows.alias("r").join(spans.alias("s"), on=same).select(*(F.col(f"r.{c}").alias(c) for c in series), "x", "y", "low", "high", "n")
    part = F.when(F.col("n") <= number, F.col("x")).otherwise(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * (PRESELECT * number)))
    ends = joined.withColumn("part", part).groupBy(*series, "part").agg(F.min(F.struct("y", "x")).alias("a"), F.max(F.struct("y", "x")).alias("b"), F.min(F.struct("x", "y")).alias("c"), F.max(F.struct("x", "y")).alias("d"))
    few = ends.select(*series, F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"{e}.x").alias("x"), F.col(f"{e}.y").alias("y")) for e in "abcd")))).alias("p")).select(*series, "p.x", "p.y")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["x", "y"], kind="stable")
        return group.iloc[largest_triangles(group["x"].to_numpy(), group["y"].to_numpy(), number)]

    return few.groupBy(*series).applyInPandas(run, few.schema)
