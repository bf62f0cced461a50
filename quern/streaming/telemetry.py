"""Streams of telemetry lines.

Transformations are functions of DataFrames and serve batches and streams alike; only windows need a watermark. Results of a
stream that has been read to its end (``drained``) are written to the session's shared folder, with the stream's own
checkpoint beside them, so a restarted driver goes on where it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.checkpoints import shared_folder

LINE = "timestamp timestamp, run_id string, host string, rank int, step long, metrics map<string,string>, context map<string,string>"


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines as rows; lines that are no JSON object give nulls and are left out."""
    return lines.select(F.from_json(column, LINE).alias("x")).where(F.col("x.run_id").isNotNull()).select("x.*")


def metric_rows(rows: DataFrame) -> DataFrame:
    """One row for each metric of a line whose value is a number."""
    exploded = rows.select(F.col("timestamp").alias("event_time"), "run_id", "host", F.coalesce("rank", F.lit(0)).alias("rank"), F.coalesce("step", F.lit(0)).alias("step"), F.explode("metrics").alias("metric", "text"))
    return exploded.withColumn("value", F.expr("try_cast(text AS double)")).where("value IS NOT NULL").drop("text")


def event_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("context")["event"] == "event").select(F.col("timestamp").alias("event_time"), "run_id", "host", F.coalesce(F.col("context")["severity"], F.lit("info")).alias("severity"), F.coalesce(F.col("context")["message"], F.lit("")).alias("message"))


def checkpoint_rows(rows: DataFrame, protected: tuple[str, ...] = ("best", "final")) -> DataFrame:
    kept = F.col("context")["event"] == "checkpoint"
    return rows.where(kept).select(F.col("timestamp").alias("event_time"), "run_id", F.col("context")["path"].alias("path"), F.coalesce(F.col("context")["tag"].isin(*protected), F.lit(False)).alias("is_protected"))


def window_counts(rows: DataFrame, time: str, window: str, *by: str, late: str = "1 hour") -> DataFrame:
    """Rows and sums of ``value`` by window; rows later than ``late`` behind the latest no longer count."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def alerts(rows: DataFrame, metric: str, limit: float) -> DataFrame:
    return rows.where((F.col("metric") == metric) & (F.col("value") > limit))


def drained(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is read to the end. In complete mode the last result replaces the ones before."""
    base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    out, state = f"{base}/rows", f"{base}/state"
    writer = stream.writeStream.option("checkpointLocation", state).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def fan_out(stream: DataFrame, sinks: dict[str, tuple[Callable[[DataFrame], DataFrame], str]], state: str):
    """Starts one query that reads the stream once and writes each sink's rows. A batch that is run again overwrites what it
    wrote before, as its number is the name of its directory."""

    def write(df: DataFrame, number: int) -> None:
        df = df.persist()
        for transform, path in sinks.values():
            transform(df).write.mode("overwrite").parquet(f"{path}/batch={number}")
        df.unpersist()

    return stream.writeStream.option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
