"""Cutting lineage through tables in a folder that all executors share.

The folder is a subfolder, for this application, of the one that the cluster names in ``spark.checkpoint.dir``. Only where that
is unset and driver and executors are one process (tests, a laptop) a temporary folder is made and entered in the session, so
that one session has one folder; on a cluster it is an error, as a folder of one machine isn't seen by the others.
Unlike ``localCheckpoint`` the written table survives the loss of executors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
OWN_KEY = "quern.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder, as a URI or path."""
    context = spark.sparkContext
    named = context.getConf().get(KEY)
    if named:
        return f"{named.rstrip('/')}/quern-{context.applicationId}"
    folder = spark.conf.get(OWN_KEY, None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError(f"{KEY} is not set: name a folder there that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set(OWN_KEY, folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` read back from a table written once, so that later steps don't compute them again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the table that ``written`` returned, when neither it nor what follows from it is read again."""
    _delete(df.sparkSession, df.written_to)


def release(spark: SparkSession) -> None:
    """Deletes the tables that this application has written, and nothing else of the shared folder; call it when no result is
    read any more."""
    _delete(spark, shared_folder(spark))
