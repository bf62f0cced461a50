"""Readers: schemas are given, never inferred from a pass over the data; missing columns get defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

RAW_DOCUMENT = "id string, text string, metadata string, added timestamp, created timestamp"
ID_NAMES = ("chunk_id", "uid", "guid", "id")
PAIR = r"([^?.]+\?)\s+([^?.]+\.)"


def json_lines(spark: SparkSession, path: str, schema: str | StructType = RAW_DOCUMENT, keep_malformed: bool = False) -> DataFrame:
    """JSON lines, compressed or not. Malformed lines are left out, or kept whole in ``_corrupt_record``."""
    if keep_malformed:
        text = schema if isinstance(schema, str) else schema.simpleString()[7:-1].replace(":", " ")
        return spark.read.schema(text + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def parquet_table(spark: SparkSession, path: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """A Parquet dataset (partition columns included); columns that are missing get their default."""
    df = spark.read.parquet(path)
    return df.withColumns({n: v for n, v in (defaults or {}).items() if n not in df.columns})


def files_below(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """All files of a pattern in any depth, without statistics and markers."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(path)


def with_id(df: DataFrame, names: tuple[str, ...] = ID_NAMES) -> DataFrame:
    """``record_id``: the first of the id columns that is there and not null."""
    present = [F.col(n).cast("string") for n in names if n in df.columns]
    return df.withColumn("record_id", F.coalesce(*present) if present else F.lit(None).cast("string"))


def row_shard(df: DataFrame, key: str, number: int, shard: int) -> DataFrame:
    """The rows of one of ``number`` shards by a hash of the key."""
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(number)) == shard)


def question_pairs(lines: DataFrame, text: str = "value") -> DataFrame:
    """``question, answer, place``: the question and answer pairs packed in lines of text."""
    pairs = F.regexp_extract_all(F.col(text), F.lit(PAIR), F.lit(0))
    rows = lines.select("*", F.posexplode(pairs).alias("place", "pair"))
    return rows.withColumns({"question": F.trim(F.regexp_extract("pair", PAIR, 1)), "answer": F.trim(F.regexp_extract("pair", PAIR, 2))}).drop("pair")


def benchmark_items(df: DataFrame) -> DataFrame:
    """``item``: the question, or the whole row as JSON where there is none."""
    whole = F.to_json(F.struct(*df.columns))
    return df.withColumn("item", F.coalesce(F.col("question"), whole) if "question" in df.columns else whole)


#: Columns by which the rows of the text tables are spread.
KEYS = {"documents": "doc_id", "normalized_documents": "id"}


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows over all cores, where a scan has work for less than half of them: a small file is one partition, and
    work on texts is long. On a scan with partitions enough, as any large table has, nothing is moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if 2 * df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables; filters and columns reach the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df, KEYS[name]) if name in KEYS and KEYS[name] in df.columns else df
