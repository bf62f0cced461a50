"""Round trips through files and streams, greedy admission, and joins of every kind on the star schema."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.checkpoints import shared_folder
from quern.operators.admission import batched_fill, rolling_admission, skip_fit
from quern.operators.sequences import packed_in_order
from quern.plans.registry import query, table
from quern.sources import readers, writers
from quern.streaming import telemetry as live


def _path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _docs(spark, folder):
    return table(spark, folder, "documents")


@query("src01_json_lines", "SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def json_lines(spark, folder):
    """Documents through gzipped JSON lines and back."""
    path = _path(spark, "json")
    _docs(spark, folder).select("doc_id", "text").write.option("compression", "gzip").json(path)
    return readers.json_lines(spark, path, "doc_id bigint, text string").where("text IS NOT NULL").select("doc_id", F.length("text").alias("n"), F.md5("text").alias("digest"))


@query("src02_parquet", "SELECT doc_id, band, domain, 'none' AS extra FROM documents")
def parquet(spark, folder):
    path = _path(spark, "parquet")
    writers.parquet(_docs(spark, folder).select("doc_id", "band", "domain"), path)
    return readers.parquet_table(spark, path, {"extra": F.lit("none")}).select("doc_id", "band", "domain", "extra")


@query("src03_csv", "SELECT item_id, benchmark, md5(question) AS digest FROM eval_items")
def csv(spark, folder):
    path = _path(spark, "csv")
    writers.in_format(table(spark, folder, "eval_items"), path, "csv")
    return readers.csv_table(spark, path, "item_id bigint, benchmark string, question string").select("item_id", "benchmark", F.md5("question").alias("digest"))


@query("src04_partitions", "SELECT source, count(*) AS n FROM documents WHERE source IN ('wikiish', 'coderepo') GROUP BY source")
def partitions(spark, folder):
    """Partition directories by source; only the wanted ones are read."""
    path = _path(spark, "by_source")
    writers.parquet(_docs(spark, folder).select("doc_id", "source"), path, ["source"])
    return spark.read.parquet(path).where(F.col("source").isin("wikiish", "coderepo")).groupBy("source").agg(F.count("*").alias("n"))


@query("src06_sharded_rows", "SELECT doc_id::VARCHAR AS record_id FROM documents")
def sharded_rows(spark, folder):
    """The union of all shards is the table."""
    rows = readers.with_id(_docs(spark, folder).select(F.col("doc_id").alias("guid")))
    parts = [readers.row_shard(rows, "record_id", 4, i) for i in range(4)]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).select("record_id")


@query("src13_question_pairs", "WITH p AS (SELECT item_id, unnest(regexp_extract_all(question, '([^?.]+\\?)\\s+([^?.]+\\.)')) AS pair FROM eval_items) SELECT item_id, trim(regexp_extract(pair, '([^?.]+\\?)\\s+([^?.]+\\.)', 1)) AS question, trim(regexp_extract(pair, '([^?.]+\\?)\\s+([^?.]+\\.)', 2)) AS answer FROM p")
def question_pairs(spark, folder):
    return readers.question_pairs(table(spark, folder, "eval_items").select("item_id", F.col("question").alias("value"))).select("item_id", "question", "answer")


@query("src14_benchmark_items", "SELECT benchmark, count(*) AS n, sum(length(question))::BIGINT AS n_chars FROM eval_items GROUP BY benchmark")
def benchmark_items(spark, folder):
    return readers.benchmark_items(table(spark, folder, "eval_items")).groupBy("benchmark").agg(F.count("*").alias("n"), F.sum(F.length("item")).alias("n_chars"))


@query("snk02_split_write", "SELECT is_rejected, band, count(*) AS n FROM band_records WHERE band IS NOT NULL GROUP BY ALL")
def split_write(spark, folder):
    """Accepted and rejected rows by band in one write, instead of one write and one scan for each."""
    path = _path(spark, "split")
    writers.parquet(table(spark, folder, "band_records").where("band IS NOT NULL").select("uuid", "id", "is_rejected", "band"), path, ["is_rejected", "band"])
    return spark.read.parquet(path).withColumn("is_rejected", F.col("is_rejected").cast("boolean")).groupBy("is_rejected", "band").agg(F.count("*").alias("n"))


@query("snk03_json_by_source", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def json_by_source(spark, folder):
    path = _path(spark, "json_by_source")
    writers.json_by_source(_docs(spark, folder).where("source IS NOT NULL").select("doc_id", "source"), path)
    return spark.read.schema("doc_id bigint, source string").json(path).groupBy("source").agg(F.count("*").alias("n"))


@query("snk05_formats", "SELECT kind, count(*) AS n FROM runs, (VALUES ('csv'), ('jsonl'), ('orc'), ('parquet')) k(kind) GROUP BY kind")
def formats(spark, folder):
    rows, out = table(spark, folder, "runs").select("run_id", "status"), None
    for kind in ("csv", "jsonl", "orc", "parquet"):
        path = _path(spark, kind)
        writers.in_format(rows, path, kind)
        reader = spark.read.schema("run_id string, status string").option("header", True).format({"jsonl": "json"}.get(kind, kind))
        part = reader.load(path).select(F.lit(kind).alias("kind"))
        out = part if out is None else out.union(part)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("snk09_merged_parts", "SELECT 'docs' AS part, count(*) AS n FROM documents UNION ALL SELECT 'items', count(*) FROM eval_items")
def merged_parts(spark, folder):
    """Parts with different columns put together by name; what a part lacks is null."""
    a = _docs(spark, folder).select(F.lit("docs").alias("part"), F.col("doc_id").alias("key"), "band")
    b = table(spark, folder, "eval_items").select(F.lit("items").alias("part"), F.col("item_id").alias("key"), "benchmark")
    return a.unionByName(b, allowMissingColumns=True).groupBy("part").agg(F.count("*").alias("n"))


def _stream(spark, folder, name):
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


@query("str01_fan_out", "SELECT event_id, key, TRY_CAST(json_extract_string(props, '$.' || key) AS DOUBLE) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE TRY_CAST(json_extract_string(props, '$.' || key) AS DOUBLE) IS NOT NULL")
def stream_fan_out(spark, folder):
    rows = _stream(spark, folder, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "text"))
    return live.drained(spark, rows.select("event_id", "key", F.expr("try_cast(text AS double)").alias("value")).where("value IS NOT NULL"), "fan_out")


@query("str02_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, folder):
    events = _stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = live.window_counts(events, "ts", "1 day", "event_type", late="3650 days")
    return live.drained(spark, counts, "windows", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("str03_alerts", "SELECT run_id, metric, step, value FROM metric_points WHERE metric = 'loss' AND value > 9.0 AND NOT isnan(value)")
def stream_alerts(spark, folder):
    return live.drained(spark, live.alerts(_stream(spark, folder, "metric_points").where("NOT isnan(value)"), "loss", 9.0).select("run_id", "metric", "step", "value"), "alerts")


@query("sel05_skip_fit")
def skip(spark, folder):
    """Of each language the longest documents that fit 100,000 characters, skipping those that don't."""
    rows = _docs(spark, folder).where("lang IS NOT NULL").select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.lit(100_000).alias("capacity"))
    return skip_fit(rows, "lang", "n", "doc_id", "n", "capacity")


@query("sel14_rolling_admission")
def rolling(spark, folder):
    rows = _docs(spark, folder).select("doc_id", F.coalesce("band", F.lit("none")).alias("band"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    shares = {"B0": 0.25, "B1": 0.35, "B2": 0.2, "B3": 0.1, "B4": 0.05, "B5": 0.05}
    return rolling_admission(rows, "band", "doc_id", "n", shares, 2_000_000, 0.03)


@query("sel11_batched_budgets")
def batched(spark, folder):
    """Batches of 500 consecutive ids under a stage's budget by band; what a batch lacks is made up later."""
    rows = _docs(spark, folder).select("doc_id", "band", F.floor(F.col("doc_id") / 500).alias("batch"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).where("band IS NOT NULL")
    shares = {"B0": 0.3, "B1": 0.3, "B2": 0.2, "B3": 0.1, "B4": 0.05, "B5": 0.05}
    return batched_fill(rows, "batch", "band", "n", "doc_id", "n", shares, 500_000)


@query("pck04_linear_packs")
def linear(spark, folder):
    """Documents of a source in order, until a pack has 2,048 words."""
    rows = _docs(spark, folder).select("doc_id", "source", F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("n"))
    return packed_in_order(rows, "source", "doc_id", "n", 2048)


def _t(spark, folder, name):
    return table(spark, folder, name)


def revenue():
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")


@query("smoke_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS mean_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing(spark, folder):
    rows = _t(spark, folder, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), revenue(), F.round(F.avg("l_discount"), 6).alias("mean_discount"), F.count("*").alias("n"))


@query("smoke_nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def nation_revenue(spark, folder):
    j = _t(spark, folder, "customer").join(_t(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey")).join(_t(spark, folder, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(_t(spark, folder, "supplier"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(_t(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(revenue())


@query("smoke_semi_anti", "SELECT c_mktsegment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS n_with, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS n_without FROM customer GROUP BY c_mktsegment")
def semi_anti(spark, folder):
    buyers = _t(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("has")).distinct()
    j = _t(spark, folder, "customer").join(buyers, "c_custkey", "left")
    return j.groupBy("c_mktsegment").agg(F.count("has").alias("n_with"), F.count_if(F.col("has").isNull()).alias("n_without"))


@query("smoke_rollup", "SELECT r_name, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup(spark, folder):
    j = _t(spark, folder, "customer").join(F.broadcast(_t(spark, folder, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(_t(spark, folder, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("smoke_top_parts", "SELECT l_suppkey, l_partkey, quantity FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_partkey) AS place FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE place <= 3")
def top_parts(spark, folder):
    """A top-k report: three parts of each supplier."""
    g = _t(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("quantity"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("quantity"), "l_partkey"))).where("place <= 3").drop("place")
