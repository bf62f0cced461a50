"""Telemetry of training runs: parsing, last versions, dashboards' questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.downsampling import downsample
from quern.operators.versions import first_of_each, last_version
from quern.plans.registry import query, table

#: The dashboards' "now" is a parameter, so that results don't depend on when they are asked for.
NOW = "2025-09-01 00:00:00"
ALERT_LOSS = 9.0
RING = 100


def points(spark, folder):
    return table(spark, folder, "metric_points")


def runs(spark, folder):
    return last_version(table(spark, folder, "runs"), "run_id", "updated_time", "created_time")


def _finite(name: str = "value"):
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))


_RUNS = "runs_now AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY updated_time DESC, created_time DESC, status DESC) = 1)"


@query("obs01_parsed_lines", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parsed(spark, folder):
    return table(spark, folder, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("obs02_raw_defaults", "SELECT run_id, metric, step, coalesce(nullif(host, ''), 'unknown') AS host, coalesce(unit, '') AS unit, CASE WHEN device = 65535 THEN -1 ELSE coalesce(device, -1) END AS device, count(*) AS n_rows FROM metric_points GROUP BY ALL")
def raw(spark, folder):
    host = F.when(F.col("host").isNull() | (F.col("host") == ""), "unknown").otherwise(F.col("host"))
    device = F.when(F.col("device") == 65535, -1).otherwise(F.coalesce("device", F.lit(-1)))
    return points(spark, folder).select("run_id", "metric", "step", host.alias("host"), F.coalesce("unit", F.lit("")).alias("unit"), device.alias("device")).groupBy("run_id", "metric", "step", "host", "unit", "device").agg(F.count("*").alias("n_rows"))


@query("obs03_typed_events", "SELECT event_type, count(*) AS n_events, min(ts) AS first_time, max(ts) AS last_time, round(sum(value), 4) AS total FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def typed(spark, folder):
    return table(spark, folder, "events").where("event_type IS NOT NULL").groupBy("event_type").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_time"), F.max("ts").alias("last_time"), F.round(F.sum("value"), 4).alias("total"))


@query("obs04_arrays", "SELECT run_id, step, count(DISTINCT metric) AS n_metrics, count(*) AS n_values FROM metric_points WHERE isfinite(value) GROUP BY run_id, step")
def arrays(spark, folder):
    """Finite values by run and step; what isn't a number is dropped."""
    return points(spark, folder).where(_finite()).groupBy("run_id", "step").agg(F.countDistinct("metric").alias("n_metrics"), F.count("*").alias("n_values"))


@query("obs05_fan_out", "SELECT event_id, key, TRY_CAST(json_extract_string(props, '$.' || key) AS DOUBLE) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) WHERE TRY_CAST(json_extract_string(props, '$.' || key) AS DOUBLE) IS NOT NULL")
def fan_out(spark, folder):
    """One row for each numeric property of an event."""
    rows = table(spark, folder, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "text"))
    return rows.select("event_id", "key", F.expr("try_cast(text AS double)").alias("value")).where("value IS NOT NULL")


@query("obs06_statuses", f"WITH {_RUNS} SELECT status, count(*) AS n_runs, count(*) FILTER (status IN ('completed', 'stopped')) AS n_ended FROM runs_now GROUP BY status")
def statuses(spark, folder):
    return runs(spark, folder).groupBy("status").agg(F.count("*").alias("n_runs"), F.count_if(F.col("status").isin("completed", "stopped")).alias("n_ended"))


@query("obs07_last_versions", f"WITH {_RUNS} SELECT run_id, created_time, updated_time, status, model_size FROM runs_now")
def last_versions(spark, folder):
    return runs(spark, folder).select("run_id", "created_time", "updated_time", "status", "model_size")


@query("obs08_series", "SELECT run_id, metric, event_time, step, round(value, 9) AS value FROM metric_points WHERE metric = 'loss' AND step BETWEEN 10 AND 1000 AND isfinite(value)")
def series(spark, folder):
    return points(spark, folder).where((F.col("metric") == "loss") & F.col("step").between(10, 1000) & _finite()).select("run_id", "metric", "event_time", "step", F.round("value", 9).alias("value")).orderBy("run_id", "step", "event_time")


@query("obs09_latest_values", "SELECT run_id, metric, max(step) AS last_step, arg_max(value, (step, event_time, value)) AS value FROM metric_points WHERE isfinite(value) GROUP BY run_id, metric")
def latest(spark, folder):
    return points(spark, folder).where(_finite()).groupBy("run_id", "metric").agg(F.max("step").alias("last_step"), F.max(F.struct("step", "event_time", "value"))["value"].alias("value"))


@query("obs10_last_events", "SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100")
def last_events(spark, folder):
    """A top-k report: the last 100 events of a type."""
    return table(spark, folder, "events").where("event_type = 'purchase'").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("obs11_run_overview", f"""WITH {_RUNS}, a AS (SELECT run_id, min(event_time) AS first_time, max(event_time) AS last_time, max(step) AS max_step, count(*) AS n_points FROM metric_points GROUP BY run_id)
  SELECT a.run_id, first_time, last_time, max_step, n_points, r.status, r.model_name FROM a LEFT JOIN runs_now r USING (run_id)""")
def overview(spark, folder):
    totals = points(spark, folder).groupBy("run_id").agg(F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"), F.max("step").alias("max_step"), F.count("*").alias("n_points"))
    return totals.join(runs(spark, folder).select("run_id", "status", "model_name"), "run_id", "left")


@query("obs12_active", f"""WITH {_RUNS}, a AS (SELECT run_id, max(event_time) AS last_time FROM metric_points GROUP BY run_id)
  SELECT a.run_id, coalesce(r.status = 'running', false) OR a.last_time >= TIMESTAMPTZ '{NOW}+00' - INTERVAL 300 SECOND AS is_active FROM a LEFT JOIN runs_now r USING (run_id)""")
def active(spark, folder):
    last = points(spark, folder).groupBy("run_id").agg(F.max("event_time").alias("last_time"))
    recent = F.col("last_time") >= F.to_timestamp(F.lit(NOW)) - F.expr("INTERVAL 300 SECONDS")
    return last.join(runs(spark, folder).select("run_id", "status"), "run_id", "left").select("run_id", (F.coalesce(F.col("status") == "running", F.lit(False)) | recent).alias("is_active"))


@query("obs13_run_ids", "SELECT run_id FROM metric_points UNION SELECT run_id FROM runs")
def run_ids(spark, folder):
    return points(spark, folder).select("run_id").union(table(spark, folder, "runs").select("run_id")).distinct()


@query("obs14_recent_runs", f"SELECT DISTINCT run_id FROM metric_points WHERE event_time > TIMESTAMPTZ '{NOW}+00' - INTERVAL 5 DAY")
def recent_runs(spark, folder):
    return points(spark, folder).where(F.col("event_time") > F.to_timestamp(F.lit(NOW)) - F.expr("INTERVAL 5 DAYS")).select("run_id").distinct()


@query("obs15_newer_rows", f"SELECT run_id, count(*) AS n_new, max(event_time) AS high_water FROM metric_points WHERE event_time > TIMESTAMPTZ '{NOW}+00' GROUP BY run_id")
def newer(spark, folder):
    return points(spark, folder).where(F.col("event_time") > F.to_timestamp(F.lit(NOW))).groupBy("run_id").agg(F.count("*").alias("n_new"), F.max("event_time").alias("high_water"))


@query("obs16_downsampled")
def downsampled(spark, folder):
    return downsample(points(spark, folder), ["run_id", "metric"], "step", "value", 200)


@query("obs17_single_values", "SELECT metric, max(step) AS max_step, count(*) AS n_points, max(value) FILTER (isfinite(value)) AS max_value, count(DISTINCT run_id) AS n_runs FROM metric_points GROUP BY metric")
def single_values(spark, folder):
    return points(spark, folder).groupBy("metric").agg(F.max("step").alias("max_step"), F.count("*").alias("n_points"), F.max(F.when(_finite(), F.col("value"))).alias("max_value"), F.countDistinct("run_id").alias("n_runs"))


@query("obs18_rank_series", "SELECT run_id, 'rank-' || rank AS label, count(*) AS n_points, round(avg(value), 6) AS mean_value FROM metric_points WHERE metric = 'loss' AND isfinite(value) GROUP BY run_id, rank")
def rank_series(spark, folder):
    rows = points(spark, folder).where((F.col("metric") == "loss") & _finite())
    return rows.groupBy("run_id", F.concat(F.lit("rank-"), F.col("rank")).alias("label")).agg(F.count("*").alias("n_points"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("obs19_best_runs", "SELECT run_id, min(value) AS best_loss FROM metric_points WHERE metric = 'loss' AND isfinite(value) GROUP BY run_id ORDER BY best_loss, run_id LIMIT 10")
def best_runs(spark, folder):
    """A top-k report: the ten runs with the least loss."""
    return points(spark, folder).where((F.col("metric") == "loss") & _finite()).groupBy("run_id").agg(F.min("value").alias("best_loss")).orderBy("best_loss", "run_id").limit(10)


@query("obs20_ring", f"SELECT metric, event_time, run_id, step FROM metric_points QUALIFY row_number() OVER (PARTITION BY metric ORDER BY event_time DESC, run_id DESC, step DESC, rank DESC, value DESC) <= {RING}")
def ring(spark, folder):
    """The last points of each metric; RING is the feature's size."""
    order = [F.desc(c) for c in ("event_time", "run_id", "step", "rank", "value")]
    return first_of_each(points(spark, folder), ["metric"], order, RING).select("metric", "event_time", "run_id", "step")


@query("obs21_alerts", f"SELECT run_id, count(*) AS n_alerts, min(step) AS first_step FROM metric_points WHERE metric = 'loss' AND isfinite(value) AND value > {ALERT_LOSS} GROUP BY run_id")
def alerts(spark, folder):
    return points(spark, folder).where((F.col("metric") == "loss") & _finite() & (F.col("value") > ALERT_LOSS)).groupBy("run_id").agg(F.count("*").alias("n_alerts"), F.min("step").alias("first_step"))


def readable(size):
    return F.when(size >= 2**20, F.concat(F.floor(size / 2**20), F.lit(" MB"))).when(size >= 2**10, F.concat(F.floor(size / 2**10), F.lit(" KB"))).otherwise(F.concat(size, F.lit(" B")))


@query("obs23_readable_sizes", "SELECT source, CASE WHEN n >= 1048576 THEN floor(n / 1048576)::BIGINT || ' MB' WHEN n >= 1024 THEN floor(n / 1024)::BIGINT || ' KB' ELSE n || ' B' END AS size FROM (SELECT source, sum(octet_length(encode(text)))::BIGINT AS n FROM documents GROUP BY source)")
def readable_sizes(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("n")).select("source", readable(F.col("n")).alias("size"))
