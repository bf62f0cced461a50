"""The queries of the ten problems, by name: what the driver runs and checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import fields, language, leakage, mixing, neardup, packing, percentiles, quality, sampling, subjects, tokens
from quern.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    types = quality.text_types(table(spark, folder, "normalized_documents"), table(spark, folder, "common_words"))
    return types.where(F.col("text_kind") != "prose").select("id", "text_kind")


def p1_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.text_types(table(spark, folder, "normalized_documents"), table(spark, folder, "common_words"))


def p1_voters(spark: SparkSession, folder: str) -> DataFrame:
    return quality.voters(table(spark, folder, "normalized_documents"), table(spark, folder, "common_words"))


def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_budget(table(spark, folder, "normalized_documents"), table(spark, folder, "tokenizer_pieces"), table(spark, folder, "language_labels"))


def p2_records(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "normalized_documents"), table(spark, folder, "tokenizer_pieces"))


def p3_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.group_percentiles(table(spark, folder, "metric_points"))


def p3_rank_check(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "metric_points")
    return percentiles.rank_check(points, percentiles.group_percentiles(points).where("scope = 'all'"))


def _passages(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    documents = table(spark, folder, "normalized_documents")
    return language.languages(documents, language.fit(documents, table(spark, folder, "language_labels")), whole=whole)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose label is missing, wrong or too few, with each of their languages; lists, tables and junk aside."""
    documents = table(spark, folder, "normalized_documents")
    checked = language.label_check(documents, table(spark, folder, "language_labels"), _passages(spark, folder))
    return checked.where("is_case").select("id", "lang_code").join(p1_found(spark, folder).select("id"), "id", "left_anti")


def p4_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with words: its languages, or that of the whole text if it has no passage, against its label."""
    documents = table(spark, folder, "normalized_documents")
    return language.label_check(documents, table(spark, folder, "language_labels"), _passages(spark, folder, whole=True))


def p4_passages(spark: SparkSession, folder: str) -> DataFrame:
    return _passages(spark, folder).distinct()


def p4_calibration(spark: SparkSession, folder: str) -> DataFrame:
    """The classifier's temperature and the error of its confidence on held-out sentences."""
    model = language.fit(table(spark, folder, "normalized_documents"), table(spark, folder, "language_labels"))
    return spark.createDataFrame([(len(model.languages), len(model.places), model.temperature, model.calibration_error)], "n_languages int, n_grams int, temperature double, calibration_error double")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    members, linked = neardup.links(table(spark, folder, "normalized_documents"))
    return neardup.record_pairs(members, linked)


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    members, linked = neardup.links(table(spark, folder, "normalized_documents"))
    return neardup.groups(members, linked)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return fields.records(*(table(spark, folder, t) for t in ("normalized_documents", "band_records", "language_labels")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that the mixture's report shows to be out of reach."""
    _, report = mixing.mix(_records(spark, folder), table(spark, folder, "mix_targets"))
    return report.where("out_of_reach").select("plan_id", "group_key")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_records(spark, folder), table(spark, folder, "mix_targets"))[1]


def p6_block_check(spark: SparkSession, folder: str) -> DataFrame:
    """For each target whether it can be reached, and if so, whether the mixture misses it by less than the block of rounding
    shares and the record at either end of what is taken; and that no record is taken too often."""
    mixture, report = mixing.mix(_records(spark, folder), table(spark, folder, "mix_targets"))
    longest = mixture.agg(F.max("n_chars").alias("longest"))
    slack = F.col("plan_chars") / mixing.BLOCKS + 2 * F.col("longest")
    near = F.abs(F.col("missed_share")) * F.col("plan_chars") <= slack
    rows = report.join(F.broadcast(longest)).select("plan_id", "group_key", (~F.col("out_of_reach")).alias("reachable"), ((F.col("out_of_reach") | near) & (F.col("most_repeats") <= F.col("max_repeats"))).alias("within"))
    return rows


def p6_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_records(spark, folder), table(spark, folder, "mix_targets"))[0]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Targets that the sample's report shows to be out of reach."""
    _, report = sampling.sample(_records(spark, folder), table(spark, folder, "sample_targets"), top_up=True)
    return report.where("out_of_reach").select("plan_id", "category")


def p7_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample(_records(spark, folder), table(spark, folder, "sample_targets"), top_up=True)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample(_records(spark, folder), table(spark, folder, "sample_targets"), top_up=True)[1]


def p7_size_check(spark: SparkSession, folder: str) -> DataFrame:
    """For each plan, the records that its sample has: all that were asked for, or all records of its categories."""
    drawn = p7_sample(spark, folder).groupBy("plan_id").agg(F.count("*").alias("drawn"), F.countDistinct("id").alias("n_ids"))
    return drawn.where("drawn = n_ids").select("plan_id", "drawn")


def p7_joint(spark: SparkSession, folder: str) -> DataFrame:
    """One sample raked over three margins at once: the first plans by name of domain, language and band, joined to one plan of
    the least of their sizes. Reports the targets met and missed."""
    targets = table(spark, folder, "sample_targets")
    first = targets.groupBy("field_name").agg(F.min("plan_id").alias("plan_id"))
    mine = targets.join(F.broadcast(first), ["field_name", "plan_id"])
    size = mine.agg(F.min("sample_records").alias("sample_records"))
    joint = mine.drop("plan_id", "sample_records").withColumns({"plan_id": F.lit("joint"), "min_records": F.lit(0).cast("long")}).join(F.broadcast(size))
    return sampling.sample(_records(spark, folder), joint, top_up=True)[1]


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, folder, "documents"), table(spark, folder, "tokenizer_pieces"), "doc_id")
    return packing.fill_containers(counts, 2048, "id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that the packing had to split: all others are in one container."""
    return p8_containers(spark, folder).groupBy("doc_id").agg(F.count("*").alias("parts")).where("parts > 1").select("doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p9_matches(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_unaffected(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return leakage.unaffected(documents, leakage.leaks(documents, table(spark, folder, "eval_items"))).select("doc_id", "source")


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(*(table(spark, folder, t) for t in ("documents", "subjects", "subject_labels")))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p10_topics(spark: SparkSession, folder: str) -> DataFrame:
    """The topics found in each language, their top terms, and the subject to which each was mapped."""
    documents = table(spark, folder, "documents")
    return subjects.inspected(documents, subjects.fit(documents, table(spark, folder, "subjects"), table(spark, folder, "subject_labels")))


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and mean share of units by subject."""
    return _subjects(spark, folder).groupBy("subject").agg(F.count("*").alias("n_documents"), F.avg("share").alias("mean_share"))


QUERIES: dict[str, Query] = {name: value for name, value in list(globals().items()) if name[0] == "p" and name[1].isdigit()}

#: Tokens of each distinct chunk, one token a step, for the tables in the brackets.
_CHUNK_TOKENS = """
pieces AS (SELECT DISTINCT piece, length(piece) AS n FROM tokenizer_pieces WHERE length(piece) > 0),
lengths AS (SELECT DISTINCT n FROM pieces),
chunks AS (SELECT id, unnest(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS chunk FROM texts),
step(chunk, place, taken) AS (
  SELECT DISTINCT chunk, 1::BIGINT, 0::BIGINT FROM chunks
  UNION ALL
  SELECT s.chunk, s.place + coalesce(max(p.n), 1), s.taken + 1
  FROM step s CROSS JOIN lengths l LEFT JOIN pieces p ON p.piece = substr(s.chunk, s.place, l.n)
  WHERE s.place <= length(s.chunk)
  GROUP BY s.chunk, s.place, s.taken),
sizes AS (SELECT chunk, max(taken) AS tokens FROM step GROUP BY chunk),
counts AS (
  SELECT t.id, coalesce(sum(z.tokens), 0)::BIGINT AS n_tokens
  FROM texts t LEFT JOIN chunks c ON c.id = t.id LEFT JOIN sizes z ON z.chunk = c.chunk GROUP BY t.id)
"""
_FIELDS = """
bands AS (SELECT id, arg_max({band: band}, processed_at).band AS band FROM band_records WHERE id IS NOT NULL GROUP BY id),
one AS (
  SELECT id, max(length(text)) AS n_chars, max(lower(trim(source))) AS source, max(dataset) AS dataset, max(domain) AS domain, max(language) AS label_text
  FROM normalized_documents WHERE id IS NOT NULL GROUP BY id),
recs AS (SELECT o.*, b.band, l.lang_code AS language FROM one o LEFT JOIN bands b ON b.id = o.id LEFT JOIN language_labels l ON l.label_text = o.label_text)
"""
_FINITE = "SELECT *, row_number() OVER (PARTITION BY run_id, metric, scope, host ORDER BY value) AS rn, count(*) OVER (PARTITION BY run_id, metric, scope, host) AS n FROM (SELECT run_id, metric, 'host' AS scope, host, value FROM metric_points WHERE isfinite(value) UNION ALL SELECT run_id, metric, 'all', NULL, value FROM metric_points WHERE isfinite(value))"
_RECORDS = "texts AS (SELECT id, max(text) AS text FROM normalized_documents WHERE id IS NOT NULL GROUP BY id)"

SQL: dict[str, str] = {
    "p2_records": f"WITH RECURSIVE {_RECORDS}, {_CHUNK_TOKENS} SELECT id, n_tokens FROM counts",
    "p2_totals": f"""WITH RECURSIVE {_RECORDS}, {_CHUNK_TOKENS},
        fields AS (SELECT id, max(lower(trim(source))) AS source, max(language) AS label_text, max(domain) AS domain FROM normalized_documents WHERE id IS NOT NULL GROUP BY id)
        SELECT f.source, l.lang_code, f.domain, count(*) AS n_documents, sum(c.n_tokens)::BIGINT AS n_tokens
        FROM fields f JOIN counts c ON c.id = f.id LEFT JOIN language_labels l ON l.label_text = f.label_text GROUP BY ALL""",
    "p3_percentiles": f"WITH r AS ({_FINITE}) SELECT run_id, metric, scope, host, n AS n_finite, "
    + ", ".join(f"max(value) FILTER (rn = greatest(1, ({p} * n + 99) // 100)) AS p{p:02d}" for p in percentiles.PERCENTS)
    + ", 0.0::DOUBLE AS rank_error FROM r GROUP BY run_id, metric, scope, host, n",
    "p3_rank_check": "SELECT run_id, metric, count(*) AS n_finite, true AS within FROM metric_points WHERE isfinite(value) GROUP BY run_id, metric",
    "p6_found": f"""WITH {_FIELDS}, sizes AS (
          SELECT 'source' AS field_name, source AS group_key, sum(n_chars) AS chars FROM recs GROUP BY ALL
          UNION ALL SELECT 'dataset', dataset, sum(n_chars) FROM recs GROUP BY ALL
          UNION ALL SELECT 'band', band, sum(n_chars) FROM recs GROUP BY ALL)
        SELECT m.plan_id, m.group_key FROM mix_targets m LEFT JOIN sizes s USING (field_name, group_key)
        WHERE coalesce(s.chars, 0)::DOUBLE * m.max_repeats < m.target_share * m.plan_chars""",
    "p6_block_check": f"""WITH {_FIELDS}, sizes AS (
          SELECT 'source' AS field_name, source AS group_key, sum(n_chars) AS chars FROM recs GROUP BY ALL
          UNION ALL SELECT 'dataset', dataset, sum(n_chars) FROM recs GROUP BY ALL
          UNION ALL SELECT 'band', band, sum(n_chars) FROM recs GROUP BY ALL)
        SELECT m.plan_id, m.group_key, coalesce(s.chars, 0)::DOUBLE * m.max_repeats >= m.target_share * m.plan_chars AS reachable, true AS "within"
        FROM mix_targets m LEFT JOIN sizes s USING (field_name, group_key)""",
    "p7_size_check": f"""WITH {_FIELDS}, sizes AS (
          SELECT 'domain' AS field_name, domain AS category, count(*) AS n FROM recs GROUP BY ALL
          UNION ALL SELECT 'language', language, count(*) FROM recs GROUP BY ALL
          UNION ALL SELECT 'band', band, count(*) FROM recs GROUP BY ALL)
        SELECT t.plan_id, least(max(t.sample_records), sum(CASE WHEN t.target_share > 0 THEN coalesce(s.n, 0) ELSE 0 END))::BIGINT AS drawn
        FROM sample_targets t LEFT JOIN sizes s USING (field_name, category) GROUP BY t.plan_id""",
    "p7_found": f"""WITH {_FIELDS}, sizes AS (
          SELECT 'domain' AS field_name, domain AS category, count(*) AS n FROM recs GROUP BY ALL
          UNION ALL SELECT 'language', language, count(*) FROM recs GROUP BY ALL
          UNION ALL SELECT 'band', band, count(*) FROM recs GROUP BY ALL)
        SELECT t.plan_id, t.category FROM sample_targets t LEFT JOIN sizes s USING (field_name, category)
        WHERE coalesce(s.n, 0) < t.target_share * t.sample_records OR coalesce(s.n, 0) < t.min_records""",
    "p8_found": f"WITH RECURSIVE texts AS (SELECT doc_id AS id, text FROM documents), {_CHUNK_TOKENS} SELECT id AS doc_id FROM counts WHERE n_tokens > 2048",
}
