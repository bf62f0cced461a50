"""Cleaning of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrow
from quern.functions import cleaning as c
from quern.plans.registry import SQL, query, table

_Q = str.maketrans({"'": "''"})
#: RE2 knows \x{..} but neither \x0B-style classes nor \z apart from its own; the same patterns in its syntax.
_RE2_STRIPPED = c.STRIPPED
_TEXT = "coalesce(text, '')"


def _re(pattern: str) -> str:
    return "'" + pattern.translate(_Q) + "'"


def _replace(value: str, pattern: str, by: str = "''") -> str:
    return f"regexp_replace({value}, {_re(pattern)}, {by}, 'g')"


def _strip(value: str) -> str:
    return f"trim({value}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


def _white(value: str) -> str:
    value = _replace(value, r"\r\n?", "chr(10)")
    value = _replace(value, r"[ \t\f\x0B]+", "' '")
    return _strip(_replace(value, r"\n{3,}", "chr(10) || chr(10)"))


def _text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))


_MINIFIED = f"length(t) > {c.LONG_LINE} AND (breaks = 0 OR (longest > {c.LONG_LINE} AND breaks / length(t)::DOUBLE < {c.LEAST_BREAKS}))"
_DROP = f"""d AS (SELECT doc_id, lang, {_TEXT} AS t, length({_TEXT}) - length(replace({_TEXT}, chr(10), '')) AS breaks,
  list_max(list_transform(string_split({_TEXT}, chr(10)), lambda x: length(x))) AS longest FROM documents),
reasons AS (SELECT doc_id, lang, t, CASE WHEN {_MINIFIED} THEN 'minified' WHEN len(regexp_extract_all(substr(t, 1, {c.HEAD}), {_re(c.LOCK_MARKS)})) >= {c.LOCK_HITS} THEN 'lockfile'
  WHEN regexp_matches(substr(t, 1, {c.MARK_HEAD}), {_re(c.GENERATED_LINE)}) THEN 'autogenerated' ELSE '' END AS reason FROM d)"""


@query("cln01_drop_reasons", f"WITH {_DROP} SELECT reason, lang, count(*) AS n_documents, sum(length(t))::BIGINT AS n_chars FROM reasons GROUP BY reason, lang")
def drop_reasons(spark, folder):
    """Steps 1 to 3: minified, lock and generated files."""
    return _text(spark, folder).withColumn("reason", c.drop_reason(F.col("text"))).groupBy("reason", "lang").agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))


@query("cln04_composed", "SELECT doc_id, md5(nfc_normalize(coalesce(text, ''))) AS digest FROM documents")
def composed(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(arrow.composed("text")).alias("digest"))


@query("cln05_unescaped")
def unescaped(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(arrow.unescaped("text")).alias("digest"), (F.length("text") - F.length(arrow.unescaped("text"))).alias("n_removed"))


@query("cln06_plain_spaces", f"SELECT doc_id, md5(replace({_TEXT}, chr(160), ' ')) AS digest FROM documents")
def plain_spaces(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(c.plain_spaces(F.col("text"))).alias("digest"))


def _removed(value: str, pattern: str) -> str:
    return f"length({value}) - length({_replace(value, pattern)})"


@query("cln07_controls", f"SELECT doc_id, md5({_replace(_TEXT, c.STRIPPED)}) AS digest, {_removed(_TEXT, c.CONTROLS)} AS n_controls, {_removed(_TEXT, c.INVISIBLE)} AS n_invisible, {_removed(_TEXT, c.PRIVATE)} AS n_private FROM documents")
def controls(spark, folder):
    t = F.col("text")
    removed = {n: F.length(t) - F.length(F.regexp_replace(t, p, "")) for n, p in (("n_controls", c.CONTROLS), ("n_invisible", c.INVISIBLE), ("n_private", c.PRIVATE))}
    return _text(spark, folder).select("doc_id", F.md5(c.without_controls(t)).alias("digest"), *(v.alias(n) for n, v in removed.items()))


@query("cln08_ghost_tags", f"SELECT doc_id, md5({_replace(_TEXT, c.GHOST_TAGS, repr(' '))}) AS digest FROM documents")
def ghost_tags(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(c.without_ghost_tags(F.col("text"))).alias("digest"))


@query("cln09_license", f"SELECT doc_id, regexp_matches({_TEXT}, {_re(c.LICENSE)}) AS was_stripped, md5(CASE WHEN regexp_matches({_TEXT}, {_re(c.LICENSE)}) THEN regexp_replace({_TEXT}, {_re(c.LEADING_COMMENTS)}, '') ELSE {_TEXT} END) AS digest FROM documents")
def license_header(spark, folder):
    t = F.col("text")
    return _text(spark, folder).select("doc_id", t.rlike(c.LICENSE).alias("was_stripped"), F.md5(c.without_license(t)).alias("digest"))


@query("cln10_warnings", f"SELECT doc_id, md5({_replace(_TEXT, c.WARNING_LINE)}) AS digest FROM documents")
def warnings(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(c.without_warnings(F.col("text"))).alias("digest"))


@query("cln11_whitespace", f"SELECT doc_id, md5({_white(_TEXT)}) AS digest FROM documents")
def white(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(c.whitespace(F.col("text"))).alias("digest"))


@query("cln12_references", f"SELECT doc_id, md5(rtrim(regexp_split_to_array({_TEXT}, {_re(c.REFERENCES)})[1], ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS digest FROM documents")
def references(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(c.without_references(F.col("text"))).alias("digest"))


_UNCITED = _replace(_TEXT, c.CITATION)


@query("cln13_citations", f"SELECT doc_id, md5(CASE WHEN {_UNCITED} = {_TEXT} THEN {_TEXT} ELSE {_strip(_replace(_UNCITED, '[ ' + chr(92) + 't]+', repr(' ')))} END) AS digest FROM documents")
def citations(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(c.without_citations(F.col("text"))).alias("digest"))


@query("cln14_mojibake", f"SELECT doc_id, round(CASE WHEN length({_TEXT}) > 0 THEN ({_removed(_TEXT, c.MOJIBAKE)}) / length({_TEXT})::DOUBLE ELSE 0.0 END, 6) AS mojibake_ratio FROM documents")
def mojibake(spark, folder):
    return _text(spark, folder).select("doc_id", F.round(c.mojibake_ratio(F.col("text")), 6).alias("mojibake_ratio"))


@query("cln15_statistics", f"""WITH {_DROP}, f AS (SELECT reason, {_removed("t", c.STRIPPED)} AS stripped, {_replace("t", c.GHOST_TAGS, "' '")} <> t AS tagged, {_replace("t", c.CITATION)} <> t AS cited FROM reasons)
  SELECT count(*) AS n_documents, count(*) FILTER (reason <> '') AS n_dropped, sum(stripped)::BIGINT AS n_stripped, count(*) FILTER (tagged) AS n_tagged, count(*) FILTER (cited) AS n_cited FROM f""")
def statistics(spark, folder):
    """Counters of the cleaning steps; partial sums merge, so one aggregation serves any number of partitions."""
    t = F.col("text")
    flags = _text(spark, folder).select(c.drop_reason(t).alias("reason"), (F.length(t) - F.length(c.without_controls(t))).alias("stripped"), (c.without_ghost_tags(t) != t).alias("tagged"), (F.regexp_replace(t, c.CITATION, "") != t).alias("cited"))
    return flags.agg(F.count("*").alias("n_documents"), F.count_if(F.col("reason") != "").alias("n_dropped"), F.sum("stripped").alias("n_stripped"), F.count_if("tagged").alias("n_tagged"), F.count_if("cited").alias("n_cited"))


_HEAD = f"substr({_TEXT}, 1, {c.MARK_HEAD})"


@query("cln16_valid", f"""SELECT lang, count(*) FILTER (length({_TEXT}) >= 20 AND ({_removed(_HEAD, "[" + chr(92) + "p{L}" + chr(92) + "p{N}]")}) / length({_HEAD})::DOUBLE >= 0.35
  AND len(list_distinct(list_filter(regexp_split_to_array({_TEXT}, '{chr(92)}s+'), lambda w: w <> ''))) >= 5) AS n_valid, count(*) AS n_documents FROM documents GROUP BY lang""")
def valid(spark, folder):
    return _text(spark, folder).groupBy("lang").agg(F.count_if(c.is_valid(F.col("text"), head_length=c.MARK_HEAD)).alias("n_valid"), F.count("*").alias("n_documents"))


@query("cln16_whole", SQL["cln16_valid"].replace(_HEAD, _TEXT))
def valid_whole(spark, folder):
    """cln16 with the share of letters of the whole text, as in cln_full."""
    return _text(spark, folder).groupBy("lang").agg(F.count_if(c.is_valid(F.col("text"))).alias("n_valid"), F.count("*").alias("n_documents"))


@query("cln17_latex")
def latex(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(c.without_latex(F.col("text"))).alias("digest"))


@query("cln18_normal", f"SELECT doc_id, md5(trim({_replace(f'lower({_TEXT})', chr(92) + 's+', repr(' '))})) AS digest FROM documents")
def normal(spark, folder):
    return _text(spark, folder).select("doc_id", F.md5(c.normal(F.col("text"))).alias("digest"))


@query("cln_full")
def full(spark, folder):
    """All steps: documents kept with the length of the cleaned text."""
    t = F.col("text")
    kept = _text(spark, folder).where(c.drop_reason(t) == "").select("doc_id", "lang", c.clean(arrow.unescaped(arrow.composed(t))).alias("text"))
    return kept.where((c.mojibake_ratio(t) <= 0.02) & c.is_valid(t)).select("doc_id", "lang", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))
