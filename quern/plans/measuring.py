"""Measures of the documents, and the document schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrow
from quern.functions import measures as m
from quern.plans.registry import SQL, query, table

_T = "coalesce(text, '')"
_W = f"regexp_extract_all(lower({_T}), '[\\p{{L}}\\p{{N}}_'']+')"
_D = f"d AS (SELECT doc_id, {_T} AS t, {_W} AS w FROM documents)"


def documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "lang", "source", "text")


def measured(spark, folder, *names):
    return m.measured(documents(spark, folder), list(names))


@query("met01_length", f"WITH {_D} SELECT doc_id, len(w) AS n_words, round(CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE ELSE 0.0 END, 6) AS mean_word_length FROM d")
def length(spark, folder):
    return measured(spark, folder, "length").select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"))


@query("met02_rare_words", f"WITH {_D}, x AS (SELECT doc_id, unnest(w) AS word FROM d), c AS (SELECT doc_id, word, count(*) AS n FROM x GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS n_words, count(*) FILTER (n = 1) AS n_rare, round(sum(n * log2(n)), 4) AS n_log_n FROM c GROUP BY doc_id")
def rare_words(spark, folder):
    """Words by document, those that occur once, and the sum from which their entropy follows; counted within each document."""
    d = documents(spark, folder).select("doc_id", m.words(F.coalesce("text", F.lit(""))).alias("w")).where(F.size("w") > 0)
    once, spread = m.sum_over_counts(F.col("w"), lambda n: F.when(n == 1, 1).otherwise(0)), m.sum_over_counts(F.col("w"), lambda n: n * F.log2(n))
    return d.select("doc_id", F.size("w").cast("long").alias("n_words"), once.cast("long").alias("n_rare"), F.round(spread, 4).alias("n_log_n"))


@query("met03_character_entropy", f"WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(substr({_T}, 1, {m.ENTROPY_HEAD}), '')) AS ch FROM documents) GROUP BY ALL) SELECT doc_id, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 4) AS entropy FROM c WHERE ch <> '' GROUP BY doc_id")
def character_entropy(spark, folder):
    """Natural-log entropy of the first characters (the measure's sampled length)."""
    return _character_entropy(spark, folder, F.substring(F.coalesce("text", F.lit("")), 1, m.ENTROPY_HEAD))


@query("met03_whole", SQL["met03_character_entropy"].replace(f"substr({_T}, 1, {m.ENTROPY_HEAD})", _T))
def character_entropy_whole(spark, folder):
    """Natural-log entropy of all characters."""
    return _character_entropy(spark, folder, F.coalesce("text", F.lit("")))


def _character_entropy(spark, folder, text):
    c = documents(spark, folder).select("doc_id", F.filter(F.split(text, ""), lambda x: x != "").alias("c")).where(F.size("c") > 0)
    return c.select("doc_id", F.round(F.log(F.size("c")) - m.sum_over_counts(F.col("c"), lambda n: n * F.log(n)) / F.size("c"), 4).alias("entropy"))


@query("met04_readability", f"""WITH {_D}, s AS (SELECT doc_id, greatest(len(w), 1) AS n, greatest(len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s) <> '')), 1) AS n_sentences,
  coalesce(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(x, '[aeiouy]+')), 1))), 0)::BIGINT AS n_syllables FROM d)
  SELECT doc_id, n_sentences, n_syllables, 0.39::DOUBLE * n / n_sentences + 11.8::DOUBLE * n_syllables / n - 15.59::DOUBLE AS grade FROM s""")
def readability(spark, folder):
    return measured(spark, folder, "readability").select("doc_id", "n_sentences", "n_syllables", "grade")


@query("met05_densities", f"WITH {_D} SELECT doc_id, round(len(regexp_extract_all(t, '[{{}}\\[\\]()<>:;=]')) / greatest(length(t), 1)::DOUBLE, 6) AS structural_density, round(len(regexp_extract_all(t, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s]')) / greatest(length(t), 1)::DOUBLE, 6) AS symbolic_density FROM d")
def densities(spark, folder):
    return measured(spark, folder, "densities").select("doc_id", F.round("structural_density", 6).alias("structural_density"), F.round("symbolic_density", 6).alias("symbolic_density"))


@query("met06_modality", f"""WITH {_D} SELECT CASE WHEN regexp_matches(t, '(?m)^\\s*(?:def |class |func |import |return |#include)') THEN 'code' WHEN regexp_matches(t, '\\$[^$\\n]+\\$|\\\\(?:frac|sum|int)') THEN 'math'
  WHEN regexp_matches(t, '(?m)^\\[(?:USER|ASSISTANT)\\]') THEN 'dialogue' WHEN regexp_matches(t, '(?m)^\\|.*\\|$') THEN 'table' ELSE 'prose' END AS modality, count(*) AS n_documents FROM d GROUP BY 1""")
def modality(spark, folder):
    return measured(spark, folder, "modality").groupBy("modality").agg(F.count("*").alias("n_documents"))


@query("met09_rejection", f"WITH {_D} SELECT doc_id, CASE WHEN len(w) < 10 THEN 'few_words' WHEN len(list_distinct(w)) < 0.1 * len(w) THEN 'repetitive' WHEN length(t) > 20000 THEN 'long' END AS rejected_by FROM d")
def rejection(spark, folder):
    d = measured(spark, folder, "length", "repetition")
    rules = [("few_words", F.col("n_words") < 10), ("repetitive", F.col("unique_ratio") < 0.1), ("long", F.length(F.coalesce("text", F.lit(""))) > 20000)]
    return m.first_rejection(d, rules).select("doc_id", "rejected_by")


@query("met10_scripts", f"SELECT doc_id, regexp_matches(substr({_T}, 1, {m.SCRIPT_HEAD}), '[ऀ-ൿ]') AS is_indic FROM documents")
def indic(spark, folder):
    return documents(spark, folder).select("doc_id", m.script(F.coalesce("text", F.lit("")), m.SCRIPT_HEAD)["is_indic"].alias("is_indic"))


@query("met10_whole", SQL["met10_scripts"].replace(f"substr({_T}, 1, {m.SCRIPT_HEAD})", _T))
def indic_whole(spark, folder):
    """Whether a script of India shows anywhere in the text."""
    return measured(spark, folder, "script").select("doc_id", "is_indic")


@query("met13_layout", f"""WITH {_D} SELECT doc_id, len(list_filter(regexp_split_to_array(t, '\\n\\s*\\n'), lambda p: trim(p) <> '')) AS n_paragraphs, len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^\\s*[-*•] '))) AS n_bullets,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '^#{{1,6}} '))) AS n_headings, len(regexp_extract_all(t, '\\[\\d{{1,3}}\\]')) AS n_citations FROM d""")
def layout(spark, folder):
    return measured(spark, folder, "layout").select("doc_id", "n_paragraphs", "n_bullets", "n_headings", "n_citations")


@query("met16_compression")
def compression(spark, folder):
    return documents(spark, folder).select("doc_id", F.round(arrow.compression("text"), 6).alias("ratio"))


@query("met19_bigram_entropy", f"""WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length({_T})), lambda i: substr({_T}, i, 2))) AS g FROM documents), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL)
  SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) AS entropy FROM c GROUP BY doc_id""")
def bigram_entropy(spark, folder):
    """Entropy of pairs of neighbouring characters; an array of characters is cut once, so pairs cost no substring search."""
    d = documents(spark, folder).select("doc_id", F.split(F.coalesce("text", F.lit("")), "").alias("c")).select("doc_id", F.filter("c", lambda x: x != "").alias("c")).where(F.size("c") > 1)
    pairs = F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.concat(a, b))
    d = d.select("doc_id", pairs.alias("g"))
    return d.select("doc_id", F.round(F.log2(F.size("g")) - m.sum_over_counts(F.col("g"), lambda n: n * F.log2(n)) / F.size("g"), 4).alias("entropy"))


@query("met20_code_density", f"WITH {_D} SELECT doc_id, round(len(regexp_extract_all(t, '(?m)^\\s*(?:def |class |func |return |import )')) / len(string_split(t, chr(10)))::DOUBLE, 6) AS code_density FROM d")
def code_density(spark, folder):
    text = F.coalesce("text", F.lit(""))
    return documents(spark, folder).select("doc_id", F.round(F.regexp_count(text, F.lit(r"(?m)^\s*(?:def |class |func |return |import )")) / F.size(F.split(text, "\n")), 6).alias("code_density"))


@query("met24_uuids", "SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][('0x' || h[17])::INT % 4 + 1] || h[18:20] || '-' || h[21:32] AS uuid FROM (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '#' || source)) AS h FROM documents WHERE source IS NOT NULL)")
def uuids(spark, folder):
    return documents(spark, folder).where("source IS NOT NULL").select("doc_id", m.record_uuid(F.col("doc_id").cast("string"), F.col("source")).alias("uuid"))


@query("nrm01_document_schema", "SELECT doc_id::VARCHAR AS id, sha256(coalesce(text, '')) AS hash, 'corpus' AS dataset, coalesce(domain, 'general') AS domain, source, lang AS language, created, '1.0' AS version FROM documents")
def document_schema(spark, folder):
    """Rows in the document schema; the text isn't needed for the check."""
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.lit("corpus").alias("dataset"), F.coalesce("domain", F.lit("general")).alias("domain"), "source", F.col("lang").alias("language"), "created", F.lit("1.0").alias("version"))


@query("nrm02_language_codes", "SELECT l.lang_code, count(*) AS n FROM normalized_documents d LEFT JOIN language_labels l ON l.label_text = d.language GROUP BY l.lang_code")
def language_codes(spark, folder):
    labels = table(spark, folder, "language_labels")
    return table(spark, folder, "normalized_documents").select(F.col("language").alias("label_text")).join(F.broadcast(labels), "label_text", "left").groupBy("lang_code").agg(F.count("*").alias("n"))


@query("nrm03_conversations", "SELECT doc_id, len(regexp_extract_all(text, '\\[(?:USER|ASSISTANT)\\]')) AS n_turns, md5(regexp_replace(regexp_replace(text, '\\[USER\\]', '<USER>', 'g'), '\\[ASSISTANT\\]', '<ASSISTANT>', 'g')) AS digest FROM documents WHERE contains(text, '[USER]')")
def conversations(spark, folder):
    """Turns of dialogues put in another markup."""
    marked = F.replace(F.replace("text", F.lit("[USER]"), F.lit("<USER>")), F.lit("[ASSISTANT]"), F.lit("<ASSISTANT>"))
    d = documents(spark, folder).where(F.contains("text", F.lit("[USER]")))
    return d.select("doc_id", F.regexp_count("text", F.lit(r"\[(?:USER|ASSISTANT)\]")).alias("n_turns"), F.md5(marked).alias("digest"))


@query("nrm04_sections", "SELECT doc_id, regexp_extract(text, '### Topic: ([^\\n]*)', 1) AS topic, contains(text, '### Answer:') AS has_answer FROM documents WHERE starts_with(text, '### Topic:')")
def sections(spark, folder):
    return documents(spark, folder).where(F.startswith("text", F.lit("### Topic:"))).select("doc_id", F.regexp_extract("text", r"### Topic: ([^\n]*)", 1).alias("topic"), F.contains("text", F.lit("### Answer:")).alias("has_answer"))


@query("nrm05_metadata", "SELECT id, n_keys FROM (SELECT id, len(json_keys(CASE WHEN json_valid(metadata) THEN metadata END)) AS n_keys FROM normalized_documents) WHERE n_keys IS NOT NULL")
def metadata(spark, folder):
    """Keys of whole metadata; metadata cut off is no JSON and has none."""
    keys = F.size(F.json_object_keys("metadata"))
    return table(spark, folder, "normalized_documents").select("id", keys.alias("n_keys")).where(F.expr("try_parse_json(metadata) IS NOT NULL") & F.col("n_keys").isNotNull())


@query("nrm07_sequential_ids", "SELECT doc_id, 'doc_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id FROM documents")
def sequential_ids(spark, folder):
    """Numbers by a real key, from counts of ranges: no task sorts all rows."""
    from quern.operators.budgets import with_total_before

    rows = documents(spark, folder).select("doc_id").withColumns({"one": F.lit(1).cast("long"), "all": F.lit(0)})
    return with_total_before(rows, ["all"], "doc_id", "doc_id", "one", descending=False).select("doc_id", F.concat(F.lit("doc_"), F.col("before")).alias("id"))


@query("nrm11_indic_lines", "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[ऀ-ൿ]')), chr(10))) AS digest FROM documents WHERE regexp_matches(text, '[ऀ-ൿ]')")
def indic_lines(spark, folder):
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[ऀ-ൿ]"))
    return documents(spark, folder).where(F.col("text").rlike("[ऀ-ൿ]")).select("doc_id", F.md5(F.array_join(lines, "\n")).alias("digest"))
