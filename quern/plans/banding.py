"""Signals and bands of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import signals as s
from quern.plans.registry import SQL, query, table

INDIC = ("bharat_",)


def _hits(column: str, words: tuple[str, ...]) -> str:
    quoted = [w.replace("'", "''") for w in words]
    return "(" + " + ".join(f"contains({column}, '{w}')::INT" for w in quoted) + ")"


def _count(column: str, characters: str) -> str:
    return f"(length({column}) - length(translate({column}, '{characters}', '')))"


def _ratio(part: str, whole: str, otherwise: str = "0.0") -> str:
    return f"CASE WHEN {whole} > 0 THEN ({part})::DOUBLE / {whole} ELSE {otherwise} END"


def _case(rows: tuple, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rows) + f" ELSE {otherwise} END"


_SPACE = "' ' || chr(9) || chr(10) || chr(13)"
BASIC = f"""
b0 AS (SELECT doc_id, coalesce(source, '') AS source, lang, coalesce(text, '') AS text FROM documents),
b1 AS (SELECT *, length(text) AS char_length, octet_length(encode(text)) AS byte_length,
  greatest(len(regexp_split_to_array(text, '\\s+')) - 1, 1) AS word_count, greatest(len(string_split(text, chr(10))) - 1, 1) AS line_count FROM b0),
basic AS (SELECT *, trunc(word_count * CASE WHEN source LIKE 'bharat_%' THEN {s.INDIC_TOKENS_A_WORD}::DOUBLE ELSE {s.TOKENS_A_WORD}::DOUBLE END)::INT AS token_count_estimate FROM b1)
"""
NOISE = f"""
noise AS (SELECT *, {_ratio(f"length(text) - length(translate(text, {_SPACE}, ''))", "char_length")} AS whitespace_ratio,
  len(regexp_extract_all(text, 'https?://')) AS url_count, {_ratio("len(regexp_extract_all(text, 'https?://'))", "word_count")} AS url_ratio,
  {_hits("lower(text)", s.BOILERPLATE)} / {len(s.BOILERPLATE)}::DOUBLE AS boilerplate_ratio, {_hits("text", s.THREAD_MARKS)} AS thread_marker_count FROM basic)
"""
_SAMPLE = "CASE WHEN char_length < 1000 THEN text WHEN char_length < 10000 THEN substr(text, 1, 5000) WHEN char_length < 50000 THEN substr(text, 1, 15000) ELSE substr(text, 1, 25000) END"
SAMPLED = f"""
s0 AS (SELECT *, {_SAMPLE} AS t FROM noise),
s1 AS (SELECT *, lower(t) AS low, regexp_split_to_array(t, '\\s+') AS words FROM s0),
sampled AS (SELECT *, {_ratio(_count("t", s.PUNCTUATION), "length(t)")} AS punct_ratio, {_ratio(_count("t", s.DIGITS), "length(t)")} AS digit_ratio,
  {_ratio(_count("t", s.SPECIAL), "length(t)")} AS special_ratio, {_ratio("length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))", "length(t)")} AS upper_ratio,
  {_ratio("len(list_distinct(words))", "word_count")} AS unique_token_ratio, {_ratio("length(array_to_string(words, ''))", "word_count")} AS avg_word_length,
  {_ratio("byte_length", "char_length")} AS compression_ratio,
  {_hits("low", s.CODE_WORDS)} AS code_hits, {_hits("low", s.MATH_WORDS)} AS math_hits, {_hits("low", s.REASONING_WORDS)} AS reasoning_hits,
  {_hits("low", s.AGENT_WORDS)} AS agent_hits, {_hits("low", s.THOUGHT_WORDS)} AS thought_hits FROM s1)
"""
SCORES = """
c0 AS (SELECT *, trunc(special_ratio * 30 + digit_ratio * 20 + code_hits * 5 + CASE WHEN avg_word_length > 8 THEN 5 ELSE 0 END)::INT AS code_score,
  trunc(math_hits * 6 + digit_ratio * 15 + special_ratio * 8)::INT AS math_score, trunc(reasoning_hits * 6 + upper_ratio * 8)::INT AS reasoning_score,
  agent_hits * 6 AS agentic_score, thought_hits * 5 + reasoning_hits * 2 AS cot_score FROM sampled),
scores AS (SELECT *, code_score >= 10 AS has_code, math_score >= 8 AS has_math, reasoning_score >= 6 AS has_reasoning, agentic_score >= 8 AS has_agentic, cot_score >= 10 AS has_cot,
  least(unique_token_ratio * 2.5::DOUBLE, 1.0) * 0.25::DOUBLE + least((avg_word_length - 4) / 6, 1.0) * 0.25::DOUBLE + least(punct_ratio * 3, 1.0) * 0.2::DOUBLE
  + least((code_score + math_score + reasoning_score) / 60::DOUBLE, 1.0) * 0.3::DOUBLE AS difficulty_score FROM c0)
"""


def _weight(b: str) -> str:
    own = tuple((c, f"{w}::DOUBLE") for name, c, w in s.NUDGES if name == b)
    base = f"greatest(0.0, 1.0 - abs(difficulty_score - {s.CENTERS[b]}::DOUBLE) / {s.BAND_WIDTH}::DOUBLE)"
    return f"{base} + {_case(own, '0.0')}" if own else base


_TOTAL = "(" + " + ".join(f"w_{b}" for b in s.BANDS) + ")"
BANDED = f"""
n0 AS (SELECT *, {", ".join(f"{_weight(b)} AS w_{b}" for b in s.BANDS)} FROM scores),
n1 AS (SELECT *, {", ".join(f"w_{b} / CASE WHEN {_TOTAL} > 0 THEN {_TOTAL} ELSE 1.0 END AS band_p_{b}" for b in s.BANDS)} FROM n0),
banded AS (SELECT *, {_case(tuple((f"band_p_{b} >= {s.LEAST_PROBABILITY}::DOUBLE", f"'{b}'") for b in s.BANDS[:-1]), "'B5'")} AS band,
  {_case(tuple((c, f"'{n}'") for n, _, c in s.REJECTIONS), "''")} AS rejection_reason, {_case(tuple((c, str(k)) for _, k, c in s.REJECTIONS), "NULL")} AS rejection_level FROM n1)
"""
ALL = f"WITH {BASIC}, {NOISE}, {SAMPLED}, {SCORES}, {BANDED} "
#: The same with the signals of whole texts.
WHOLE = ALL.replace(_SAMPLE, "text")


def rounded(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def _sql(names: tuple[str, ...], rest: str = "") -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names) + rest


def documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", "lang", "text")


def all_signals(spark, folder, by_size=True):
    """Sampled by size as the SQL of sig03 to sig12 and tok16 is; the queries named whole look at whole texts."""
    return s.banded(documents(spark, folder), INDIC, by_size)


@query("sig02_basic_stats", f"WITH {BASIC} SELECT doc_id, char_length, byte_length, word_count, line_count, token_count_estimate, round({_ratio('char_length', 'token_count_estimate', '1.0')}, 6) AS fertility_estimate FROM basic")
def basic_stats(spark, folder):
    return s.basic(documents(spark, folder), INDIC).select("doc_id", "char_length", "byte_length", "word_count", "line_count", "token_count_estimate", *rounded("fertility_estimate"))


RATIOS = ("punct_ratio", "digit_ratio", "special_ratio", "upper_ratio")


@query("sig03_character_ratios", f"{ALL} SELECT doc_id, {_sql(RATIOS)} FROM sampled")
def character_ratios(spark, folder):
    return all_signals(spark, folder).select("doc_id", *rounded(*RATIOS))


WORDS = ("unique_token_ratio", "avg_word_length", "compression_ratio")


@query("sig04_word_stats", f"{ALL} SELECT doc_id, {_sql(WORDS)} FROM sampled")
def word_stats(spark, folder):
    return all_signals(spark, folder).select("doc_id", *rounded(*WORDS))


HITS = ("code_hits", "math_hits", "reasoning_hits", "agent_hits", "thought_hits")


@query("sig05_keyword_hits", f"{ALL} SELECT doc_id, {', '.join(HITS)} FROM sampled")
def keyword_hits(spark, folder):
    return all_signals(spark, folder).select("doc_id", *HITS)


SCORE_NAMES = ("code_score", "math_score", "reasoning_score", "agentic_score", "cot_score", "has_code", "has_math", "has_reasoning", "has_agentic", "has_cot")


@query("sig06_composite_scores", f"{ALL} SELECT doc_id, {', '.join(SCORE_NAMES)} FROM scores")
def composite_scores(spark, folder):
    return all_signals(spark, folder).select("doc_id", *SCORE_NAMES)


@query("sig07_difficulty", f"{ALL} SELECT doc_id, round(difficulty_score, 6) AS difficulty_score FROM scores")
def difficulty(spark, folder):
    return all_signals(spark, folder).select("doc_id", *rounded("difficulty_score"))


PROBABILITIES = tuple(f"band_p_{b}" for b in s.BANDS)


@query("sig08_band_probabilities", f"{ALL} SELECT doc_id, {_sql(PROBABILITIES)} FROM banded")
def band_probabilities(spark, folder):
    return all_signals(spark, folder).select("doc_id", *rounded(*PROBABILITIES))


@query("sig09_bands", f"{ALL} SELECT band, lang, count(*) AS n_documents FROM banded GROUP BY band, lang")
def band_counts(spark, folder):
    return all_signals(spark, folder).groupBy("band", "lang").agg(F.count("*").alias("n_documents"))


NOISES = ("whitespace_ratio", "url_ratio", "boilerplate_ratio")


@query("sig10_noise", f"{ALL} SELECT doc_id, {_sql(NOISES)}, url_count, thread_marker_count FROM noise")
def noise_metrics(spark, folder):
    return all_signals(spark, folder).select("doc_id", *rounded(*NOISES), "url_count", "thread_marker_count")


@query("sig11_rejections", f"{ALL} SELECT doc_id, rejection_reason, rejection_level FROM banded WHERE rejection_reason <> ''")
def rejected(spark, folder):
    return s.where_computed(all_signals(spark, folder), "is_rejected").select("doc_id", "rejection_reason", "rejection_level")


@query("sig12_accepted", f"{ALL} SELECT doc_id, source, lang, band, round(difficulty_score, 6) AS difficulty_score, word_count, token_count_estimate FROM banded WHERE rejection_reason = ''")
def accepted(spark, folder, by_size=True):
    return s.where_computed(all_signals(spark, folder, by_size), "NOT is_rejected").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "lang", "band", *rounded("difficulty_score"), "word_count", "token_count_estimate")


@query("tok16_distribution", f"""{ALL} SELECT source, lang, band, count(*) AS n_documents, sum(token_count_estimate)::BIGINT AS n_tokens, sum(word_count)::BIGINT AS n_words,
  round(avg(token_count_estimate), 6) AS mean_tokens, round(sum(token_count_estimate) / sum(sum(token_count_estimate)) OVER (PARTITION BY source), 6) AS share_of_source
  FROM banded WHERE rejection_reason = '' GROUP BY source, lang, band""")
def distribution(spark, folder, by_size=True):
    """Documents, tokens and words by source, language and band, and each group's share of its source."""
    from pyspark.sql import Window

    groups = accepted(spark, folder, by_size).groupBy("source", "lang", "band").agg(
        F.count("*").alias("n_documents"), F.sum("token_count_estimate").alias("n_tokens"), F.sum("word_count").alias("n_words"), F.round(F.avg("token_count_estimate"), 6).alias("mean_tokens"))
    # The window runs over the grouped rows, a few for each source.
    return groups.withColumn("share_of_source", F.round(F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("source")), 6))


@query("sig_whole", f"{WHOLE} SELECT doc_id, {_sql(RATIOS + WORDS + ('difficulty_score',) + PROBABILITIES)}, {', '.join(HITS + SCORE_NAMES)}, band, rejection_reason, rejection_level FROM banded")
def whole_signals(spark, folder):
    """sig03 to sig11 over whole texts: a row for each document, whatever its length."""
    rows = all_signals(spark, folder, by_size=False)
    return rows.select("doc_id", *rounded(*RATIOS, *WORDS, "difficulty_score", *PROBABILITIES), *HITS, *SCORE_NAMES, "band", "rejection_reason", "rejection_level")


def _of_whole(name: str) -> str:
    return SQL[name].replace(_SAMPLE, "text")


@query("sig09_whole", _of_whole("sig09_bands"))
def whole_band_counts(spark, folder):
    return all_signals(spark, folder, by_size=False).groupBy("band", "lang").agg(F.count("*").alias("n_documents"))


@query("sig12_whole", _of_whole("sig12_accepted"))
def whole_accepted(spark, folder):
    return accepted(spark, folder, by_size=False)


@query("tok16_whole", _of_whole("tok16_distribution"))
def whole_distribution(spark, folder):
    """tok16 with the bands and rejections of whole texts."""
    return distribution(spark, folder, by_size=False)
