"""Signals of short exchanges over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import exchanges as x
from quern.functions.signals import BAND_WIDTH, BANDS, CENTERS, LEAST_PROBABILITY
from quern.plans.registry import query, table

#: Source name part, lowest and highest band: a parameter of the clamp.
RANGES = [("lessons", "B0", "B2"), ("wikiish", "B2", "B4"), ("coderepo", "B3", "B5"), ("bharat", "B0", "B1")]
_SHAPE = """s AS (SELECT doc_id, lang, source, t, w, length(t) AS char_length, octet_length(encode(t)) AS byte_length, len(w) AS word_count, len(list_distinct(w)) / len(w)::DOUBLE AS unique_token_ratio
  FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '\\s+') AS w FROM documents))"""
_MARKS = " + ".join(f"contains(lower(t), '{m}')::INT" for m in x.TURN_MARKS)
_INDIC = "coalesce(lang IN (" + ", ".join(f"'{c}'" for c in x.INDIC) + "), false)"
_QA = f"q AS (SELECT *, len(string_split(t, '?')) - 1 AS qa_pair_count, len(string_split(t, '।')) - 1 AS danda_count, len(string_split(t, ',')) - 1 AS comma_count, (len(string_split(t, '?')) - 1) / word_count::DOUBLE AS qa_density, {_INDIC} AS is_indic, {_MARKS} AS turn_marks FROM s)"
_HARD = "h AS (SELECT *, least(unique_token_ratio, 1.0) * 0.3::DOUBLE + least(char_length / 1000.0::DOUBLE, 1.0) * 0.2::DOUBLE + (1.0 - least(qa_density, 1.0)) * 0.5::DOUBLE * 0.2::DOUBLE + CASE WHEN is_indic THEN 0.15::DOUBLE ELSE 0.05::DOUBLE END * 0.1::DOUBLE + least(turn_marks / 5.0::DOUBLE, 0.25::DOUBLE) * 0.2::DOUBLE AS difficulty_score FROM q)"
_G = ", ".join(f"exp(-0.5::DOUBLE * ((difficulty_score - {CENTERS[b]}::DOUBLE) / {BAND_WIDTH}::DOUBLE) ** 2) AS w_{b}" for b in BANDS)
_SUM = "(" + " + ".join(f"w_{b}" for b in BANDS) + ")"
_BAND = "b AS (SELECT *, CASE " + " ".join(f"WHEN w_{b} / {_SUM} > {LEAST_PROBABILITY}::DOUBLE THEN '{b}'" for b in BANDS) + f" ELSE 'B0' END AS band FROM (SELECT *, {_G} FROM h))"


def shaped(spark, folder):
    return x.shape(table(spark, folder, "documents").select("doc_id", "lang", "source", "text"))


def banded(spark, folder):
    return x.gaussian_bands(x.difficulty(x.questions(shaped(spark, folder), "lang")).drop("text"))


@query("sig17_shape", f"WITH {_SHAPE} SELECT doc_id, char_length, byte_length, word_count, round(unique_token_ratio, 6) AS unique_token_ratio FROM s")
def shape(spark, folder):
    return shaped(spark, folder).select("doc_id", "char_length", "byte_length", "word_count", F.round("unique_token_ratio", 6).alias("unique_token_ratio"))


@query("sig18_questions", f"WITH {_SHAPE}, {_QA} SELECT doc_id, qa_pair_count, danda_count, comma_count, is_indic FROM q")
def questions(spark, folder):
    return x.questions(shaped(spark, folder), "lang").select("doc_id", "qa_pair_count", "danda_count", "comma_count", "is_indic")


@query("sig19_tokens_by_language", f"WITH {_SHAPE} SELECT doc_id, greatest(1, trunc(byte_length / CASE " + " ".join(f"WHEN lang = '{c}' THEN {v}::DOUBLE" for c, v in x.BYTES_A_TOKEN.items()) + f" ELSE {x.OTHER_BYTES_A_TOKEN}::DOUBLE END)::INT) AS token_count_estimate FROM s")
def tokens(spark, folder):
    return x.tokens_by_language(shaped(spark, folder), "lang").select("doc_id", "token_count_estimate")


@query("sig20_exchange_difficulty", f"WITH {_SHAPE}, {_QA}, {_HARD} SELECT doc_id, round(difficulty_score, 5) AS difficulty_score FROM h")
def difficulty(spark, folder):
    return x.difficulty(x.questions(shaped(spark, folder), "lang")).select("doc_id", F.round("difficulty_score", 5).alias("difficulty_score"))


@query("sig21_gaussian_bands", f"WITH {_SHAPE}, {_QA}, {_HARD}, {_BAND} SELECT band, lang, count(*) AS n FROM b GROUP BY band, lang")
def bands(spark, folder):
    return banded(spark, folder).groupBy("band", "lang").agg(F.count("*").alias("n"))


_LOW = "CASE " + " ".join(f"WHEN contains(lower(source), '{n}') THEN '{a}'" for n, a, _ in RANGES) + " ELSE 'B0' END"
_HIGH = "CASE " + " ".join(f"WHEN contains(lower(source), '{n}') THEN '{b}'" for n, _, b in RANGES) + " ELSE 'B5' END"


@query("sig22_clamped_bands", f"WITH {_SHAPE}, {_QA}, {_HARD}, {_BAND} SELECT source, greatest({_LOW}, least({_HIGH}, band)) AS assigned_band, count(*) AS n FROM b GROUP BY 1, 2")
def clamped(spark, folder):
    return x.clamped(banded(spark, folder), RANGES).groupBy("source", "assigned_band").agg(F.count("*").alias("n"))
