"""Measures of a document as column expressions, and the registry by which they are computed together.

A measure is a function from a text column to named columns. ``measured`` applies a choice of them in one projection;
``register`` adds one, also an Arrow-batched function, so a new measure needs no change elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Measure = Callable[[Column], dict[str, Column]]
MEASURES: dict[str, Measure] = {}

# Word pattern (the same in Java's and RE2's syntax) and sampled lengths.
WORD = r"[\p{L}\p{N}_']+"
ENTROPY_HEAD, SCORE_HEAD, SCRIPT_HEAD = 4000, 2000, 500


def register(function: Measure) -> Measure:
    MEASURES[function.__name__] = function
    return function


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def sum_over_counts(items: Column, value: Callable[[Column], Column]) -> Column:
    """The sum of ``value`` of how often each distinct item of an array occurs: one pass over the sorted array, whose equal items
    are runs. 0 for an empty array."""
    start = F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).cast("long").alias("run"), F.lit(0.0).alias("sum"))
    done = lambda a: a["sum"] + F.when(a["run"] > 0, value(a["run"]).cast("double")).otherwise(0.0)
    step = lambda a, x: F.when(a["item"] == x, F.struct(x.alias("item"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(F.struct(x.alias("item"), F.lit(1).cast("long").alias("run"), done(a).alias("sum")))
    return F.aggregate(F.array_sort(items), start, step, done)


@register
def length(text: Column) -> dict[str, Column]:
    w = words(text)
    return {"n_words": F.size(w), "mean_word_length": F.when(F.size(w) > 0, F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.size(w)).otherwise(0.0)}


@register
def readability(text: Column) -> dict[str, Column]:
    """Flesch-Kincaid grade from words, sentences and vowel runs (at least one a word)."""
    w = words(text)
    n = F.greatest(F.size(w), F.lit(1))
    sentences = F.greatest(F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.trim(s) != "")), F.lit(1))
    syllables = F.aggregate(w, F.lit(0), lambda a, x: a + F.greatest(F.regexp_count(x, F.lit("[aeiouy]+")), F.lit(1)))
    return {"n_sentences": sentences, "n_syllables": syllables, "grade": F.lit(0.39) * n / sentences + F.lit(11.8) * syllables / n - 15.59}


@register
def densities(text: Column) -> dict[str, Column]:
    size = F.greatest(F.length(text), F.lit(1))
    return {"structural_density": F.regexp_count(text, F.lit(r"[{}\[\]()<>:;=]")) / size, "symbolic_density": F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\p{N}\s]")) / size}


@register
def layout(text: Column) -> dict[str, Column]:
    lines = F.split(text, "\n")
    return {
        "n_paragraphs": F.size(F.filter(F.split(text, r"\n\s*\n"), lambda p: F.trim(p) != "")),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike(r"^\s*[-*•] "))),
        "n_headings": F.size(F.filter(lines, lambda x: x.rlike("^#{1,6} "))),
        "n_citations": F.regexp_count(text, F.lit(r"\[\d{1,3}\]")),
    }


@register
def modality(text: Column) -> dict[str, Column]:
    """The first form of content that shows: code, formulas, dialogue, table, prose."""
    found = F.when(text.rlike(r"(?m)^\s*(?:def |class |func |import |return |#include)"), "code").when(text.rlike(r"\$[^$\n]+\$|\\(?:frac|sum|int)"), "math").when(text.rlike(r"(?m)^\[(?:USER|ASSISTANT)\]"), "dialogue").when(text.rlike(r"(?m)^\|.*\|$"), "table")
    return {"modality": found.otherwise("prose")}


@register
def script(text: Column, head: int | None = None) -> dict[str, Column]:
    """Whether a script of India shows anywhere; ``head``: in so many characters at the beginning."""
    return {"is_indic": (F.substring(text, 1, head) if head else text).rlike("[ऀ-ൿ]")}


@register
def repetition(text: Column) -> dict[str, Column]:
    w = words(text)
    return {"unique_ratio": F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)}


def measured(df: DataFrame, names: list[str] | None = None, text: str = "text") -> DataFrame:
    """The chosen measures (all if none are named) as columns; null texts count as empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    columns = {}
    for name in names or list(MEASURES):
        columns |= MEASURES[name](value)
    return df.withColumns(columns)


def first_rejection(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``rejected_by``: the first rule that holds; later rules aren't evaluated."""
    reason = F
    for name, condition in rules:
        reason = reason.when(condition, name)
    return df.withColumn("rejected_by", reason.otherwise(F.lit(None).cast("string")))


def record_uuid(*parts: Column) -> Column:
    """Name-based UUID (version 5, DNS namespace) of the parts joined by '#'."""
    space = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    digest = F.sha1(F.concat(space, F.encode(F.concat_ws("#", *parts), "utf-8")))
    variant = F.lower(F.conv((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)) + 8).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
