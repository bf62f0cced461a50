"""Signals of short questions, answers and conversations in many languages, their difficulty and bands.

Unlike ``signals``, word counts take the split as it is, compression is characters a byte, and bands follow Gaussian weights.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.signals import BAND_WIDTH, BANDS, CENTERS, LEAST_PROBABILITY, hits, ratio

# Bytes a token by language, languages of India, marks of conversations, weights.
BYTES_A_TOKEN = {"en": 4.0, "hi": 6.0, "mr": 6.0, "bn": 6.5, "as": 6.5, "ta": 5.5, "te": 6.0, "kn": 6.0, "ml": 5.5, "gu": 6.5, "pa": 6.0, "or": 6.0}
OTHER_BYTES_A_TOKEN = 4.5
INDIC = ("hi", "mr", "bn", "as", "ta", "te", "kn", "ml", "gu", "pa", "or")
TURN_MARKS = ("user:", "human:", "assistant:", "<|user|>", "<|assistant|>", "system:", "[inst]", "[/inst]")
WEIGHTS = {"vocabulary": 0.30, "length": 0.20, "density": 0.20, "language": 0.10, "conversation": 0.20}


def shape(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.split(text, r"\s+")
    return df.withColumns({
        "char_length": F.length(text), "byte_length": F.octet_length(text), "word_count": F.size(words),
        "unique_token_ratio": ratio(F.size(F.array_distinct(words)), F.size(words)), "compression_ratio": ratio(F.length(text), F.octet_length(text), 1.0),
    })


def pieces(text: Column, mark: str) -> Column:
    """How often a mark stands in a text."""
    return F.size(F.split(text, mark)) - 1


def questions(df: DataFrame, language: str = "language") -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.withColumns({
        "qa_pair_count": pieces(text, r"\?"), "danda_count": pieces(text, "।"), "comma_count": pieces(text, ","),
        "qa_density": ratio(pieces(text, r"\?"), F.col("word_count")), "is_indic": F.coalesce(F.col(language).isin(*INDIC), F.lit(False)), "turn_marks": hits(F.lower(text), TURN_MARKS),
    })


def tokens_by_language(df: DataFrame, language: str = "language") -> DataFrame:
    divisor = F
    for code, size in BYTES_A_TOKEN.items():
        divisor = divisor.when(F.col(language) == code, size)
    return df.withColumn("token_count_estimate", F.greatest(F.lit(1), (F.col("byte_length") / divisor.otherwise(OTHER_BYTES_A_TOKEN)).cast("int")))


def difficulty(df: DataFrame) -> DataFrame:
    parts = {
        "vocabulary": F.least(F.col("unique_token_ratio"), F.lit(1.0)), "length": F.least(F.col("char_length") / 1000.0, F.lit(1.0)),
        "density": (F.lit(1.0) - F.least(F.col("qa_density"), F.lit(1.0))) * 0.5, "language": F.when(F.col("is_indic"), 0.15).otherwise(0.05),
        "conversation": F.least(F.col("turn_marks") / 5.0, F.lit(0.25)),
    }
    return df.withColumn("difficulty_score", reduce(add, (parts[k] * w for k, w in WEIGHTS.items())))


def gaussian_bands(df: DataFrame) -> DataFrame:
    """Probabilities by Gaussian weights around the centers, and the lowest band clearly above the least probability."""
    weights = {b: F.exp(F.lit(-0.5) * ((F.col("difficulty_score") - CENTERS[b]) / BAND_WIDTH) * ((F.col("difficulty_score") - CENTERS[b]) / BAND_WIDTH)) for b in BANDS}
    df = df.withColumns({f"w_{b}": w for b, w in weights.items()})
    total = reduce(add, (F.col(f"w_{b}") for b in BANDS))
    df = df.withColumns({f"band_p_{b}": F.col(f"w_{b}") / total for b in BANDS}).drop(*(f"w_{b}" for b in BANDS))
    band = F
    for b in BANDS:
        band = band.when(F.col(f"band_p_{b}") > LEAST_PROBABILITY, b)
    return df.withColumn("band", band.otherwise(BANDS[0]))


def clamped(df: DataFrame, ranges: list[tuple[str, str, str]], source: str = "source", band: str = "band") -> DataFrame:
    """``assigned_band``: the band within the (lowest, highest) of the first range whose name is part of the source."""
    low, high = F, F
    for name, lowest, highest in ranges:
        here = F.contains(F.lower(F.col(source)), F.lit(name))
        low, high = low.when(here, lowest), high.when(here, highest)
    # Bands order as their names do.
    return df.withColumn("assigned_band", F.greatest(low.otherwise(BANDS[0]), F.least(high.otherwise(BANDS[-1]), F.col(band))))
