"""Quality signals, difficulty and bands of a text as column expressions, without Python in the data path."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signals' keywords, weights and thresholds.
CODE_WORDS = ("def ", "function ", "class ", "import ", "return ", "const ", "let ", "var ", "public ", "private ", "void ", "int ", "string ", "if (", "for (", "while (", "malloc", "sizeof", "iostream", "namespace")
MATH_WORDS = ("theorem", "lemma", "proof", "corollary", "equation", "integral", "derivative", "polynomial", "qed", "iff", "proposition")
REASONING_WORDS = ("therefore", "thus", "hence", "consequently", "because", "since", "implies", "follows that", "we conclude", "as a result")
AGENT_WORDS = ("execute", "invoke", "call", "orchestrate", "delegate", "workflow", "pipeline", "task", "step", "action", "tool use", "agent")
THOUGHT_WORDS = ("let's think", "step by step", "first", "second", "next", "finally", "breaking down", "analyzing")
BOILERPLATE = ("cookie policy", "privacy policy", "terms of service", "all rights reserved", "subscribe to", "sign up")
THREAD_MARKS = (">>", "replied to", "in response to", "re:")
PUNCTUATION, SPECIAL, DIGITS = ".,;:()[]{}!?", "{}=&|<>", "0123456789"
BANDS = ("B0", "B1", "B2", "B3", "B4", "B5")
CENTERS = {"B0": 0.05, "B1": 0.20, "B2": 0.35, "B3": 0.55, "B4": 0.75, "B5": 0.90}
BAND_WIDTH, LEAST_PROBABILITY = 0.20, 0.15
TOKENS_A_WORD, INDIC_TOKENS_A_WORD = 1.3, 1.8
SAMPLE_STEPS = ((1_000, None), (10_000, 5_000), (50_000, 15_000), (None, 25_000))
#: (name, score, condition as SQL, added weight): the first that holds for a band counts.
NUDGES = (
    ("B1", "code_score > 0 AND code_score < 15", 0.05),
    ("B2", "code_score >= 15 AND code_score < 25", 0.08),
    ("B2", "reasoning_score >= 5", 0.05),
    ("B3", "code_score >= 25", 0.10),
    ("B3", "reasoning_score >= 8", 0.08),
    ("B3", "cot_score >= 10", 0.05),
    ("B4", "math_score >= 12", 0.15),
    ("B4", "code_score >= 40", 0.12),
    ("B4", "reasoning_score >= 12", 0.10),
    ("B5", "agentic_score >= 8", 0.20),
    ("B5", "math_score >= 20", 0.12),
    ("B5", "reasoning_score >= 15 AND code_score >= 30", 0.10),
)
#: (reason, level, condition as SQL); the first that holds is the reason.
REJECTIONS = (
    ("too_short_bytes", 1, "byte_length < 50"),
    ("too_short_chars", 1, "char_length < 20"),
    ("too_short_tokens", 1, "token_count_estimate < 10"),
    ("repetitive_template", 2, "unique_token_ratio < 0.01 AND word_count > 200"),
    ("excessive_whitespace", 2, "whitespace_ratio > 0.95"),
    ("link_spam", 2, "url_ratio > 0.7 AND url_count > 50"),
    ("boilerplate_spam", 2, "boilerplate_ratio > 0.50"),
    ("orphaned_thread_fragment", 2, "thread_marker_count > 5 AND token_count_estimate < 200"),
)


def ratio(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """part / whole, or a default where whole isn't positive."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(otherwise))


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the text (each counted once)."""
    return reduce(add, (text.contains(w).cast("int") for w in words))


def adaptive_sample(text: Column) -> Column:
    """The text itself, or of a longer one its beginning: what the signals look at if they are asked to sample by size."""
    expression = F
    size = F.length(text)
    for limit, taken in SAMPLE_STEPS:
        value = text if taken is None else F.substring(text, 1, taken)
        if limit is None:
            return expression.otherwise(value)
        expression = expression.when(size < limit, value)
    return expression


def basic(df: DataFrame, indic_prefixes: tuple[str, ...] = ("sangraha_",)) -> DataFrame:
    """Lengths and counts of ``text``. Nulls count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    indic = reduce(lambda a, b: a | b, (F.coalesce(F.col("source"), F.lit("")).startswith(p) for p in indic_prefixes))
    df = df.withColumns({
        "char_length": F.length(text),
        "byte_length": F.octet_length(text),
        "word_count": F.greatest(F.size(F.split(text, r"\s+")) - 1, F.lit(1)),
        "line_count": F.greatest(F.size(F.split(text, "\n")) - 1, F.lit(1)),
    })
    df = df.withColumn("token_count_estimate", (F.col("word_count") * F.when(indic, INDIC_TOKENS_A_WORD).otherwise(TOKENS_A_WORD)).cast("int"))
    return df.withColumn("fertility_estimate", ratio(F.col("char_length"), F.col("token_count_estimate"), 1.0))


def noise(df: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return df.withColumns({
        "whitespace_ratio": ratio(count_of(text, " \t\n\r"), F.col("char_length")),
        "url_count": F.regexp_count(text, F.lit("https?://")),
        "url_ratio": ratio(F.regexp_count(text, F.lit("https?://")), F.col("word_count")),
        "boilerplate_ratio": hits(F.lower(text), BOILERPLATE) / len(BOILERPLATE),
        "thread_marker_count": hits(text, THREAD_MARKS),
    })


def sampled(df: DataFrame, by_size: bool = False) -> DataFrame:
    """Character, word and keyword signals of the whole text; ``by_size``: of the adaptive sample only."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = df.withColumn("text_sample", adaptive_sample(text) if by_size else text)
    sample, size, low = F.col("text_sample"), F.length("text_sample"), F.lower("text_sample")
    words = F.split(sample, r"\s+")
    return df.withColumns({
        "punct_ratio": ratio(count_of(sample, PUNCTUATION), size),
        "digit_ratio": ratio(count_of(sample, DIGITS), size),
        "special_ratio": ratio(count_of(sample, SPECIAL), size),
        "upper_ratio": ratio(size - F.length(F.regexp_replace(sample, "[A-Z]", "")), size),
        "unique_token_ratio": ratio(F.size(F.array_distinct(words)), F.col("word_count")),
        "avg_word_length": ratio(F.length(F.concat_ws("", words)), F.col("word_count")),
        "compression_ratio": ratio(F.col("byte_length"), F.col("char_length")),
        "code_hits": hits(low, CODE_WORDS), "math_hits": hits(low, MATH_WORDS), "reasoning_hits": hits(low, REASONING_WORDS),
        "agent_hits": hits(low, AGENT_WORDS), "thought_hits": hits(low, THOUGHT_WORDS),
    }).drop("text_sample")


def scores(df: DataFrame) -> DataFrame:
    df = df.withColumns({
        "code_score": (F.col("special_ratio") * 30 + F.col("digit_ratio") * 20 + F.col("code_hits") * 5 + F.when(F.col("avg_word_length") > 8, 5).otherwise(0)).cast("int"),
        "math_score": (F.col("math_hits") * 6 + F.col("digit_ratio") * 15 + F.col("special_ratio") * 8).cast("int"),
        "reasoning_score": (F.col("reasoning_hits") * 6 + F.col("upper_ratio") * 8).cast("int"),
        "agentic_score": F.col("agent_hits") * 6,
        "cot_score": F.col("thought_hits") * 5 + F.col("reasoning_hits") * 2,
    })
    one = F.lit(1.0)
    difficulty = (
        F.least(F.col("unique_token_ratio") * 2.5, one) * 0.25 + F.least((F.col("avg_word_length") - 4) / 6, one) * 0.25
        + F.least(F.col("punct_ratio") * 3, one) * 0.20 + F.least((F.col("code_score") + F.col("math_score") + F.col("reasoning_score")) / 60, one) * 0.30
    )
    return df.withColumns({
        "has_code": F.col("code_score") >= 10, "has_math": F.col("math_score") >= 8, "has_reasoning": F.col("reasoning_score") >= 6,
        "has_agentic": F.col("agentic_score") >= 8, "has_cot": F.col("cot_score") >= 10, "difficulty_score": difficulty,
    })


def bands(df: DataFrame) -> DataFrame:
    """Probability of each band around its center, and the lowest band that is likely enough."""
    weights = {}
    for b in BANDS:
        weight = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(F.col("difficulty_score") - CENTERS[b]) / BAND_WIDTH)
        nudge = F
        own = [(c, w) for name, c, w in NUDGES if name == b]
        for condition, more in own:
            nudge = nudge.when(F.expr(condition), more)
        weights[f"w_{b}"] = weight + nudge.otherwise(0.0) if own else weight
    df = df.withColumns(weights)
    total = reduce(add, (F.col(f"w_{b}") for b in BANDS))
    df = df.withColumns({f"band_p_{b}": F.col(f"w_{b}") / F.when(total > 0, total).otherwise(1.0) for b in BANDS}).drop(*weights)
    band = F
    for b in BANDS[:-1]:
        band = band.when(F.col(f"band_p_{b}") >= LEAST_PROBABILITY, b)
    return df.withColumn("band", band.otherwise(BANDS[-1]))


def rejections(df: DataFrame) -> DataFrame:
    reason, level = F, F
    for name, number, condition in REJECTIONS:
        reason, level = reason.when(F.expr(condition), name), level.when(F.expr(condition), number)
    return df.withColumns({"rejection_reason": reason.otherwise(""), "rejection_level": level}).withColumn("is_rejected", F.col("rejection_reason") != "")


def where_computed(df: DataFrame, condition: str) -> DataFrame:
    """Rows by a condition on costly computed columns. A plain filter would be pushed below their projection and compute them a
    second time in the scan; the row number in the mark keeps it above."""
    return df.withColumn("_kept", F.when(F.expr(condition), F.monotonically_increasing_id())).where("_kept IS NOT NULL").drop("_kept")


def banded(df: DataFrame, indic_prefixes: tuple[str, ...] = ("sangraha_",), by_size: bool = False) -> DataFrame:
    """All signals, the rejection and the band of each row, in one projection over one scan; the text isn't carried on."""
    return rejections(bands(scores(sampled(noise(basic(df, indic_prefixes)), by_size).drop("text"))))
