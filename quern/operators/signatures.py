"""Signatures of texts: exact hashes, SimHash and MinHash, as built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
PERMUTATIONS = 128
SHIFT = 32


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")


def word_grams(tokens: Column, n: int) -> Column:
    """Distinct sequences of n words; empty for a shorter text."""
    starts = lambda t: F.sequence(F.lit(1), F.size(t) - (n - 1))
    grams = lambda t: F.array_distinct(F.transform(starts(t), lambda i: F.array_join(F.slice(t, i, n), " ")))
    # The words are bound to a variable: named within the inner function, they would be cut again for every sequence.
    return F.transform(F.array(tokens), lambda t: F.when(F.size(t) >= n, grams(t)).otherwise(F.array().cast("array<string>")))[0]


def gram_hashes(tokens: Column, n: int) -> Column:
    """As ``word_grams``, as 64-bit hashes: a fraction of the bytes to compare and to shuffle."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    return F.when(F.size(tokens) >= n, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, n))))).otherwise(F.array().cast("array<bigint>"))


def simhash(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """``key, simhash``: a bit is set where at least half of the words' hashes have it. Texts without words have all bits set.

    The words' hashes are counted by bit in one aggregation with partial sums, not gathered."""
    hashed = df.select(key, F.explode_outer(tokens).alias("w")).withColumn("h", F.conv(F.substring(F.sha2("w", 256), 49, 16), 16, -10).cast("long"))
    bits = [F.sum(F.when(F.col("w").isNull(), 0).when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"b{b}") for b in range(BITS)]
    value = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.col(f"b{b}") >= 0, F.lit((1 << b) - (1 << BITS) * (b == BITS - 1)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(BITS)))
    return hashed.groupBy(key).agg(*bits).select(key, value.alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def minhash(df: DataFrame, key: str, grams: Column, permutations: int = PERMUTATIONS) -> DataFrame:
    """``key, signature``: least shifted hash of the sequences for each permutation (hash + i) mod 2^32.
    A text without sequences has the greatest value everywhere.

    A shift by i takes the hashes of at least 2^32 - i round to 0 and leaves the order of the others, so the least hash and the
    few that some shift takes round give all values: a text's sequences are hashed within its row and not shuffled. Hashes are
    compared as their hexadecimal digits, which have the same order."""
    top = 2**SHIFT
    digits = F.transform(grams, lambda g: F.substring(F.md5(g), 25, 8))
    ends = F.transform(F.array(digits), lambda d: F.struct(F.array_min(d).alias("least"), F.array_distinct(F.filter(d, lambda h: h >= f"{top - permutations + 1:08x}")).alias("round")))[0]
    rows = df.select(key, ends.alias("e")).groupBy(key).agg(F.min("e.least").alias("least"), F.flatten(F.collect_set("e.round")).alias("round"))
    number = lambda h: F.conv(h, 16, 10).cast("long")
    rows = rows.select(key, number(F.col("least")).alias("least"), F.transform("round", number).alias("round"))
    least = lambda i: F.coalesce(F.array_min(F.filter("round", lambda h: h >= top - i)) - top, F.col("least")) + i
    shifts = F.sequence(F.lit(0), F.lit(permutations - 1))
    signature = F.when(F.size("round") > 0, F.transform(shifts, least)).otherwise(F.transform(shifts, lambda i: F.coalesce(F.col("least") + i, F.lit(top - 1))))
    return rows.select(key, signature.alias("signature"))


def agreement(a: Column, b: Column) -> Column:
    """Estimated similarity: share of equal signature values."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), add) / F.size(a)
