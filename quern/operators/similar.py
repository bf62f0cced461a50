"""Similar documents: banded MinHash candidates, exact similarity of the candidates.

Affine permutations of 64-bit hashes give independent rows. Documents with the same words are one class; only class
representatives are hashed and compared, and the result is one row for each document with its class and the number of
its class's links.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.operators.hot import blocked_pairs
from quern.operators.signatures import word_grams, words

PRIME = 2**31 - 1
BAND_COUNT, BAND_ROWS = 16, 4
#: A bucket with more classes is paired in blocks of about so many.
HOT_BUCKET = 100


def _affine(times: int, plus: int):
    return lambda h: F.pmod(h * times + plus, F.lit(PRIME))


def _bands(grams: Column, bands: int, rows: int, seed: int) -> list[Column]:
    rng = random.Random(seed)
    hashed = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(PRIME)))
    out = []
    for b in range(bands):
        values = []
        for _ in range(rows):
            times, plus = rng.randrange(1, PRIME), rng.randrange(PRIME)
            values.append(F.array_min(F.transform(F.col("hashed"), _affine(times, plus))))
        out.append(F.xxhash64(F.lit(b), *values))
    return [hashed, *out]


def _pairs(rows: DataFrame) -> DataFrame:
    groups = rows.groupBy("key").agg(F.sort_array(F.collect_set("class")).alias("c")).where(F.size("c") > 1)
    return groups.select("c", F.posexplode("c").alias("i", "a")).select("a", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b"))


def similar_classes(documents: DataFrame, key: str, text: str, least: float = 0.8, length: int = 5, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Members (``key, class``) and links (``class_a < class_b, similarity``) of classes at least ``least`` similar in their
    sequences of ``length`` words. Texts with fewer words link only to equal ones, by being of their class."""
    tokens = documents.where(F.col(text).isNotNull()).select(F.col(key), words(F.col(text)).alias("tokens"))
    members = written(tokens.select(key, F.xxhash64(F.array_join("tokens", " ")).alias("class"), "tokens"), "class_members")
    one = members.groupBy("class").agg(F.min(F.struct(F.col(key), "tokens")).alias("m")).select("class", word_grams(F.col("m.tokens"), length).alias("grams")).where(F.size("grams") > 0)
    hashed, *keys = _bands(F.col("grams"), BAND_COUNT, BAND_ROWS, seed)
    classes = written(one.withColumn("hashed", hashed).select("class", "grams", F.array(*keys).alias("keys")), "classes")
    by_key = classes.select("class", F.explode("keys").alias("key"))
    counts = by_key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(by_key.join(counts, "key"), "class_buckets")
    usual = shared.where(F.col("n") <= HOT_BUCKET).select("key", "class")
    # Members of a hot bucket meet block by block; sets of too different sizes can't be similar enough.
    hot = shared.where(F.col("n") > HOT_BUCKET).join(classes.select("class", F.size("grams").alias("size")), "class")
    paired = blocked_pairs(hot, "class", "size", HOT_BUCKET).where(F.least("va", "vb") / F.greatest("va", "vb") >= least)
    pairs = _pairs(usual).union(paired.select("a", "b")).distinct()
    sets = classes.select("class", "grams")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = both.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), (common / (F.size("x") + F.size("y") - common)).alias("similarity")).where(F.col("similarity") >= least)
    return members.select(key, "class"), written(linked, "class_links")


def similar_documents(documents: DataFrame, key: str, text: str, least: float = 0.8, length: int = 5) -> DataFrame:
    """``key, class, n_links, class_size``: one row for each document."""
    members, linked = similar_classes(documents, key, text, least, length)
    degree = linked.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    sizes = members.groupBy("class").agg(F.count("*").alias("class_size"))
    return members.join(sizes, "class").join(degree, "class", "left").select(key, "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), "class_size")


MOST_ROUNDS = 60


def survivors(members: DataFrame, linked: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """``key`` of the documents that stay when duplicates are merged by score.

    Of equal texts the best document stays (the highest score, then the lowest key; a null score is the lowest). Of similar
    classes, taken from the best down, one stays unless a similar one stayed before. That order is followed without a loop over
    rows: in each round every class that is better than all its undecided neighbours stays and its neighbours go.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    scored = members.join(scores.select(key, score), key, "left")
    # The least of (negated score, key) is the best; classes with equal scores go by key as well.
    best = F.min(F.struct((-value).alias("s"), F.col(key).alias("k"))).alias("m")
    heads = written(scored.groupBy("class").agg(best).select("class", "m", F.col("m.k").alias(key)), "class_heads")
    rank = F.col("m")
    both = linked.select(F.col("class_a").alias("u"), F.col("class_b").alias("v")).union(linked.select(F.col("class_b").alias("u"), F.col("class_a").alias("v")))
    edges = both.join(heads.select(F.col("class").alias("v"), rank.alias("rv")), "v").join(heads.select(F.col("class").alias("u"), rank.alias("ru")), "u")
    edges = written(edges.select("u", "v", "ru", "rv"), "class_edges")
    gone = edges.select(F.col("u").alias("class")).where("false")
    for _ in range(MOST_ROUNDS):
        if edges.isEmpty():
            break
        stay = edges.groupBy("u", "ru").agg(F.min("rv").alias("m")).where(F.col("ru") < F.col("m")).select("u")
        lost = written(edges.join(stay, "u").select(F.col("v").alias("class")).distinct(), "classes_lost")
        gone = gone.union(lost)
        done = stay.union(lost.select(F.col("class").alias("u")))
        done = written(done, "classes_done")
        rest = edges.join(done, "u", "left_anti").join(done.select(F.col("u").alias("v")), "v", "left_anti")
        edges = written(rest.select("u", "v", "ru", "rv"), "class_edges")
    else:
        raise RuntimeError("survivors weren't complete after the last round")
    return heads.join(gone, "class", "left_anti").select(key)
