"""Problem 5: records that repeat another record's text with small changes, by covering locality-sensitive hashing.

A text is a set of word sequences. Several independent sketches of WIDTH minhash symbols stand for it, so that similar texts
agree in most symbols of a sketch. Each sketch is hashed once for each mask of a covering code: mask v keeps position i where
the parity of v & (1, i) is odd. Any RADIUS positions span less than the whole space of vectors, so some mask keeps none of
them: every pair that differs in at most RADIUS symbols of a sketch collides in some table. (The mask that keeps all
positions is left out: equal sketches collide under any other.) One sketch misses a pair of similarity 0.5 in 58.2 % of
cases; ``design`` takes as many as miss less than MOST_MISSED of the pairs at the asked similarity, 9 for 0.5. They miss 0.8 %
of pairs of similarity 0.5, 0.13 % of 0.55 and 0.01 % of 0.6.

Texts with the same words are one content. Only contents are hashed and compared; records are members of a content.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.operators.hot import blocked_pairs

WIDTH, DIMENSION = 8, 4
RADIUS = DIMENSION - 1
#: Share of the pairs at the asked similarity that all sketches together may miss, and that may fail the agreement of sketches.
MOST_MISSED, MOST_REFUSED, MOST_SKETCHES = 0.01, 1e-6, 64
#: A bucket with more contents than this is paired in blocks of about so many.
HOT_BUCKET = 64
AGREEMENT = "aggregate(zip_with({}, {}, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)"
#: Up to so many record ids (under 64 MB) are broadcast to choose the texts to read again; more are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Bytes of keys in a task, while there are fewer than MANY tasks, and at most.
TASK_BYTES, MANY, MOST_TASK_BYTES = 8 << 20, 2000, 256 << 20


def masks() -> list[list[int]]:
    """Positions kept by each mask of the covering code."""
    column = [(1 << (DIMENSION - 1)) | i for i in range(WIDTH)]
    kept = [[i for i in range(WIDTH) if (v & column[i]).bit_count() & 1] for v in range(1, 1 << DIMENSION)]
    return [m for m in kept if len(m) < WIDTH]


def chance(similarity: float) -> float:
    """Probability that a pair collides in some table of one sketch."""
    kept = [set(m) for m in masks()]
    free = [sum(any(not m & set(d) for m in kept) for d in itertools.combinations(range(WIDTH), n)) for n in range(WIDTH + 1)]
    return sum(f * similarity ** (WIDTH - n) * (1 - similarity) ** n for n, f in enumerate(free))


def design(least: float) -> tuple[int, int]:
    """Sketches that miss less than MOST_MISSED of the pairs of similarity ``least``, and how many of their symbols must agree before
    texts are read: so few that less than MOST_REFUSED of these pairs have fewer."""
    found = chance(least)
    number = 1 if found >= 1 else math.ceil(math.log(MOST_MISSED) / math.log1p(-found)) if found > 0 else MOST_SKETCHES + 1
    if number > MOST_SKETCHES:
        raise ValueError(f"pairs of similarity {least} need {number} sketches, more than {MOST_SKETCHES}")
    symbols, below, agree = number * WIDTH, 0.0, 0
    while agree < symbols:
        below += math.comb(symbols, agree) * least**agree * (1 - least) ** (symbols - agree)
        if below > MOST_REFUSED:
            break
        agree += 1
    return number, agree


SKETCHES, LEAST_AGREEMENT = design(0.5)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(words: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the sequences of ``length`` words, in order."""
    n = len(words) - length + 1
    if n <= 0:
        return words[:0]
    out = np.zeros(n, dtype=np.uint64)
    for i in range(length):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _sketcher(length: int, count: int):
    random = np.random.default_rng(20)
    times = random.integers(1, 2**32, count, dtype=np.uint32) | np.uint32(1)
    plus = random.integers(0, 2**32, count, dtype=np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 400):
                part = batch.iloc[at : at + 400]
                ids, contents, sizes, sets = [], [], [], []
                for key, text in zip(part.iloc[:, 0], part.iloc[:, 1]):
                    words = np.array([known[w] for w in (text or "").lower().split()], dtype=np.uint64)
                    ids.append(key)
                    contents.append(xxhash.xxh64_intdigest(words.tobytes()) - 2**63)
                    sets.append(shingles(words, length))
                    sizes.append(len(sets[-1]))
                sizes = np.array(sizes)
                full = np.flatnonzero(sizes > 0)
                sketch = np.zeros((len(ids), count), dtype=np.uint32)
                if len(full):
                    everything = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    for k in range(count):
                        # The least product says little of its low bits; folded, symbols of one text don't depend on each other.
                        mixed = (everything ^ plus[k]) * times[k]
                        sketch[full, k] = np.minimum.reduceat(mixed ^ (mixed >> np.uint32(15)), starts)
                yield pd.DataFrame({"id": ids, "content": contents, "n_shingles": sizes, "sketch": list(sketch.view(np.int32))})

    return run


def sketches(documents: DataFrame, length: int, id_column: str, text_column: str, number: int) -> DataFrame:
    rows = documents.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull())
    return rows.select(F.col(id_column).cast("string"), text_column).mapInPandas(_sketcher(length, number * WIDTH), "id string, content long, n_shingles long, sketch array<int>")


def _keyed(number: int):
    """A row for each content, sketch and mask, with a hash of the kept symbols: sums of products, a random factor for each place."""
    kept = masks()
    random = np.random.default_rng(21)
    times = random.integers(1, 2**63, number * WIDTH, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    salt = random.integers(0, 2**63, number * len(kept), dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                product = (np.stack(part["sketch"])[:, : number * WIDTH].astype(np.uint32).astype(np.uint64) + np.uint64(1)) * times
                keys = np.empty((len(salt), len(part)), dtype=np.uint64)
                for s in range(number):
                    for m, positions in enumerate(kept):
                        keys[s * len(kept) + m] = product[:, [s * WIDTH + i for i in positions]].sum(1) + salt[s * len(kept) + m]
                keys ^= keys >> np.uint64(31)
                yield pd.DataFrame({"key": keys.ravel().view(np.int64), "content": np.tile(part["content"].to_numpy(), len(salt))})

    return run


def _shared(most: int):
    """Of rows sorted by key, the pairs of contents with the same key (a < b, no key), and the rows of keys with more than
    ``most`` contents (key and a) as they pass: no bucket is held."""

    def pairs(key: np.ndarray, content: np.ndarray) -> list[pd.DataFrame]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        out = []
        for size in np.unique(sizes):
            if size < 2:
                continue
            runs = starts[sizes == size]
            if size > most:
                rows = (runs[:, None] + np.arange(size)).ravel()
                out.append(pd.DataFrame({"key": key[rows], "a": content[rows], "b": pd.array([pd.NA] * len(rows), dtype="Int64")}))
                continue
            members = np.sort(content[runs[:, None] + np.arange(size)], axis=1)
            i, j = np.triu_indices(size, 1)
            a, b = members[:, i].ravel(), members[:, j].ravel()
            out.append(pd.DataFrame({"key": pd.array([pd.NA] * len(a), dtype="Int64"), "a": a, "b": b}))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, content, hot = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None
        for batch in batches:
            key, content = np.concatenate([key, batch["key"].to_numpy()]), np.concatenate([content, batch["content"].to_numpy()])
            if hot is not None:
                passed = int(np.searchsorted(key, hot, side="right"))
                yield pd.DataFrame({"key": key[:passed], "a": content[:passed], "b": pd.array([pd.NA] * passed, dtype="Int64")})
                key, content = key[passed:], content[passed:]
            if not len(key):
                continue
            hot, last = None, int(np.searchsorted(key, key[-1], side="left"))
            yield from pairs(key[:last], content[:last])
            key, content = key[last:], content[last:]
            if len(key) > most:
                hot = key[-1]
                yield pd.DataFrame({"key": key, "a": content, "b": pd.array([pd.NA] * len(key), dtype="Int64")})
                key, content = key[:0], content[:0]
        yield from pairs(key, content)

    return run


def candidates(contents: DataFrame, partitions: int, number: int = SKETCHES, agree: int = LEAST_AGREEMENT) -> DataFrame:
    """Distinct pairs a < b of contents that collide in a table. contents: content, sketch; written.

    The rows by key are shuffled once, sorted, and read in passing. Members of a hot bucket are paired block by block, all with
    all, and of buckets with the same members (a family of texts shares most of its keys) only one is; of these pairs those are
    kept whose sketches agree enough for their texts to be read.
    """
    by_key = contents.select("content", "sketch").mapInPandas(_keyed(number), "key long, content long").repartition(partitions, "key").sortWithinPartitions("key")
    shared = written(by_key.mapInPandas(_shared(HOT_BUCKET), "key long, a long, b long"), "shared_buckets")
    usual, hot = shared.where("key IS NULL").select("a", "b"), shared.where("key IS NOT NULL").select("key", F.col("a").alias("content"))
    if hot.isEmpty():
        return usual.distinct()
    members = hot.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("content")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "content")).alias("y"))
    one = members.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")
    sketch = contents.select("content", F.slice("sketch", 1, WIDTH * number).alias("sketch"))
    paired = blocked_pairs(hot.join(one, "key").join(sketch, "content"), "content", "sketch", HOT_BUCKET).where(F.expr(AGREEMENT.format("va", "vb")) >= agree)
    return usual.union(paired.select("a", "b")).distinct()


def _tasks(contents: int, number: int) -> int:
    """Tasks for the rows by key: small ones first, then as many as keep each task's rows under MOST_TASK_BYTES."""
    size = 16 * contents * number * len(masks())
    return max(1, min(size // TASK_BYTES + 1, MANY), size // MOST_TASK_BYTES + 1)


def _exact_sets(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            sets = [np.unique(shingles(np.array([known[w] for w in text.lower().split()], dtype=np.uint64), length)).view(np.int64) for text in batch.iloc[:, 1]]
            yield pd.DataFrame({"content": batch.iloc[:, 0], "parts": sets})

    return run


def links(documents: DataFrame, least: float = 0.5, length: int = 3, id_column: str = "id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members and links.

    Members: ``id, content`` for each record with at least ``length`` words; records with the same words share a content.
    Links: ``content_a < content_b, similarity`` for different contents whose sets of word sequences have at least
    ``least`` in common, by the exact similarity of the whole texts. ``least`` decides the number of sketches (see ``design``).

    Null and short texts have no word sequences, so no similarity, and are no members. Rows sent again are one record.
    """
    number, agree = design(least)
    found = written(sketches(documents, length, id_column, text_column, number), "sketches").where("n_shingles > 0")
    members = found.select("id", "content").distinct()
    contents = written(found.groupBy("content").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "contents")
    pairs = candidates(contents, _tasks(contents.count(), number), number, agree)
    sketch = contents.select("content", "sketch")
    agreement = F.expr(AGREEMENT.format("sa", "sb"))
    likely = (
        pairs.join(sketch.select(F.col("content").alias("a"), F.col("sketch").alias("sa")), "a")
        .join(sketch.select(F.col("content").alias("b"), F.col("sketch").alias("sb")), "b")
        .where(agreement >= agree).select("a", "b")
    )
    likely = written(likely, "likely_pairs")
    named = contents.select("content", "id").join(likely.select(F.explode(F.array("a", "b")).alias("content")).distinct(), "content", "left_semi")
    named = written(named, "contents_to_read")
    rows = documents.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).alias("text")).where("text is not null")
    few = named.count() <= MOST_BROADCAST
    texts = rows.join(F.broadcast(named) if few else named, "id").select("content", "text").dropDuplicates(["content"])
    sets = texts.mapInPandas(_exact_sets(length), "content long, parts array<long>")
    both = (
        likely.join(sets.select(F.col("content").alias("a"), F.col("parts").alias("pa")), "a")
        .join(sets.select(F.col("content").alias("b"), F.col("parts").alias("pb")), "b")
    )
    shared = F.size(F.array_intersect("pa", "pb"))
    similarity = shared / (F.size("pa") + F.size("pb") - shared)
    exact = both.select(F.col("a").alias("content_a"), F.col("b").alias("content_b"), similarity.alias("similarity"))
    return members, written(exact.where(F.col("similarity") >= least), "links")


def record_pairs(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs ``id_a < id_b`` of records with linked contents or the same content."""
    a, b = members.select(F.col("content").alias("content_a"), F.col("id").alias("x")), members.select(F.col("content").alias("content_b"), F.col("id").alias("y"))
    across = linked.join(a, "content_a").join(b, "content_b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b")
    repeated = members.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    same = members.join(repeated, "content")
    within = same.select("content", F.col("id").alias("id_a")).join(same.select("content", F.col("id").alias("id_b")), "content").where("id_a < id_b").select("id_a", "id_b")
    return across.union(within)


def groups(members: DataFrame, linked: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``id, group_id, n_links``: records in one group are connected by links. group_id is the least content of the group and
    n_links the number of linked contents. Labels run to the least neighbour and then to the label's own label, so that rounds
    grow with the logarithm of the longest chain; each round's labels are written."""
    both = linked.select(F.col("content_a").alias("u"), F.col("content_b").alias("v"))
    edges = written(both.union(both.select("v", "u")), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        closer = labels.join(near, "u").select("u", "label", F.least("label", "near").alias("least"))
        jumped = closer.join(labels.select(F.col("u").alias("least"), F.col("label").alias("further")), "least", "left")
        step = written(jumped.select("u", F.least("least", F.coalesce("further", "least")).alias("label"), (F.least("least", F.coalesce("further", "least")) < F.col("label")).alias("moved")), "labels")
        labels = step.select("u", "label")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("groups weren't complete after the last round")
    degree = edges.groupBy("u").agg(F.count("*").alias("n_links"))
    info = labels.join(degree, "u").withColumnRenamed("u", "content")
    return members.join(info, "content", "left").select("id", F.coalesce("label", "content").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
