"""Problem 9: held-out items inside training texts, by suffix arrays of the corpus.

The corpus is cut into shards (the batches of a scan); no document spans two. A match can only lie in a run of at least
``least`` words that all occur in some item, so a shard's suffix array holds the suffixes of such runs only: nothing is lost,
and most text never enters it. The arrays are a table, written once, and small beside the corpus; any items of the same words
are searched in it without reading the corpus again.

Every suffix of every item is searched in every shard's array by bisection for the range of corpus suffixes that begin with its
first ``least`` words (shards and items bisect the shorter in the longer first, so a shard pays for what it holds); each is
compared on, all at once, for the longest verbatim match. Items go to the tasks as one string of words' numbers with offsets,
in parts of at most MOST_WORDS words; nothing but the matches is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.llm.common import bounded_rows

WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}‌‍]+")
#: Markup tags and character entities, which stand between words.
MARKUP = regex.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});", regex.S)
MOST_ITEMS = 200_000
#: Words of items that a task holds at a time (48 bytes for the beginning of each suffix); larger sets of items are searched in parts.
MOST_WORDS = 2_000_000


def words_of(text: str) -> list[str]:
    if "<" in text or "&" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.lower())


def windows(numbers: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The ``least`` numbers from each place, as strings that compare like them."""
    return np.ascontiguousarray(numbers[at[:, None] + np.arange(least)].astype(">u4")).view(f"S{4 * least}").ravel()


class Items:
    """Items as one string of words' numbers, each ended by 0, and their suffixes of at least ``least`` words in order."""

    def __init__(self, rows: list[tuple], numbers: dict[str, int], least: int):
        self.least, self.ids = least, [r[0] for r in rows]
        codes, owners, ends = [], [], []
        for i, (_, words) in enumerate(rows):
            codes.extend([numbers[w] for w in words])
            codes.append(0)
            owners.append(np.full(len(words) + 1, i, dtype=np.int32))
            ends.append(np.full(len(words) + 1, len(codes) - 1, dtype=np.int64))
        self.numbers = np.array(codes, dtype=np.uint32)
        owner, end = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (owners, ends))
        at = np.flatnonzero(end - np.arange(len(codes)) >= least)
        heads = windows(self.numbers, at, least)
        order = np.argsort(heads, kind="stable")
        self.heads, self.at = heads[order], at[order]
        self.owner = owner


def _shards(numbers, least: int):
    """A row for each batch with runs of item words: its documents, and of each run the document, its place there and the numbers of
    its words, each run ended by 0; the suffixes of the runs in the order of their first ``least`` words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = numbers.value.get
        for batch in batches:
            starts, codes = [], []
            for text in batch.iloc[:, 1]:
                starts.append(len(codes))
                codes.extend([get(w, 0) for w in words_of(text)])
                codes.append(0)
            found = np.array(codes, dtype=np.uint32)
            breaks = np.flatnonzero(found == 0)
            begins = np.concatenate([[0], breaks[:-1] + 1]).astype(np.int64) if len(breaks) else np.zeros(0, dtype=np.int64)
            long = breaks - begins >= least
            if not long.any():
                continue
            begins, breaks = begins[long], breaks[long]
            document = np.searchsorted(starts, begins, side="right") - 1
            lengths = breaks - begins + 1
            first = np.cumsum(lengths) - lengths
            held = np.concatenate([found[b : e + 1] for b, e in zip(begins, breaks)])
            at = np.concatenate([np.arange(s, s + n - least) for s, n in zip(first, lengths)])
            order = np.argsort(windows(held, at, least), kind="stable")
            some, document = np.unique(document, return_inverse=True)
            yield pd.DataFrame({
                "docs": [batch.iloc[some, 0].tolist()], "document": [document.astype(np.int32).tobytes()], "place": [(begins - np.array(starts)[some[document]]).astype(np.int32).tobytes()],
                "first": [first.astype(np.int32).tobytes()], "numbers": [held.astype(np.uint32).tobytes()], "suffixes": [at[order].astype(np.int32).tobytes()],
            })

    return run


def suffix_arrays(documents: DataFrame, numbers, least: int, id_column: str, text_column: str) -> DataFrame:
    """The shards' suffix arrays, written. numbers: the items' words with their numbers, broadcast."""
    kind = documents.schema[id_column].dataType.simpleString()
    rows = documents.where(F.col(id_column).isNotNull() & F.col(text_column).isNotNull()).select(id_column, text_column)
    return written(rows.mapInPandas(_shards(numbers, least), f"docs array<{kind}>, document binary, place binary, first binary, numbers binary, suffixes binary"), "suffix_arrays")


def matches(held: np.ndarray, suffixes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the shard, place in the items, and words, of each left-maximal match of at least ``least`` words."""
    least, none = items.least, np.zeros(0, dtype=np.int64)
    heads = windows(held, suffixes, least)
    sought, at = items.heads, items.at
    if len(sought) > 16 * len(heads):
        # Few suffixes here: only the items' suffixes that begin as one of them.
        own = np.unique(heads)
        low, high = np.searchsorted(sought, own, side="left"), np.searchsorted(sought, own, side="right")
        which = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low) + np.arange((high - low).sum())
        sought, at = sought[which], at[which]
    if not len(sought) or not len(heads):
        return none, none, none
    low, high = np.searchsorted(heads, sought, side="left"), np.searchsorted(heads, sought, side="right")
    n = high - low
    p = suffixes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
    q = np.repeat(at, n)
    # The match that begins one word earlier is longer; runs and items begin after a 0, which is no word.
    before = np.where(p > 0, held[p - 1], 0)
    left = (before == 0) | (before != np.where(q > 0, items.numbers[q - 1], 0))
    p, q = p[left], q[left]
    size, alive = np.full(len(p), least, dtype=np.int64), np.arange(len(p))
    while len(alive):
        a, b = held[p[alive] + size[alive]], items.numbers[q[alive] + size[alive]]
        alive = alive[(a == b) & (a != 0)]
        size[alive] += 1
    return p, q, size


def _search(items):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sought: Items = items.value
        for batch in batches:
            for docs, document, place, first, numbers, suffixes in batch.itertuples(index=False, name=None):
                document, place, first, suffixes = (np.frombuffer(x, np.int32) for x in (document, place, first, suffixes))
                p, q, size = matches(np.frombuffer(numbers, np.uint32), suffixes, sought)
                run_of = np.searchsorted(first, p, side="right") - 1
                owner = sought.owner[q]
                yield pd.DataFrame({"doc_id": [docs[d] for d in document[run_of]], "item_id": [sought.ids[i] for i in owner], "words": size.astype(np.int32), "place": (place[run_of] + p - first[run_of]).astype(np.int32)})

    return run


def in_parts(rows: list[tuple[object, list[str]]], most: int) -> list[list[tuple[object, list[str]]]]:
    """The items in parts of at most ``most`` words; a longer item is a part of its own."""
    parts, held = [[]], 0
    for r in rows:
        if held and held + len(r[1]) > most:
            parts.append([])
            held = 0
        parts[-1].append(r)
        held += len(r[1])
    return parts


def leaks(documents: DataFrame, items: DataFrame, least: int = 12, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "question") -> DataFrame:
    """``doc_id, item_id, words, place``: each document with at least ``least`` words in a row from an item, the longest such
    match (of equal ones the first) and where it begins. Words are compared in lower case; punctuation, spacing, markup tags
    and character entities between them don't count. Null texts and items, and items with fewer words, match nothing.
    """
    context = documents.sparkSession.sparkContext
    rows = bounded_rows(items.where(F.col(item_column).isNotNull() & F.col(item_text).isNotNull()).select(item_column, item_text), MOST_ITEMS, "the items")
    split = [(r[0], words_of(r[1])) for r in rows]
    split = [(i, w) for i, w in split if len(w) >= least]
    numbers = {w: n + 1 for n, w in enumerate(sorted({w for _, words in split for w in words}))}
    kinds = documents.schema[id_column].dataType.simpleString(), items.schema[item_column].dataType.simpleString()
    shards = suffix_arrays(documents, context.broadcast(numbers), least, id_column, text_column)
    schema, found = f"doc_id {kinds[0]}, item_id {kinds[1]}, words int, place int", None
    for part in in_parts(split, MOST_WORDS):
        matched = shards.mapInPandas(_search(context.broadcast(Items(part, numbers, least))), schema)
        found = matched if found is None else found.union(matched)
    best = F.max(F.struct("words", (-F.col("place")).alias("back"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("m.words").alias("words"), (-F.col("m.back")).alias("place"))


def unaffected(documents: DataFrame, found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The documents without a leak."""
    return documents.join(found.select(F.col("doc_id").alias(id_column)).distinct(), id_column, "left_anti")
