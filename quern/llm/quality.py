"""Problem 1: text statistics of each document, and which documents are lists, tables or junk.

Every line of a text gets votes from noisy labelling functions, each a threshold on a statistic of the line or of
its neighbours and each speaking for one text type. They vote by their own statistic alone and often contradict each other;
how often a function votes when the type is so (its accuracy) and when it isn't, and which functions vote together, is learned
by expectation-maximization from their agreements over all lines of the corpus; no labels are needed. The posterior types of the lines, weighted by characters, give the type of the record.

Expectation-maximization needs only how many characters show each pattern of votes. That table has at most
2 ** len(VOTERS) rows however large the corpus is, so Spark counts it in one aggregation and the fit itself is tiny.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.llm.common import bounded_rows

TYPES = ("prose", "list", "table", "junk")
#: Labelling functions: name and the type for which each speaks. A function's bit in a pattern is its place here.
VOTERS = (
    ("many_words", "prose"), ("common_words", "prose"), ("sentence_end", "prose"), ("lettered", "prose"), ("runs_on", "prose"),
    ("few_words", "list"), ("marker", "list"), ("short_neighbours", "list"), ("glossary", "list"), ("inline_entries", "list"),
    ("same_cells", "table"), ("named_values", "table"), ("columns", "table"),
    ("symbols", "junk"), ("codes", "junk"), ("stretched", "junk"), ("repeated", "junk"), ("garbled", "junk"), ("unconnected", "junk"),
)
STATS = "id string, n_chars long, n_words long, mean_word_length double, symbol_ratio double, line_end_share double, common_word_share double"
SCHEMA = STATS + ", votes array<struct<pattern:int,chars:long>>"

MARK = re.compile(r"\s*(?:[-*•–—‣·▪◦]|\(?[0-9०-९]{1,4}[.)]|\(?[A-Za-z][.)]|[ivxIVX]{1,5}[.)])\s+")
ENDS = tuple(".!?।॥…。")
CLOSERS = "\"'”’»)]*_"
STRETCH = re.compile(r"(.{1,4}?)\1{2,}", re.S)
CODE = re.compile(r"(?=[^\s]*\d)(?=[^\s]*[A-Za-z])[A-Za-z0-9+/=]{5,}$")
PAIR = re.compile(r"[\wऀ-෿][^\s=:|;,]*=[^\s=]|\"[^\"]{1,40}\"\s*:|</?t[dhr]\b")
GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
INNER = re.compile(r"[A-Za-zÀ-ÿ][^\w\s'’.,:;()\[\]\-/&@_*\"+ऀ-෿‌‍]+[A-Za-zÀ-ÿ]|[a-z][A-Z]|[A-Za-z]\d[A-Za-z]|[^\w\s]{2,}[A-Za-z]")
WRONG = re.compile(r"[\x80-\x9f�]|[ÃÂàâ][\x80-\xbf¤¥¦§¨©ª«¬®¯°±²³´µ¶·¸¹º»¼½¾]")
SYMBOL = re.compile(r"[^\w\sऀ-෿‌‍]|_")
DIGIT = re.compile(r"\d")
RULE = frozenset("|-:+= \t")
#: Start of expectation-maximization: how often a voter votes in its own kind of lines, how often one that tells no type from
#: others, how much less than on average one does in kinds of other types, and what the start weighs against the corpus.
OWN, WEAK, OTHER, STARTING = 0.95, 0.5, 0.3, 0.002
#: A voter for a rare type votes at most so often, of its average, in lines of the types that it speaks against.
CHANCE = 0.15
#: Functions that tell lines of any other type from prose, but not these types from each other. (That a text repeats itself says
#: nothing of whether its lines are sentences.)
BROKEN = ("few_words", "short_neighbours")
SENTENCE = re.compile(r"[.!?।॥\n]+")
ENTRY = re.compile(r"[,;|]\s+")
DELIMITERS = "|\t;,"
STRIP = ".,;:!?\"'()[]{}«»“”‘’।॥-–—*_#¿¡…"


WIDTH = 32
FIELDS = ("known", "noise", "coded", "stretched", "symbols", "digits", "size", "wrong")


class WordCounts(dict):
    """What each word adds to the counts of its line: FIELDS packed into one integer, WIDTH bits each, so that the
    counts of a line are one sum. Words repeat, so most are looked up; the cache is emptied when it is full."""

    def __init__(self, common: frozenset, most: int = 200_000):
        self.common, self.most = common, most

    def __missing__(self, word: str) -> int:
        plain = word.isalpha() and (word.islower() or word[1:].islower())
        symbols = 0 if plain else len(SYMBOL.findall(word))
        digits = 0 if plain else len(DIGIT.findall(word))
        stretch = STRETCH.match(word) if len(word) > 2 else None
        coded = len(word) if not plain and (word.isdigit() or CODE.match(word)) or len(word) > 24 and word.isascii() else 0
        values = (
            word.strip(STRIP).lower() in self.common,
            not plain and INNER.search(word) is not None,
            coded,
            stretch.end() - stretch.start() if stretch else 0,
            symbols,
            digits,
            len(word),
            0 if plain else len(WRONG.findall(word)),
        )
        packed = sum(int(v) << (WIDTH * i) for i, v in enumerate(values))
        if len(self) >= self.most:
            self.clear()
        self[word] = packed
        return packed


def repeated_share(text: str) -> float:
    """Share of the characters of a text in sentences or lines that were there before."""
    seen: set[str] = set()
    again = total = 0
    for part in SENTENCE.split(text):
        part = part.strip().lower()
        if len(part) < 8:
            continue
        total += len(part)
        if part in seen:
            again += len(part)
        seen.add(part)
    return again / total if total else 0.0


def word_repeats(words: list[str]) -> bool:
    """Whether few different words make up a long run of words."""
    return len(words) >= 24 and len(set(words)) < 0.3 * len(words)


def neighbours(values: list, i: int) -> list:
    return [values[j] for j in (i - 1, i + 1) if 0 <= j < len(values)]


def patterns(text: str, counts_of: WordCounts) -> tuple[dict[int, int], tuple]:
    """Characters by pattern of votes, and the statistics of the text."""
    found: Counter = Counter()
    lines = [x for x in text.split("\n") if not x.isspace() and x]
    split = [x.split() for x in lines]
    bare = [len(words) - (MARK.match(line) is not None) for line, words in zip(lines, split)]
    delimiters = [tuple(map(line.count, DELIMITERS)) for line in lines]
    gaps = [len(GAP.findall(line.strip())) if "  " in line or "\t" in line else 0 for line in lines]
    words_all = [w for x in split for w in x]
    again = repeated_share(text) > 0.6 or word_repeats(words_all)
    variety = len(set(words_all)) / max(1, len(words_all))
    different = len(words_all) >= 15 and variety > 0.95
    mask = (1 << WIDTH) - 1
    total, ends = 0, 0
    for i, (line, words, n) in enumerate(zip(lines, split, bare)):
        packed = sum(map(counts_of.__getitem__, words))
        total += packed
        known, noise, coded, stretched, symbols, digits, size, wrong = ((packed >> (WIDTH * k)) & mask for k in range(len(FIELDS)))
        ended = line.rstrip().rstrip(CLOSERS).endswith(ENDS)
        ends += ended
        near, rows = neighbours(bare, i), neighbours(delimiters, i)
        # A row of cells has as many of a delimiter as a neighbour, and its cells are short.
        same = any(k and (at != "," or k > 1 and not ended) and any(r[j] == k for r in rows) and len(words) <= 3 * (k + 1) for j, (at, k) in enumerate(zip(DELIMITERS, delimiters[i])))
        # Columns of single values; sentences with wide spaces between all words have small words or end as sentences do.
        spoken = ended and n >= 6 or known > 0.12 * len(words)
        columns = gaps[i] > 0 and gaps[i] in neighbours(gaps, i) and not spoken
        pairs = len(PAIR.findall(line)) if "=" in line or "<" in line or '"' in line else 0
        named = pairs >= 2 and 3 * pairs >= len(words) or (size > 2 and symbols == size and set(line) <= RULE)
        colon = line.find(":")
        glossary = 0 < colon < len(line.rstrip()) - 1 and n <= 9 and pairs < 2 and line.lstrip()[0] != "#" and len(line[:colon].split()) <= 4
        entries = len(ENTRY.findall(line)) + 1 if sum(delimiters[i]) >= 4 else 1
        inline = entries >= 5 and len(words) <= 4 * entries and known <= 0.2 * len(words)
        symbolic, codes, stretch = symbols > 0.4 * size, coded > 0.5 * size or digits > 0.6 * size, stretched > 0.4 * size
        garbled = noise >= 3 and noise > 0.2 * len(words) or wrong > 0.1 * size
        # A line of cells put one after another: many numbers among the words, and neither small words nor marks.
        bare_line = known <= 0.03 * n and not ended
        columns |= bare_line and n >= 12 and sum(w[:1].isdigit() for w in words) >= 0.15 * n and 2 * digits < size
        # Sentences need small words and marks; a long line without either, of words all different or of names among others, says nothing.
        unconnected = bare_line and n >= 5 and symbols <= 0.03 * size and (different or n >= 12 and sum(w[:1].isupper() for w in words) >= 0.1 * n)
        votes = (
            n >= 6,
            len(words) >= 4 and known >= 0.15 * len(words),
            ended and n >= 5,
            size - symbols - digits >= 0.8 * size and n >= 5 and size < 14 * len(words),
            n >= 5 and max(near, default=0) >= 6 and not ended,
            n <= 5,
            n < len(words) and n <= 7,
            n <= 6 and bool(near) and max(near) <= 6,
            glossary,
            inline,
            same,
            named,
            columns,
            symbolic,
            codes,
            stretch,
            again,
            garbled,
            unconnected,
        )
        found[sum(1 << b for b, v in enumerate(votes) if v)] += len(line)
    known, noise, coded, stretched, symbols, digits, size, wrong = ((total >> (WIDTH * k)) & mask for k in range(len(FIELDS)))
    n_words = sum(map(len, split))
    return found, (len(text), n_words, size / max(1, n_words), symbols / max(1, size), ends / max(1, len(lines)), known / max(1, n_words))


def line_votes(documents: DataFrame, common: frozenset, id_column: str = "id", text_column: str = "text", carry: str | None = None) -> DataFrame:
    """Statistics and vote patterns of each row, by one pass over the whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts_of = WordCounts(common)
        for batch in batches:
            out = []
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                counts, stats = patterns(text or "", counts_of)
                out.append((key, *stats, [{"pattern": p, "chars": c} for p, c in counts.items()]))
            yield pd.DataFrame(out, columns=["id", "n_chars", "n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_word_share", "votes"])

    rows = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string"), F.col(text_column))
    return rows.mapInPandas(run, SCHEMA)


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """The type of the kind of lines that each voter starts, and what a voter (column) says of a kind (row): 0 speaks against it,
    1 for it or neither, 2 for it without telling its type from others."""
    of = np.array([TYPES.index(t) for _, t in VOTERS])
    names = [n for n, _ in VOTERS]
    speaks = (of[None, :] == of[:, None]).astype(int)
    for n in BROKEN:
        speaks[of != TYPES.index("prose"), names.index(n)] = 2
    speaks[names.index("repeated"), of == TYPES.index("prose")] = 1
    return of, speaks


def fit(pattern: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Posterior of each type for each pattern; see ``learned``."""
    return learned(pattern, weight)[0]


def learned(pattern: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each type for each pattern, and how often each voter votes in lines of each type, learned by
    expectation-maximization on the agreements of the voters.

    Voters depend on each other: a text that repeats itself is made of sentences as prose is. So a type has several kinds of
    lines: each voter starts one, of the type for which it speaks, in which it nearly always votes and the other voters as often
    as on average; within a kind votes are independent. Which votes go together in a kind, and so how much a vote says beside
    others, is learned; which type a kind is of stays."""
    votes = (pattern[:, None] >> np.arange(len(VOTERS))) & 1
    of, speaks = kinds()
    share = weight / weight.sum()
    average = np.clip(share @ votes, 0.002, 0.998)
    start = np.where(speaks == 2, WEAK, np.where(speaks == 1, average[None, :], OTHER * average[None, :]))
    np.fill_diagonal(start, OWN)
    prior = np.where(of == 0, 0.7 / (of == 0).sum(), 0.3 / (of != 0).sum())
    fires = start
    posterior = np.zeros((len(pattern), len(VOTERS)))
    for _ in range(rounds):
        score = np.log(prior) + votes @ np.log(fires).T + (1 - votes) @ np.log1p(-fires).T
        posterior = np.exp(score - score.max(1, keepdims=True))
        posterior /= posterior.sum(1, keepdims=True)
        mass = posterior * share[:, None]
        by_kind = mass.sum(0)
        prior = (by_kind + 1e-4) / (by_kind + 1e-4).sum()
        # The start weighs as much as STARTING of all characters, so that a kind that nothing shows stays what it is.
        fires = (mass.T @ votes + STARTING * start) / (by_kind[:, None] + STARTING)
        # A voter for a rare type is better than chance: where it is wrong it votes clearly less often than on average.
        fires = np.clip(np.where((speaks == 0) & (of != 0), np.minimum(fires, CHANCE * average[None, :]), fires), 1e-4, 1 - 1e-4)
    types = np.eye(len(TYPES))[of]
    by_type = types.T @ by_kind
    return posterior @ types, (types.T @ (by_kind[:, None] * fires)) / np.maximum(by_type, 1e-12)[:, None]


def _counted(documents: DataFrame, common_words: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Statistics and votes of each record (written), and the patterns of votes with their characters in the whole corpus."""
    common = frozenset(r[0].lower() for r in bounded_rows(common_words.where("word is not null").select("word").distinct(), 100_000, "common_words"))
    votes = line_votes(documents, common, id_column, text_column)
    votes = written(votes.groupBy("id").agg(F.max(F.struct("n_chars", "n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_word_share", "votes")).alias("s")).select("id", "s.*"), "line_votes")
    counted = votes.select(F.explode("votes").alias("v")).groupBy("v.pattern").agg(F.sum("v.chars").alias("chars")).orderBy("pattern")
    rows = bounded_rows(counted, 2 ** len(VOTERS), "patterns of votes")
    return votes, np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=float)


def text_types(documents: DataFrame, common_words: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """One row for each id: statistics of the text, the share of its characters by posterior type, and ``text_kind``:
    prose, or the strongest of list, table and junk where more than half of the characters aren't prose.

    Null and empty texts have zero statistics and a null kind. Rows sent again count once. Rows without id are no records.
    """
    votes, pattern, weight = _counted(documents, common_words, id_column, text_column)
    posterior = fit(pattern, weight) if len(pattern) else np.zeros((0, len(TYPES)))
    spark = documents.sparkSession
    fitted = spark.createDataFrame([(int(p), *map(float, q)) for p, q in zip(pattern, posterior)], "pattern int, " + ", ".join(f"{t} double" for t in TYPES))
    shares = (
        votes.select("id", F.explode("votes").alias("v")).select("id", "v.pattern", "v.chars")
        .join(F.broadcast(fitted), "pattern")
        .groupBy("id").agg(*(F.sum(F.col(t) * F.col("chars")).alias(f"c_{t}") for t in TYPES), F.sum("chars").alias("c_all"))
    )
    share = {t: F.col(f"c_{t}") / F.col("c_all") for t in TYPES}
    best = F.greatest(*(share[t] for t in TYPES[1:]))
    kind = F.when(F.col("c_all").isNull(), None).when(share["prose"] >= 0.5, "prose").when(share["table"] == best, "table").when(share["list"] == best, "list").otherwise("junk")
    return votes.drop("votes").join(shares, "id", "left").select("id", "n_chars", "n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_word_share", *(share[t].alias(f"{t}_share") for t in TYPES), kind.alias("text_kind"))


def voters(documents: DataFrame, common_words: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """``voter, speaks_for, text_type, rate, chars, conflicting_chars``: how often each labelling function was learned to vote in
    lines of each type, the characters of the lines with its vote, and those among them where functions for other types vote too."""
    _, pattern, weight = _counted(documents, common_words, id_column, text_column)
    rows = []
    if len(pattern):
        _, rates = learned(pattern, weight)
        votes = ((pattern[:, None] >> np.arange(len(VOTERS))) & 1).astype(bool)
        of = np.array([TYPES.index(t) for _, t in VOTERS])
        types = np.stack([(votes & (of == t)).any(1) for t in range(len(TYPES))], 1).sum(1)
        for v, (name, speaks_for) in enumerate(VOTERS):
            chars, conflicting = int(weight[votes[:, v]].sum()), int(weight[votes[:, v] & (types > 1)].sum())
            rows += [(name, speaks_for, t, float(rates[k, v]), chars, conflicting) for k, t in enumerate(TYPES)]
    return documents.sparkSession.createDataFrame(rows, "voter string, speaks_for string, text_type string, rate double, chars long, conflicting_chars long")
