"""Problem 2: exact token counts of documents under a fixed list of pieces, tokenizing each distinct chunk once.

A text is cut at space, tab, CR and LF; in each chunk the longest piece that matches at the position is taken, or one
character. The count of a chunk depends on the chunk only, so the distinct chunks of the corpus are found first (counted
within each batch before they are shuffled) and tokenized once. The counts of the HOT_CHUNKS most frequent chunks, a table
of bounded size, go to all tasks; a document's other chunks are joined by shuffle with the rest of the table. Both ways are
exact and the frequent chunks, which would be hot join keys, are never shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.llm.common import bounded_rows

CHUNK = re.compile(r"[^ \t\r\n]+")
HOT_CHUNKS = 100_000
MOST_PIECES = 2_000_000


class Greedy:
    """Longest match from the left over a fixed set of pieces."""

    def __init__(self, pieces: frozenset):
        self.pieces = pieces
        by_first: dict[str, set[int]] = {}
        for piece in pieces:
            if piece:
                by_first.setdefault(piece[0], set()).add(len(piece))
        self.lengths = {c: sorted(n, reverse=True) for c, n in by_first.items()}

    def count(self, chunk: str) -> int:
        at = taken = 0
        size = len(chunk)
        while at < size:
            for n in self.lengths.get(chunk[at], ()):
                if chunk[at : at + n] in self.pieces:
                    at += n
                    break
            else:
                at += 1
            taken += 1
        return taken


def chunk_lengths(texts: DataFrame, pieces: DataFrame, text_column: str) -> DataFrame:
    """``chunk, occurrences, tokens`` for every distinct chunk of the texts; written."""
    greedy = Greedy(frozenset(r[0] for r in bounded_rows(pieces.where("piece is not null").select("piece").distinct(), MOST_PIECES, "the list of pieces")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.iloc[:, 0]:
                found.update(CHUNK.findall(text))
            yield pd.DataFrame({"chunk": list(found.keys()), "n": list(found.values())}).astype({"chunk": "object", "n": "int64"})

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tokens=[greedy.count(c) for c in batch["chunk"]])

    found = texts.where(F.col(text_column).isNotNull()).select(text_column).mapInPandas(count, "chunk string, n long")
    distinct = found.groupBy("chunk").agg(F.sum("n").alias("occurrences"))
    return written(distinct.mapInPandas(tokenize, "chunk string, occurrences long, tokens long"), "chunk_lengths")


def token_counts(documents: DataFrame, pieces: DataFrame, id_column: str = "id", text_column: str = "text") -> DataFrame:
    """``id, n_tokens`` for each id, exactly. Null and empty texts have 0 tokens; rows sent again count once (the longest
    text, should they differ); rows without id are no records."""
    spark = documents.sparkSession
    rows = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    lengths = chunk_lengths(rows, pieces, "text")
    hot = lengths.orderBy(F.desc("occurrences"), "chunk").limit(HOT_CHUNKS).select("chunk", "tokens").collect()
    known = spark.sparkContext.broadcast({r[0]: r[1] for r in hot})

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = known.value.get
        for batch in batches:
            ids, counts, chunks, freqs = [], [], [], []
            for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                total, rest = 0, Counter()
                for chunk in CHUNK.findall(text) if text else ():
                    n = get(chunk)
                    if n is None:
                        rest[chunk] += 1
                    else:
                        total += n
                ids.append(key)
                counts.append(total)
                chunks.append(list(rest.keys()))
                freqs.append(list(rest.values()))
            yield pd.DataFrame({"id": ids, "hot_tokens": counts, "chunks": chunks, "freqs": freqs})

    kind = rows.schema["id"].dataType.simpleString()
    parts = written(rows.mapInPandas(split, f"id {kind}, hot_tokens long, chunks array<string>, freqs array<long>"), "document_chunks")
    parts = parts.groupBy("id").agg(F.max(F.struct("hot_tokens", "chunks", "freqs")).alias("p")).select("id", "p.*")
    rest = parts.select("id", F.explode(F.arrays_zip("chunks", "freqs")).alias("c")).select("id", F.col("c.chunks").alias("chunk"), F.col("c.freqs").alias("freq"))
    rare = rest.join(lengths.select("chunk", "tokens"), "chunk").groupBy("id").agg(F.sum(F.col("freq") * F.col("tokens")).alias("rare_tokens"))
    return parts.select("id", "hot_tokens").join(rare, "id", "left").select("id", (F.col("hot_tokens") + F.coalesce("rare_tokens", F.lit(0))).alias("n_tokens"))


def token_budget(documents: DataFrame, pieces: DataFrame, language_labels: DataFrame) -> DataFrame:
    """``source, lang_code, domain, n_documents, n_tokens``: sources trimmed and in lower case, languages by the code of
    their label; a missing value, or a label that names no language, is a group of its own (null)."""
    counts = token_counts(documents, pieces)
    fields = (
        documents.where("id is not null")
        .select("id", F.lower(F.trim("source")).alias("source"), F.col("language").alias("label_text"), "domain")
        .groupBy("id").agg(F.max(F.struct("source", "label_text", "domain")).alias("f")).select("id", "f.*")
    )
    fields = fields.join(F.broadcast(language_labels.select("label_text", "lang_code")), "label_text", "left")
    return fields.join(counts, "id").groupBy("source", "lang_code", "domain").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
