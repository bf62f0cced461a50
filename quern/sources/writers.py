"""Writers. Each writes a result once: rejected and accepted rows, bands and sources are partitions of one write."""

from __future__ import annotations

import hashlib
import json
import os
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "overwrite") -> None:
    """zstd Parquet; with partitions, rows are brought together by partition and a salt first, so that files are few and a
    large partition is written by many tasks."""
    if partitions:
        salt = F.pmod(F.xxhash64(*df.columns[:1]), F.lit(8))
        df = df.repartition(*partitions, salt)
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def json_by_source(df: DataFrame, path: str, source: str = "source") -> None:
    df.write.mode("append").option("compression", "gzip").partitionBy(source).json(path)


def in_format(df: DataFrame, path: str, kind: str) -> None:
    """Parquet, JSON lines or CSV."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').format({"jsonl": "json"}.get(kind, kind)).save(path)


def write_blocks(directory: str, blocks: list[list[int]], meta: dict) -> bool:
    """One shard: tokens.bin (uint32), tokens.idx (count, then byte offsets, uint64) and metadata.json, written last.
    False if the shard is there already."""
    done = os.path.join(directory, "metadata.json")
    if os.path.exists(done):
        return False
    os.makedirs(directory, exist_ok=True)
    raw = b"".join(struct.pack(f"<{len(b)}I", *b) for b in blocks)
    offsets, at = [], 0
    for b in blocks:
        offsets.append(at)
        at += 4 * len(b)
    with open(os.path.join(directory, "tokens.bin"), "wb") as f:
        f.write(raw)
    with open(os.path.join(directory, "tokens.idx"), "wb") as f:
        f.write(struct.pack(f"<{len(offsets) + 1}Q", len(offsets), *offsets))
    with open(done + ".part", "w") as f:
        json.dump(meta | {"num_blocks": len(blocks), "sha256": hashlib.sha256(raw).hexdigest()}, f, sort_keys=True)
    os.rename(done + ".part", done)
    return True


def token_shards(df: DataFrame, folder: str, shard: str, tokens: str, block: int) -> DataFrame:
    """Writes the token blocks of each shard to its own directory of a shared folder and gives ``shard, num_blocks, tail, is_new``.

    A shard's rows must fit one task: choose shards by size (``block_spans``). A directory with metadata is complete and is
    skipped, so a lost or repeated task does no harm."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        name = str(group["_shard"].iloc[0])
        stream = [t for row in group.sort_values("_order")["_tokens"] for t in row]
        blocks = [stream[i : i + block] for i in range(0, len(stream) - block + 1, block)]
        new = write_blocks(os.path.join(folder, f"shard={name}"), blocks, {"block_size": block, "shard": name})
        return pd.DataFrame([(name, len(blocks), len(stream) - block * len(blocks), new)], columns=["shard", "num_blocks", "tail", "is_new"])

    rows = df.select(F.col(shard).alias("_shard"), F.col(tokens).alias("_tokens"), F.monotonically_increasing_id().alias("_order") if "order" not in df.columns else F.col("order").alias("_order"))
    return rows.groupBy("_shard").applyInPandas(run, "shard string, num_blocks long, tail long, is_new boolean")
