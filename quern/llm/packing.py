"""Problem 8: filling containers of fixed capacity with texts measured in tokens.

A text longer than the capacity fills whole containers; only its last part is packed with others. Parts are spread over
shards by a hash of their id, each shard holding about SHARD_CONTAINERS containers, so that a shard fits one task at any
corpus size and no value of the data can make one hot. Within a shard parts go to the fullest container that takes them,
longest first; then a local search exchanges one part for one or two, or moves one, between underfull containers whenever
that raises the sum of squared fills, until containers empty. What is left in badly filled containers of all shards is
packed once more, in fewer shards.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import written

SHARD_CONTAINERS = 800
SHARD_ITEMS = 20_000
LEFTOVER_FILL = 0.98
#: Partner containers that the local search tries for each underfull one.
TRIES = 40


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers: longest first, each into the fullest container with room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room, container), sorted
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect.bisect_left(room, (sizes[item], -1))
        if at == len(room):
            bins.append([item])
            left, where = capacity - sizes[item], len(bins) - 1
        else:
            left, where = room.pop(at)
            bins[where].append(item)
            left -= sizes[item]
        bisect.insort(room, (left, where))
    return bins


def _better(full: list[int], poor: list[int], sizes: list[int], room: int) -> tuple[list[int], list[int]] | None:
    """Items to take from the poorer container and to give back for them, filling the fuller one most; None if nothing helps."""
    best, change = 0, None
    by_size = sorted((sizes[i], i) for i in poor)
    values = [s for s, _ in by_size]
    at = bisect.bisect_right(values, room)
    if at:
        best, change = values[at - 1], ([by_size[at - 1][1]], [])
    for a in full:
        most = sizes[a] + room
        at = bisect.bisect_right(values, most)
        if at and values[at - 1] - sizes[a] > best:
            best, change = values[at - 1] - sizes[a], ([by_size[at - 1][1]], [a])
        low, high = 0, len(values) - 1
        while low < high:
            pair = values[low] + values[high]
            if pair > most:
                high -= 1
            else:
                if pair - sizes[a] > best:
                    best, change = pair - sizes[a], ([by_size[low][1], by_size[high][1]], [a])
                low += 1
    return change


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Raises the sum of squared fills by moves and exchanges between underfull containers, emptying the poorest."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    order = sorted((k for k in range(len(bins)) if fill[k] < capacity), key=lambda k: -fill[k])
    first, last = 0, len(order) - 1
    while first < last:
        full = order[first]
        for poor in order[max(first + 1, last - TRIES) : last + 1][::-1]:
            while fill[full] < capacity and bins[poor]:
                if fill[poor] > fill[full]:
                    break
                change = _better(bins[full], bins[poor], sizes, capacity - fill[full])
                if change is None:
                    break
                taken, given = change
                bins[full] = [i for i in bins[full] if i not in given] + taken
                bins[poor] = [i for i in bins[poor] if i not in taken] + given
                moved = sum(sizes[i] for i in taken) - sum(sizes[i] for i in given)
                fill[full] += moved
                fill[poor] -= moved
            if fill[full] == capacity:
                break
        first += 1
        while last > first and not bins[order[last]]:
            last -= 1
    return [b for b in bins if b]


def _packer(capacity: int, name: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tokens", "doc_id", "part"], kind="stable").reset_index(drop=True)
        sizes = group["tokens"].tolist()
        bins = local_search(best_fit(sizes, capacity), sizes, capacity)
        where, fill = [0] * len(sizes), [0] * len(sizes)
        for k, items in enumerate(bins):
            total = sum(sizes[i] for i in items)
            for i in items:
                where[i], fill[i] = k, total
        shard = group["shard"].iloc[0]
        return group.assign(container=[f"{name}-{shard}-{k}" for k in where], fill=fill)[["doc_id", "part", "tokens", "container", "fill"]]

    return run


def fill_containers(counts: DataFrame, capacity: int = 2048, id_column: str = "doc_id", tokens_column: str = "n_tokens", seed: int = 8) -> DataFrame:
    """``doc_id, part, tokens, container, fill``: one row for each part of a document; only documents above the capacity have several.

    Documents without tokens (or with a null count) take no room: one row with a null container. Rows without id are
    no documents. Equal ids are packed as parts of their own rows, so ids should be unique.
    """
    items = counts.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(tokens_column), F.lit(0)).cast("long").alias("n"))
    items = written(items, "items")
    kind = items.schema["doc_id"].dataType.simpleString()
    empty = items.where("n <= 0").select("doc_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("string").alias("container"), F.lit(0).cast("long").alias("fill"))
    parts = items.where("n > 0").select("doc_id", F.posexplode(F.expr(f"transform(sequence(1, cast(ceil(n / {capacity}) as int)), k -> least({capacity}, n - (k - 1) * {capacity}))")).alias("part", "tokens"))
    whole = parts.where(F.col("tokens") == capacity).select("doc_id", "part", "tokens", F.concat(F.lit("w-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("part")).alias("container"), F.col("tokens").alias("fill"))
    rest = parts.where(F.col("tokens") < capacity)
    total, number = rest.agg(F.sum("tokens"), F.count("*")).first()
    shards = max(1, -(-(total or 0) // (capacity * SHARD_CONTAINERS)), -(-number // SHARD_ITEMS))
    schema = f"doc_id {kind}, part int, tokens long, container string, fill long"

    def packed(rows: DataFrame, n: int, name: str) -> DataFrame:
        sharded = rows.select("doc_id", "part", "tokens", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "part"), F.lit(n)).alias("shard"))
        return sharded.groupBy("shard").applyInPandas(_packer(capacity, name), schema)

    first = written(packed(rest, shards, "a"), "packed")
    if shards == 1:
        return first.unionByName(whole).unionByName(empty)
    good = F.col("fill") >= LEFTOVER_FILL * capacity
    left = first.where(~good)
    total, number = left.agg(F.sum("tokens"), F.count("*")).first()
    again = max(1, -(-(total or 0) // (capacity * SHARD_CONTAINERS)), -(-number // SHARD_ITEMS))
    return first.where(good).unionByName(packed(left.select("doc_id", "part", "tokens"), again, "b")).unionByName(whole).unionByName(empty)
