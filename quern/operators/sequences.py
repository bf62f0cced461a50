"""Token offsets and fixed blocks over a total order of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.budgets import with_total_before


def block_spans(df: DataFrame, group: str, order: str, size: str, block: int) -> DataFrame:
    """Adds ``start`` (the document's first place in its group's stream, one end mark after each document), ``first_block`` and
    ``last_block``. ``order`` must be unique in a group."""
    sized = df.withColumn("_size", F.coalesce(F.col(size), F.lit(0)) + 1)
    placed = with_total_before(sized, [group], order, order, "_size", descending=False)
    return placed.withColumns({"start": F.col("before"), "first_block": F.floor(F.col("before") / block), "last_block": F.floor((F.col("before") + F.col("_size") - 1) / block)}).drop("before", "_size")


def block_totals(df: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Full blocks and the tail that doesn't fill one, by group: sums alone."""
    total = F.sum(F.coalesce(F.col(size), F.lit(0)) + 1)
    return df.groupBy(group).agg(total.alias("n_tokens")).select(group, "n_tokens", F.floor(F.col("n_tokens") / block).alias("n_blocks"), (F.col("n_tokens") % block).alias("tail"))


def linear_packs(sizes: list[int], least: int) -> tuple[list[int], int]:
    """Pack number of each document, in order: a pack is closed as soon as it has ``least`` tokens. Also the open pack's tokens."""
    packs, number, held = [], 0, 0
    for n in sizes:
        packs.append(number)
        held += n
        if held >= least:
            number, held = number + 1, 0
    return packs, held


def packed_in_order(df: DataFrame, group: str, order: str, size: str, least: int, lane_tokens: int = 4_000_000) -> DataFrame:
    """``group, order, lane, pack, is_full``: documents of a group put together in order until a pack has ``least`` tokens.

    Where a pack ends depends on all before it, so a group's stream is cut into lanes of about ``lane_tokens`` by running totals,
    each packed by itself; only a lane's last pack may be short."""
    import pandas as pd

    placed = with_total_before(df.select(group, order, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_size")), [group], order, order, "_size", descending=False)
    laned = placed.withColumn("_lane", F.floor(F.col("before") / lane_tokens)).select(F.col(group).alias("_group"), F.col(order).alias("_order"), "_size", "_lane")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_order")
        packs, open_tokens = linear_packs(rows["_size"].tolist(), least)
        last = max(packs)
        full = [p < last or open_tokens == 0 for p in packs]
        return pd.DataFrame({"_group": rows["_group"], "_order": rows["_order"], "lane": rows["_lane"], "pack": packs, "is_full": full})

    kinds = {f.name: f.dataType.simpleString() for f in laned.schema.fields}
    out = laned.groupBy("_group", "_lane").applyInPandas(run, f"_group {kinds['_group']}, _order {kinds['_order']}, lane long, pack long, is_full boolean")
    return out.withColumnsRenamed({"_group": group, "_order": order})
