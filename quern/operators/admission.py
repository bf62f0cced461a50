"""Greedy choices that depend on what was chosen before."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.operators.budgets import with_total_before

MOST_GROUPS = 100_000
MOST_ROUNDS = 200


def skip_fit(df: DataFrame, group: str, order: str, tie: str, size: str, capacity: str) -> DataFrame:
    """Rows taken from the best down where a row that doesn't fit the group's remaining capacity is skipped.

    In rounds: the rows before the first that doesn't fit are taken at once by running totals, what is larger than the room
    left can never be taken, and the rest goes to the next round with less room. Room falls fast, so rounds are few; the
    groups' room is a small table. Null sizes count as 0; rows of a group without capacity are left out. A tie value must be
    unique in its group.
    """
    spark = df.sparkSession
    rest = written(df.select(group, order, tie, F.coalesce(size, F.lit(0)).cast("long").alias("_size"), F.col(capacity).cast("long").alias("_room")).where("_room IS NOT NULL"), "skip_fit")
    taken = []
    for _ in range(MOST_ROUNDS):
        fitting = rest.where(F.col("_size") <= F.col("_room"))
        placed = written(with_total_before(fitting, [group], order, tie, "_size"), "skip_fit_placed")
        now = placed.where(F.col("before") + F.col("_size") <= F.col("_room"))
        # Only the rows before the first that overflows are sure: a later one may fit exactly because that one is skipped.
        over = placed.where(F.col("before") + F.col("_size") > F.col("_room")).groupBy(F.col(group).alias("_h")).agg(F.min("before").alias("_stop"))
        sure = written(now.join(over, now[group].eqNullSafe(F.col("_h")), "left").drop("_h").where(F.col("_stop").isNull() | (F.col("before") < F.col("_stop")) | ((F.col("before") == F.col("_stop")) & (F.col("_size") == 0))), "skip_fit_taken")
        used = sure.groupBy(group).agg(F.sum("_size").alias("_used"), F.count("*").alias("_n"))
        if used.isEmpty():
            break
        taken.append(sure.select(group, tie))
        done = sure.select(F.col(group).alias("_g"), F.col(tie).alias("_t"))
        left = placed.join(done, placed[group].eqNullSafe(F.col("_g")) & placed[tie].eqNullSafe(F.col("_t")), "left_anti").drop("before")
        used = used.select(F.col(group).alias("_g"), "_used")
        rest = written(left.join(used, F.col(group).eqNullSafe(F.col("_g")), "left").withColumn("_room", F.col("_room") - F.coalesce("_used", F.lit(0))).drop("_g", "_used"), "skip_fit")
        if rest.isEmpty():
            break
    else:
        raise RuntimeError("skip_fit wasn't complete after the last round")
    out = df.select(group, tie).where("false") if not taken else taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return out


def admit(rows: list[tuple], targets: dict, window: int, slack: float) -> list[bool]:
    """Which rows (key, size), in order, enter a rolling window of ``window`` tokens without pushing their key above its target
    share plus ``slack``. While the window fills for the first time all are admitted."""
    held: deque = deque()
    by_key: dict = {}
    total, full, out = 0, False, []
    for key, size in rows:
        new_total = total + size
        ok = not full or (by_key.get(key, 0) + size) <= (targets.get(key, 0.0) + slack) * new_total
        out.append(ok)
        if not ok:
            continue
        held.append((key, size))
        by_key[key] = by_key.get(key, 0) + size
        total = new_total
        while total > window and len(held) > 1:
            full = True
            old, n = held.popleft()
            by_key[old] -= n
            total -= n
    return out


def rolling_admission(df: DataFrame, key: str, order: str, size: str, targets: dict, window: int, slack: float, lanes: int = 16) -> DataFrame:
    """``order`` of the rows that a rolling window admits. The decision for a row depends on all before it, so rows are dealt to
    lanes by a hash of their order, each with its own window of window / lanes: lanes are decided in parallel, each keeps the
    shares and so does their union."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_order")
        return group[admit(list(zip(group["_key"], group["_size"])), targets, max(1, window // lanes), slack)][["_order"]]

    rows = df.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.coalesce(size, F.lit(0)).cast("long").alias("_size")).withColumn("_lane", F.pmod(F.xxhash64("_order"), F.lit(lanes)))
    kind = rows.schema["_order"].dataType.simpleString()
    return rows.groupBy("_lane").applyInPandas(run, f"_order {kind}").withColumnRenamed("_order", order)


def batch_budgets(available: dict[tuple, int], shares: dict, target: int) -> dict[tuple, int]:
    """Budget of each (batch, key) in order of batches: the batch's part of the target by its share of all tokens, split by the
    keys' shares. What a key couldn't take in a batch is carried to its later ones; no key gets more than its whole share."""
    batches = sorted({b for b, _ in available})
    total = sum(available.values())
    left = {k: int(target * s) for k, s in shares.items()}
    carried: dict = dict.fromkeys(shares, 0)
    out = {}
    for b in batches:
        of_batch = sum(n for (i, _), n in available.items() if i == b)
        for k, s in shares.items():
            wanted = min(left[k], int(target * of_batch * s / total) + carried[k]) if total else 0
            got = min(wanted, available.get((b, k), 0))
            out[b, k] = wanted
            carried[k] = wanted - got
            left[k] -= got
    return out


def batched_fill(df: DataFrame, batch: str, key: str, order: str, tie: str, size: str, shares: dict, target: int) -> DataFrame:
    """``batch, key, tie`` of the best rows of each batch under budgets carried from batch to batch.

    Budgets need only what each batch has of each key, a table of batches times keys; rows are then taken in all batches at once."""
    spark = df.sparkSession
    totals = df.where(F.col(key).isin(list(shares))).groupBy(batch, key).agg(F.sum(F.coalesce(size, F.lit(0))).alias("n")).limit(MOST_GROUPS + 1).collect()
    if len(totals) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} batches times keys; make batches larger")
    budgets = batch_budgets({(r[0], r[1]): r[2] for r in totals}, shares, target)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    table = spark.createDataFrame([(b, k, n) for (b, k), n in budgets.items()], f"_b {kinds[batch]}, _k {kinds[key]}, _budget long")
    rows = df.join(F.broadcast(table), (F.col(batch) == F.col("_b")) & (F.col(key) == F.col("_k"))).drop("_b", "_k")
    return with_total_before(rows, [batch, key], order, tie, size).where(F.col("before") < F.col("_budget")).select(batch, key, tie)
