"""Problem 6: mixing groups of records to target shares by Sainte-Laguë apportionment of equal blocks.

A plan's characters are BLOCKS equal blocks; the highest quotients share / (2 n + 1) give each group a whole number of them. A
group's records are put in a seeded order and cut into blocks of just that many characters by running totals; a record is in
the block in which it begins. The group takes as many of its blocks as it has seats, from a seeded place of the order on and
round again, never more than max_repeats times. So a group that can reach its share misses it by less than a block, if no
record is longer than a block. The mixture goes to SHARDS output shards: each group's blocks are apportioned to them, again by
highest quotients, and the copies of records follow their blocks, so that every shard has the plan's shares.

The running totals are built in ranges of about RANGE_ROWS records, so a group with a third of all records is many ranges.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.llm.common import bounded_rows, unit

BLOCKS, SHARDS = 10_000, 16
RANGE_ROWS = 50_000
MOST_TARGETS = 100_000
#: Rows of range starts (about 100 bytes each) that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 200_000


def sainte_lague(shares: list[float], seats: int) -> list[int]:
    """Whole seats by highest quotients share / (2 n + 1); ties go to the earlier share."""
    got = [0] * len(shares)
    queue = [(-s, i) for i, s in enumerate(shares) if s > 0]
    heapq.heapify(queue)
    for _ in range(seats if queue else 0):
        _, i = queue[0]
        got[i] += 1
        heapq.heapreplace(queue, (-shares[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(seats: list[int], shards: int) -> list[list[int]]:
    """Blocks of each group in each shard: all shards of a plan hold equally many blocks, give or take one, and each group's
    blocks are spread over them by highest quotients, the shards with most room first."""
    held = [0] * shards
    out = []
    for n in seats:
        each, rest = divmod(n, shards)
        row = [each] * shards
        for s in sorted(range(shards), key=lambda s: (held[s], s))[:rest]:
            row[s] += 1
        held = [h + r for h, r in zip(held, row)]
        out.append(row)
    return out


def members(records: DataFrame, fields: tuple[str, ...] = ("source", "dataset", "band")) -> DataFrame:
    """``id, n_chars, field_name, group_key``: a row for each record and each of its values."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("group_key")) for f in fields))
    return records.select("id", "n_chars", F.explode(pairs).alias("g")).select("id", "n_chars", "g.field_name", "g.group_key").where("group_key is not null")


def placed_members(records: DataFrame, targets: DataFrame, seed: int) -> tuple[DataFrame, dict]:
    """Members of the groups that the targets name with ``before``, the characters of the group's records earlier in its seeded
    order; and (characters, records) of each group."""
    names = F.broadcast(targets.select("field_name", "group_key").distinct())
    group = ["field_name", "group_key"]
    within = written(members(records).join(names, group).withColumn("drawn", unit(seed, "group_key", "id")), "members")
    sizes = {(r[0], r[1]): (r[2] or 0, r[3]) for r in within.groupBy(*group).agg(F.sum("n_chars"), F.count("*")).collect()}
    if not sizes:
        return within.withColumn("before", F.lit(0).cast("long")), sizes
    spark = records.sparkSession
    cuts = spark.createDataFrame([(*g, n // RANGE_ROWS + 1) for g, (_, n) in sizes.items()], "field_name string, group_key string, ranges long")
    ranged = within.join(F.broadcast(cuts), group).withColumn("range", F.floor(F.col("drawn") * F.col("ranges"))).drop("ranges")
    totals = ranged.groupBy(*group, "range").agg(F.sum("n_chars").alias("total"))
    starts = totals.select(*group, "range", F.coalesce(F.sum("total").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    if sum(n // RANGE_ROWS + 1 for _, n in sizes.values()) <= MOST_BROADCAST:
        starts = F.broadcast(starts)
    inner = Window.partitionBy(*group, "range").orderBy("drawn", "id").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inner", F.coalesce(F.sum("n_chars").over(inner), F.lit(0)))
    return summed.join(starts, [*group, "range"]).withColumn("before", F.col("start") + F.col("inner")).drop("range", "start", "inner", "drawn"), sizes


def plan_quotas(targets: DataFrame, sizes: dict, seed: int = 6) -> list[tuple]:
    """For each target its plan, field, key, share, most repeats and characters; the group's characters and records; its seats and
    the characters they stand for (never more than its repeats allow), where in its order it begins, and its blocks by shard."""
    wanted = bounded_rows(targets.select("plan_id", "field_name", "group_key", "target_share", "max_repeats", "plan_chars"), MOST_TARGETS, "mix_targets")
    plans = defaultdict(list)
    for r in wanted:
        plans[r["plan_id"]].append(r)
    rows = []
    for plan, own in sorted(plans.items(), key=lambda x: str(x[0])):
        own.sort(key=lambda r: (str(r["field_name"]), str(r["group_key"])))
        seats = sainte_lague([r["target_share"] or 0.0 for r in own], BLOCKS)
        for r, n, by_shard in zip(own, seats, shard_quotas(seats, SHARDS)):
            chars, count = sizes.get((r["field_name"], r["group_key"]), (0, 0))
            total, most = r["plan_chars"] or 0, r["max_repeats"] or 0
            quota = min(chars * most, n * total // BLOCKS)
            start = int(xxhash.xxh64_intdigest(f"{seed} {plan} {r['field_name']} {r['group_key']}") % chars) if chars else 0
            rows.append((plan, r["field_name"], r["group_key"], r["target_share"], most, total, chars, count, n, quota, start, by_shard))
    return rows


QUOTAS = "plan_id string, field_name string, group_key string, target_share double, max_repeats long, plan_chars long, group_chars long, group_records long, seats long, quota long, start long, by_shard array<int>"


def chosen(within: DataFrame, quotas: DataFrame) -> DataFrame:
    """``plan_id, field_name, group_key, id, n_chars, repeats, shards``: the records of each plan, how often each is taken, and to
    which output shard each copy goes.

    Seen from its seeded start, a record begins at ``at``. Its copies are at at, at + group_chars, and so on; those below the
    group's quota are taken. Copy and shard go by the block that a copy is in, as the shards' blocks follow one another. A record
    without characters takes no room and is taken once if its place is.
    """
    at = F.pmod(F.col("before") - F.col("start"), F.col("group_chars"))
    rows = within.join(F.broadcast(quotas.where("quota > 0")), ["field_name", "group_key"]).withColumn("at", at)
    repeats = F.when(F.col("at") < F.col("quota"), F.least(F.col("max_repeats"), F.floor((F.col("quota") - F.col("at") - 1) / F.col("group_chars")) + 1)).otherwise(0)
    taken = rows.withColumn("repeats", repeats.cast("long")).where("repeats > 0")
    return taken.select("plan_id", "field_name", "group_key", "id", "n_chars", "repeats", F.transform(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1), _shard_of).alias("shards"))


def _shard_of(copy: Column) -> Column:
    """The shard whose blocks hold the copy: blocks of the quota are dealt to the shards in turn."""
    block = F.floor((F.col("at") + copy * F.col("group_chars")) / F.greatest(F.lit(1), F.floor(F.col("plan_chars") / BLOCKS)))
    total = F.aggregate("by_shard", F.lit(0), lambda a, x: a + x)
    place = F.least(block, F.greatest(F.lit(0), total - 1))
    # The first shard whose running total of blocks is above the place.
    reached = F.aggregate("by_shard", F.struct(F.lit(0).alias("sum"), F.lit(0).alias("shard")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["shard"] + F.when(a["sum"] + x <= place, 1).otherwise(0)).alias("shard")))
    return F.least(reached["shard"], F.lit(SHARDS - 1))


def mix(documents_records: DataFrame, targets: DataFrame, seed: int = 6) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    Mixture: see ``chosen``. Report, a row for each target: the group's characters and records, its seats of BLOCKS and what they
    are by shard, the characters that the plan takes of it, the share of plan_chars reached and missed, and whether the target is
    out of reach however often records may be repeated. Records without the value are in no group. Groups short of records aren't made up by others. Targets
    with the same plan, field and key count separately. A null share or repeat limit counts as 0.
    """
    within, sizes = placed_members(documents_records, targets, seed)
    quotas = documents_records.sparkSession.createDataFrame(plan_quotas(targets, sizes, seed), QUOTAS)
    mixture = chosen(within, quotas)
    keys = ["plan_id", "field_name", "group_key"]
    reached = mixture.groupBy(keys).agg(F.sum(F.col("n_chars") * F.col("repeats")).alias("taken_chars"), F.max("repeats").alias("most_repeats"))
    report = quotas.join(reached, keys, "left").select(
        *keys, "target_share", "max_repeats", "plan_chars", "group_chars", "group_records", "seats", "by_shard",
        F.coalesce("taken_chars", F.lit(0)).alias("taken_chars"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        (F.coalesce("taken_chars", F.lit(0)) / F.col("plan_chars")).alias("reached_share"),
        (F.col("target_share") - F.coalesce("taken_chars", F.lit(0)) / F.col("plan_chars")).alias("missed_share"),
        (F.col("group_chars") * F.col("max_repeats") < F.col("target_share") * F.col("plan_chars")).alias("out_of_reach"),
    )
    return mixture, report
