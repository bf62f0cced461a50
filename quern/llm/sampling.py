"""Problem 7: samples whose categories match target shares, by raking.

Only the sizes of the cells (combinations of the plans' categories) are needed to rake: a table bounded by the targets.
Iterative proportional fitting over the margins of a plan gives each cell its expected size, never above what it has, and so
each of its records a weight; whole quotas follow by largest remainders, and minimums are repaired by taking from the other
categories in proportion to what they can spare. Each cell then takes its quota of records with the least exponential keys
-ln(u) / weight. As a cell's records have one weight, the key decides within cells and the quotas across them; drawing by key
alone would leave every share its sampling error.

A cell's bound for u, above its quota by six standard errors, lets only about as many records through as are drawn, and the
counts afterwards prove that they are enough (or all are taken). Of these the last key is found from counts by key range, so
no cell, however large, is sorted: only its records within one of RANGES key ranges are.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.checkpoints import written
from quern.llm.common import bounded_rows, unit

FIELDS = ("domain", "language", "band")
MOST_TARGETS, MOST_CELLS = 100_000, 1_000_000
#: Quotas by plan and cell (under 100 bytes each) that are broadcast; more are joined by shuffle.
MOST_BROADCAST = 200_000
RANGES = 4096
ROUNDS = 200


def _coded(cells: list[tuple], fields: int) -> tuple[list[list], list[np.ndarray]]:
    """Categories of each field, and each cell's place among them."""
    named = [sorted({c[i] for c in cells}, key=str) for i in range(fields)]
    places = [{k: j for j, k in enumerate(n)} for n in named]
    return named, [np.array([places[i][c[i]] for c in cells], dtype=np.int64) for i in range(fields)]


def rake(available: dict[tuple, int], margins: list[dict], wanted: int) -> dict[tuple, float]:
    """Expected size of each cell: proportional to what is available, with the margins as near as the cells allow.
    available: records by cell, a cell being the categories of the plan's fields; margins: share by category, a dict for each field."""
    cells = [c for c, n in available.items() if n > 0 and all(c[i] in m for i, m in enumerate(margins))]
    if not cells:
        return {}
    named, codes = _coded(cells, len(margins))
    most = np.array([available[c] for c in cells], dtype=float)
    goals = [np.array([m[k] * wanted for k in names]) for m, names in zip(margins, named)]
    size = most.copy()
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, goals):
            now = np.bincount(code, weights=size, minlength=len(goal))
            size = np.minimum(size * np.where(now > 0, goal / np.maximum(now, 1e-300), 0.0)[code], most)
            worst = max(worst, np.abs(np.bincount(code, weights=size, minlength=len(goal)) - now).max())
        if worst < 1e-6 * max(1, wanted):
            break
    return dict(zip(cells, size.tolist()))


def topped_up(size: dict[tuple, float], available: dict[tuple, int], wanted: int) -> dict[tuple, float]:
    """What short categories leave of the sample is spread over the other cells in proportion to their expected sizes. Cells
    that the plan gives nothing stay at nothing."""
    cells = list(size)
    now, most = np.array([size[c] for c in cells]), np.array([available[c] for c in cells], dtype=float)
    for _ in range(ROUNDS):
        gap, free = wanted - now.sum(), (now < most) & (now > 0)
        if gap < 0.5 or not free.any():
            break
        now[free] *= 1 + gap / now[free].sum()
        now = np.minimum(now, most)
    return dict(zip(cells, now.tolist()))


def whole(size: dict[tuple, float], available: dict[tuple, int], wanted: int) -> dict[tuple, int]:
    """Whole quotas with the same sum, rounded, by largest remainders."""
    quota = {c: min(math.floor(x), available[c]) for c, x in size.items()}
    left = min(wanted, round(sum(size.values()))) - sum(quota.values())
    for c in sorted(size, key=lambda c: (quota[c] - size[c], str(c))):
        if left <= 0:
            break
        if quota[c] < available[c]:
            quota[c] += 1
            left -= 1
    return quota


def _spread(total: int, limits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Whole parts of ``total`` in proportion to the weights, none above its limit; less than total only if all are at theirs."""
    parts = np.zeros(len(limits), dtype=np.int64)
    while (left := total - int(parts.sum())) > 0:
        free = (parts < limits) & (weights > 0)
        if not free.any():
            break
        share = np.where(free, weights, 0.0) * (left / weights[free].sum())
        step = np.minimum(np.floor(share).astype(np.int64), limits - parts)
        if not step.any():
            step[np.flatnonzero(free)[np.argsort(-share[free], kind="stable")[:left]]] = 1
        parts += step
    return parts


def repair(quota: dict[tuple, int], available: dict[tuple, int], minimums: list[dict], wanted: int) -> dict[tuple, int]:
    """Raises categories to their minimums, from the least up, as far as they have records and the sample has room or others can
    spare. What a category gets comes from the others' cells in proportion to their size, none of whose categories goes below
    its own minimum; its own cells grow in proportion to the records they have left."""
    if not quota:
        return quota
    cells = sorted(quota, key=str)
    named, codes = _coded(cells, len(minimums))
    now, most = np.array([quota[c] for c in cells], dtype=np.int64), np.array([available[c] for c in cells], dtype=np.int64)
    floors = [np.array([m.get(k, 0) for k in names], dtype=np.int64) for m, names in zip(minimums, named)]
    for i, least in enumerate(minimums):
        for category in sorted((k for k in least if k in named[i]), key=lambda k: (least[k], str(k))):
            mine = codes[i] == named[i].index(category)
            need = min(int(least[category] - now[mine].sum()), int((most - now)[mine].sum()))
            if need <= 0:
                continue
            got = min(need, max(0, wanted - int(now.sum())))
            # Several margins: cells give as much as the tightest of their categories has left, category by category.
            while got < need:
                spare = np.where(mine, 0, now)
                for code, floor in zip(codes, floors):
                    total = np.bincount(code, weights=now, minlength=len(floor)).astype(np.int64)
                    for k in np.unique(code[spare > 0]):
                        of = (code == k) & (spare > 0)
                        spare[of] = _spread(min(int(spare[of].sum()), max(0, int(total[k] - floor[k]))), spare[of], spare[of].astype(float))
                given = _spread(need - got, spare, spare.astype(float))
                if not given.any():
                    break
                now -= given
                got += int(given.sum())
            left = np.where(mine, most - now, 0)
            now += _spread(got, left, left.astype(float))
    return dict(zip(cells, now.tolist()))


def sample(records: DataFrame, targets: DataFrame, seed: int = 7, top_up: bool = False) -> tuple[DataFrame, DataFrame]:
    """The samples and their report.

    Samples: ``plan_id, id`` and the record's fields. Report, a row for each target: records available and drawn, the records
    that the share asks for, the gaps left, whether the category has too few for its share or its minimum, and what the whole
    plan draws and is short of. ``top_up``: what short categories leave of a sample is filled from the plan's other categories
    in proportion to their shares; otherwise the sample stays short.
    Records without a value of a plan's field, or with one that the plan doesn't name, are in none of its categories.
    A null share or minimum counts as 0. Two targets of a plan for one category count as their sum.
    """
    spark = records.sparkSession
    wanted = bounded_rows(targets.select("plan_id", "field_name", "category", "target_share", "min_records", "sample_records"), MOST_TARGETS, "sample_targets")
    named = {f: sorted({r["category"] for r in wanted if r["field_name"] == f and r["category"] is not None}) for f in FIELDS}
    keep = [F.when(F.col(f).isin(named[f]), F.col(f)).alias(f) for f in FIELDS]
    kept = written(records.select("id", *keep), "sample_records")
    cells = {tuple(r[:3]): r[3] for r in bounded_rows(kept.groupBy(*FIELDS).agg(F.count("*").alias("n")), MOST_CELLS, "cells of the samples")}
    plans = defaultdict(list)
    for r in wanted:
        plans[r["plan_id"]].append(r)
    quotas, report = [], []
    for plan, own in sorted(plans.items(), key=lambda x: str(x[0])):
        fields = [f for f in FIELDS if any(r["field_name"] == f for r in own)]
        places = [FIELDS.index(f) for f in fields]
        number = max(r["sample_records"] or 0 for r in own)
        margins: list[dict] = [defaultdict(float) for _ in fields]
        minimums: list[dict] = [defaultdict(int) for _ in fields]
        for r in own:
            i = fields.index(r["field_name"])
            margins[i][r["category"]] += r["target_share"] or 0.0
            minimums[i][r["category"]] += r["min_records"] or 0
        available: dict[tuple, int] = defaultdict(int)
        for c, n in cells.items():
            available[tuple(c[p] for p in places)] += n
        expected = rake(available, margins, number)
        if top_up:
            expected = topped_up(expected, available, number)
        quota = repair(whole(expected, available, number), available, minimums, number)
        plan_drawn = sum(quota.values())
        in_category: list[dict] = [defaultdict(int) for _ in fields]
        drawn: list[dict] = [defaultdict(int) for _ in fields]
        for c, n in available.items():
            for i in range(len(fields)):
                in_category[i][c[i]] += n
                drawn[i][c[i]] += quota.get(c, 0)
        for r in own:
            i, k = fields.index(r["field_name"]), r["category"]
            goal, least = (r["target_share"] or 0.0) * number, r["min_records"] or 0
            has, got = in_category[i].get(k, 0), drawn[i].get(k, 0)
            report.append((plan, r["field_name"], k, r["target_share"], least, number, has, got, goal - got, max(0, least - got), has < goal or has < least, plan_drawn, number - plan_drawn))
        for c, q in quota.items():
            if q > 0:
                full = [None] * len(FIELDS)
                for p, value in zip(places, c):
                    full[p] = value
                quotas.append((plan, *full, *(p in places for p in range(len(FIELDS))), available[c], expected[c] / available[c], q))
    report_frame = spark.createDataFrame(report, "plan_id string, field_name string, category string, target_share double, min_records long, sample_records long, available long, drawn long, share_gap double, minimum_gap long, out_of_reach boolean, plan_drawn long, plan_short long")
    schema = "plan_id string, " + ", ".join(f"c_{f} string" for f in FIELDS) + ", " + ", ".join(f"u_{f} boolean" for f in FIELDS) + ", cell_records long, weight double, quota long"
    quota_frame = spark.createDataFrame(quotas, schema)
    parts = _matched(kept, quota_frame, quotas)
    if parts is None:
        return kept.select(F.lit(None).cast("string").alias("plan_id"), "id", *FIELDS).where("false"), report_frame
    cell = ["plan_id", *(f"c_{f}" for f in FIELDS)]
    u = unit(seed, F.col("plan_id"), F.col("id"))
    bound = F.least(F.lit(1.0), (F.col("quota") + 6 * F.sqrt("quota") + 20) / F.col("cell_records"))

    def keyed(limit) -> DataFrame:
        near = parts.withColumns({"u": u, "bound": limit}).where(F.col("u") <= F.col("bound"))
        key = -F.log1p(-F.col("u")) / F.greatest("weight", F.lit(1e-12))
        return written(near.withColumns({"key": key, "range": F.floor(F.col("u") / F.col("bound") * RANGES)}).drop("cell_records", "weight", "bound"), "sample_keys")

    rows = keyed(bound)
    enough = rows.groupBy(*cell, "quota").agg(F.count("*").alias("n")).where("n >= quota").count()
    if enough < len(quotas):
        rows = keyed(F.lit(1.0))
    counts = rows.groupBy(*cell, "range", "quota").agg(F.count("*").alias("n"))
    upto = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*cell).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = upto.where((F.col("before") < F.col("quota"))).select(*cell, "range", "n", "before", "quota")
    code = F.xxhash64(*cell)
    joined = rows.drop("quota").withColumn("cell", code).join(last.select(code.alias("cell"), "range", "before", "n", "quota"), ["cell", "range"])
    sure = joined.where(F.col("before") + F.col("n") <= F.col("quota"))
    edge = joined.where(F.col("before") + F.col("n") > F.col("quota")).withColumn("place", F.row_number().over(Window.partitionBy("cell", "range").orderBy("key", "id")))
    taken = sure.select("plan_id", "id", *FIELDS).unionByName(edge.where(F.col("before") + F.col("place") <= F.col("quota")).select("plan_id", "id", *FIELDS))
    return taken, report_frame


def _matched(kept: DataFrame, quota_frame: DataFrame, quotas: list[tuple]) -> DataFrame | None:
    """Each record with the cells of the plans that it is in. A plan looks at one to three fields; plans with the same fields are
    joined on them."""
    rows = None
    for used in sorted({tuple(q[4:7]) for q in quotas}):
        mine, condition = quota_frame, F.lit(True)
        for f, u in zip(FIELDS, used):
            mine = mine.where(F.col(f"u_{f}") == F.lit(u))
            if u:
                condition = condition & (F.col(f) == F.col(f"c_{f}"))
        part = kept.join(F.broadcast(mine) if len(quotas) <= MOST_BROADCAST else mine, condition)
        rows = part if rows is None else rows.unionByName(part)
    return rows
