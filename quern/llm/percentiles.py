"""Problem 3: percentiles of very large columns by deterministic buffer collapsing.

A group's values fill sorted buffers of SIZE values. FAN full buffers of one level collapse into one of the next level by
taking every FAN-th of their merged values; a value of level l stands for FAN ** l values. Collapses on one level lose at
most half an output weight of rank each, and a tree of fan FAN has few levels, so the rank error stays below
(levels * n / SIZE + largest weight) / 2. Buffers are rows of a table: those of partitions, days or hosts are combined by
putting them together and collapsing again. Up to FAN * SIZE values a group nothing collapses and results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.checkpoints import written

SIZE, FAN = 512, 8
#: Buffers of so many partitions at most are combined by one task; more are combined in rounds.
MERGE_FAN = 256
PERCENTS = (1, 5, 25, 50, 75, 95, 99)


class Buffers:
    """Buffers of one group. loss: rank that collapses may have moved, in values."""

    def __init__(self):
        self.loose: list[np.ndarray] = []
        self.n_loose = 0
        self.full: dict[int, list[np.ndarray]] = {}
        self.loss = 0.0
        self.collapses = 0

    def add(self, values: np.ndarray) -> None:
        self.loose.append(values)
        self.n_loose += len(values)
        if self.n_loose >= SIZE * FAN:
            self.settle()

    def settle(self) -> None:
        """Cuts loose values into full buffers and collapses every level with FAN of them."""
        if self.n_loose >= SIZE * FAN:
            values = np.concatenate(self.loose)
            whole = len(values) // SIZE * SIZE
            self.full.setdefault(0, []).extend(np.sort(x) for x in np.split(values[:whole], whole // SIZE))
            self.loose, self.n_loose = [values[whole:]], len(values) - whole
        level = 0
        while level <= max(self.full, default=-1):
            while len(self.full.get(level, ())) >= FAN:
                taken = self.full[level][:FAN]
                del self.full[level][:FAN]
                merged = np.sort(np.concatenate(taken))
                # FAN is even: the middle lies between two positions, which are taken in turn.
                start = FAN // 2 - self.collapses % 2
                self.collapses += 1
                self.loss += FAN ** (level + 1) / 2
                self.full.setdefault(level + 1, []).append(merged[start::FAN])
            level += 1

    def rows(self) -> Iterator[tuple[int, np.ndarray]]:
        if self.n_loose:
            yield -1, np.sort(np.concatenate(self.loose))
        for level, buffers in self.full.items():
            for values in buffers:
                yield level, values

    def take(self, level: int, values: np.ndarray) -> None:
        if level < 0:
            self.loose.append(values)
            self.n_loose += len(values)
        else:
            self.full.setdefault(level, []).append(values)

    def answer(self, percents: tuple[int, ...]) -> tuple[int, list[float], float]:
        """Values counted, the value at each percent, and a bound of the rank error."""
        values, weights = [], []
        for level, v in self.rows():
            values.append(v)
            weights.append(np.full(len(v), FAN ** max(level, 0), dtype=np.int64))
        v, w = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(v, kind="stable")
        reached = np.cumsum(w[order])
        n = int(reached[-1])
        ranks = [max(1, (p * n + 99) // 100) for p in percents]
        at = np.searchsorted(reached, ranks)
        largest = int(w.max())
        return n, [float(x) for x in v[order][at]], (self.loss + largest / 2) if largest > 1 else 0.0


KEYS = ("run_id", "metric", "host")
BUFFERS = "run_id string, metric string, part string, slot long, level int, loss double, vals array<double>"
COLUMNS = ["run_id", "metric", "part", "slot", "level", "loss", "vals"]


def _none(x):
    return None if x is None or x != x else x


def buffers(points: DataFrame, group: tuple[str, str, str] = KEYS, value: str = "value") -> DataFrame:
    """Mergeable state: buffers of each group (run, metric and a part such as the host) in each partition. Only finite values
    count; rows count as often as delivered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[tuple, Buffers] = {}
        for batch in batches:
            code, names = np.zeros(len(batch), dtype=np.int64), []
            for i in range(3):
                at, seen = pd.factorize(batch.iloc[:, i], use_na_sentinel=False)
                code = code * max(1, len(seen)) + at
                names.append((at, seen))
            order = np.argsort(code, kind="stable")
            code, values = code[order], batch.iloc[:, 3].to_numpy()[order]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else []
            for s, e in zip(starts, [*starts[1:], len(code)]):
                key = tuple(_none(seen[at[order[s]]]) for at, seen in names)
                if key not in state:
                    state[key] = Buffers()
                state[key].add(values[s:e])
        yield from _frames(state, TaskContext.get().partitionId())

    rows = points.select(*(F.col(g).cast("string") for g in group), F.col(value).cast("double"))
    finite = rows.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return finite.mapInPandas(run, BUFFERS)


def _frames(state: dict[tuple, Buffers], slot: int) -> Iterator[pd.DataFrame]:
    out = []
    for key, s in state.items():
        loss = s.loss
        for level, values in s.rows():
            out.append((*key, slot, level, loss, values))
            loss = 0.0  # the group's loss stands in one of its rows
        if len(out) >= 2000:
            yield pd.DataFrame(out, columns=COLUMNS)
            out = []
    yield pd.DataFrame(out, columns=COLUMNS)


def _joined(rows: list[tuple]) -> Buffers:
    """One state from rows (level, loss, values), whatever their order."""
    state = Buffers()
    for level, _, values in sorted(rows, key=lambda x: (x[0], len(x[2]), x[2][0])):
        state.take(level, values)
    state.loss = float(sum(loss for _, loss, _ in rows))
    state.settle()
    return state


def _by_group(state: DataFrame, keys: list[str], answer, schema: str) -> DataFrame:
    """Rows of ``answer(key, state)`` for each group. Groups come sorted, many to a batch, so that small ones cost little; of a
    group only its buffers are held at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        key, rows, out = None, [], []
        for batch in batches:
            for *now, level, loss, values in batch.itertuples(index=False, name=None):
                now = tuple(map(_none, now))
                if rows and now != key:
                    out.extend(answer(key, _joined(rows)))
                    rows = []
                    if len(out) >= 2000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                key = now
                rows.append((level, loss, values))
        if rows:
            out.extend(answer(key, _joined(rows)))
        if out:
            yield pd.DataFrame(out, columns=names)

    return state.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "level", "loss", "vals").mapInPandas(run, schema)


def merged(state: DataFrame, slots: int) -> DataFrame:
    """The same state with fewer rows: buffers of several slots of a group in one."""

    def merge(key: tuple, joined: Buffers) -> list[tuple]:
        losses = [joined.loss]
        return [(*key, level, losses.pop() if losses else 0.0, values) for level, values in joined.rows()]

    return _by_group(state.withColumn("slot", F.col("slot") % slots), ["run_id", "metric", "part", "slot"], merge, BUFFERS)


def percentiles(state: DataFrame, slots: int, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """``run_id, metric, part, n_finite, p01.., rank_error`` from the buffers of ``slots`` partitions, however they were combined.

    The value at p % is the least with at least p % of the values at or below it, within rank_error ranks. Groups without a
    finite value have no row; a null run, metric or part is a group of its own.
    """
    while slots > MERGE_FAN:
        slots = -(-slots // MERGE_FAN)
        state = merged(state, slots)

    def answer(key: tuple, joined: Buffers) -> list[tuple]:
        n, values, error = joined.answer(percents)
        return [(*key, n, *values, error)]

    schema = "run_id string, metric string, part string, n_finite long, " + ", ".join(f"p{p:02d} double" for p in percents) + ", rank_error double"
    return _by_group(state, ["run_id", "metric", "part"], answer, schema)


def over_all_parts(state: DataFrame, slots: int, parts: int = 64) -> tuple[DataFrame, int]:
    """The state of whole groups, from that of their parts: parts are spread over slots by a hash and then combined as
    partitions are, so a group with very many parts isn't gathered at once."""
    spread = F.col("slot") * parts + F.pmod(F.xxhash64("part"), F.lit(parts))
    return state.select("run_id", "metric", F.lit(None).cast("string").alias("part"), spread.alias("slot"), "level", "loss", "vals"), slots * parts


def group_percentiles(points: DataFrame, group: tuple[str, str, str] = KEYS, value: str = "value", percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """``run_id, metric, scope, host, n_finite, p01.., rank_error``: a row for each run and metric (scope all), and for each of
    its hosts (scope host). Values are read once; the totals are combined from the hosts' buffers."""
    slots = max(1, points.rdd.getNumPartitions())
    state = written(buffers(points, group, value), "buffers")
    total, many = over_all_parts(state, slots)
    columns = ["n_finite", *(f"p{p:02d}" for p in percents), "rank_error"]
    by_part = percentiles(state, slots, percents).select("run_id", "metric", F.lit("host").alias("scope"), F.col("part").alias("host"), *columns)
    return by_part.unionByName(percentiles(total, many, percents).select("run_id", "metric", F.lit("all").alias("scope"), F.col("part").alias("host"), *columns))


def rank_check(points: DataFrame, found: DataFrame, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """``run_id, metric, n_finite, within``: whether every percentile's exact rank lies within its bound, by counting all values."""
    rows = points.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    names = [f"p{p:02d}" for p in percents]
    joined = rows.select(F.col("run_id").alias("r"), F.col("metric").alias("m"), "value").join(found, F.col("r").eqNullSafe(F.col("run_id")) & F.col("m").eqNullSafe(F.col("metric")))
    counts = [F.count(F.when(F.col("value") < F.col(n), 1)).alias(f"below_{n}") for n in names] + [F.count(F.when(F.col("value") <= F.col(n), 1)).alias(f"upto_{n}") for n in names]
    ranked = joined.groupBy("run_id", "metric", "n_finite", "rank_error").agg(*counts, F.count("*").alias("n"))
    within = F.col("n") == F.col("n_finite")
    for p, n in zip(percents, names):
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * p / 100))
        within &= (F.col(f"below_{n}") + 1 - F.col("rank_error") <= rank) & (rank <= F.col(f"upto_{n}") + F.col("rank_error"))
    return ranked.select("run_id", "metric", "n_finite", within.alias("within"))
