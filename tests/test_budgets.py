"""Running totals against plain loops, where values are distributed badly."""

import random

import pytest

from quern.operators.admission import skip_fit
from quern.operators.budgets import fill, with_total_before

SCHEMA = "g string, o double, t long, n long, before_name string"


def plain(rows, descending):
    out = {}
    key = lambda r: (r[1] is None, (0 if r[1] is None else -r[1] if descending else r[1]), -r[2] if descending else r[2])
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=key):
            out[r[0], r[2]] = total
            total += r[3] or 0
    return out


SHAPES = {
    "outlier": lambda i, rng: 1e12 if i == 0 else rng.random(),
    "equal": lambda i, rng: 7.0,
    "nulls": lambda i, rng: None if i % 3 else float(i % 5),
    "spread": lambda i, rng: rng.uniform(-1, 1) * 10 ** rng.randrange(9),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("descending", [True, False])
def test_totals_match_a_loop(spark, shape, descending):
    rng = random.Random(shape)
    rows = [(rng.choices(["hot", "small", None], [8, 1, 1])[0], SHAPES[shape](i, rng), i, rng.choice([None, 0, 1, 50]), "x") for i in range(400)]
    found = with_total_before(spark.createDataFrame(rows, SCHEMA).repartition(3), ["g"], "o", "t", "n", descending=descending)
    assert set(found.columns) == {"g", "o", "t", "n", "before_name", "before"}
    assert {(r["g"], r["t"]): r["before"] for r in found.collect()} == plain(rows, descending)


@pytest.mark.parametrize("shape", SHAPES)
def test_no_range_holds_a_group(spark, shape):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = [("hot", SHAPES[shape](i, rng), i, 1, "x") for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    cut = df.repartitionByRange(16, "g", F.col("o").desc_nulls_last(), F.col("t").desc_nulls_last()).groupBy(F.spark_partition_id()).count()
    assert max(r["count"] for r in cut.collect()) < 3 * 20_000 / 16


def test_totals_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert with_total_before(empty, ["g"], "o", "t", "n").count() == fill(empty, ["g"], "o", "t", "n", "n").count() == 0


def test_a_tie_value_of_another_group_is_no_obstacle(spark):
    rows = [("a", 3.0, 1, 5, 9), ("a", 2.0, 2, 6, 9), ("a", 1.0, 3, 4, 9), ("b", 3.0, 2, 3, 9), ("b", 2.0, 3, 9, 9), ("b", 1.0, 1, 6, 9)]
    found = skip_fit(spark.createDataFrame(rows, "g string, o double, t long, n long, room long"), "g", "o", "t", "n", "room")
    assert {(r["g"], r["t"]) for r in found.collect()} == {("a", 1), ("a", 3), ("b", 2), ("b", 1)}
