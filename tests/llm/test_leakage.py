"""Suffix arrays of shards against plain search, with long items, many items and passages that everybody has."""

import random

import numpy as np

from quern.llm import leakage


def test_long_items_and_hot_passages(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    long = [rng.choice(words) for _ in range(2000)]
    hot = [rng.choice(words) for _ in range(30)]
    rows = [(i, " ".join(hot[5:25]) if i % 3 == 0 else "nothing here") for i in range(90)] + [(200, "x " + " ".join(long)), (201, " ".join(long[100:1500]) + " y " + " ".join(long[1600:1611]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(hot)), (3, " ".join(hot[:11]))], "item_id int, question string")
    expected = {(i, 2, 20, 0) for i in range(0, 90, 3)} | {(200, 1, 2000, 1), (201, 1, 1400, 0)}
    assert {tuple(r) for r in leakage.leaks(table, items).collect()} == expected
    monkeypatch.setattr(leakage, "MOST_WORDS", 25)  # every item by itself
    assert {tuple(r) for r in leakage.leaks(table, items).collect()} == expected


def test_ids_of_any_type(spark):
    text = " ".join(f"a{i}" for i in range(15))
    table = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc_id string, text string")
    items = spark.createDataFrame([("i", text), ("j", None), (None, text)], "item_id string, question string")
    assert [tuple(r) for r in leakage.leaks(table, items).collect()] == [("d", "i", 15, 0)]


def test_windows_compare_like_their_numbers():
    numbers = np.array([256, 1, 65536, 255, 2, 256, 1], dtype=np.uint32)
    at = np.arange(5)
    heads = leakage.windows(numbers, at, 2)
    assert np.argsort(heads, kind="stable").tolist() == sorted(range(5), key=lambda i: (numbers[i], numbers[i + 1]))


def test_items_are_searched_from_either_side():
    numbers = {w: i + 1 for i, w in enumerate("abcdefgh")}
    items = leakage.Items([(k, list("abcdefgh")[k % 3 :]) for k in range(60)], numbers, 3)
    held = np.array([numbers[w] for w in "bcde"] + [0], dtype=np.uint32)
    p, q, size = leakage.matches(held, np.array([0, 1], dtype=np.int32), items)
    # Items from a and from b hold bcde; those from c hold cde, before which the text has another word than they.
    assert sorted(zip(p.tolist(), (items.owner[q] % 3).tolist(), size.tolist())) == sorted([(0, 0, 4)] * 20 + [(0, 1, 4)] * 20 + [(1, 2, 3)] * 20)
