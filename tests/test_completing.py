"""Operators that the given tables exercise too little, and their odd rows."""

import xxhash
from pyspark.sql import functions as F

from quern.functions import formats, measures
from quern.operators.extraction import extracted
from quern.plans import completing


def test_small_changes_of_an_item_are_found(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    changed = words[:39] + ["other"]
    spark.createDataFrame([(1, "b", " ".join(words)), (2, "b", None), (3, "b", "one")], "item_id long, benchmark string, question string").write.parquet(f"{tmp_path}/eval_items.parquet")
    rows = [(10, " ".join(words)), (11, " ".join(changed).upper()), (12, " ".join(words[:20])), (13, None), (14, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r[0], r[1]): r[2] for r in completing.similar_items(spark, str(tmp_path)).collect()}
    assert found == {(10, 1): 1.0, (11, 1): 38 / 40}


def test_hash_order_is_unsigned(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "domain", "band", "text"))).write.parquet(f"{tmp_path}/documents.parquet")
    found = [r["doc_id"] for r in completing.hash_order(spark, str(tmp_path)).orderBy("place").collect()]
    assert found == sorted(range(50), key=lambda i: xxhash.xxh64_intdigest(str(i), seed=42))


def test_later_levels_are_left_out(spark):
    df = spark.createDataFrame([(1, 5), (2, 50), (3, None)], "id int, n int")
    levels = [[("small", F.col("n"), lambda v: v < 10)], [("ratio", F.try_divide(F.lit(100), F.col("n") - 50), lambda v: v > 0), ("double", F.col("n") * 2, None)]]
    rows = {r["id"]: (r["rejected_by"], r["ratio"], r["double"]) for r in extracted(df, levels).collect()}
    assert rows == {1: ("small", None, None), 2: (None, None, 100), 3: (None, None, None)}


def test_conversations_and_lessons_of_odd_fields(spark):
    message = "array<struct<role:string,content:string>>"
    rows = [([("human", " a "), ("gpt", ""), ("assistant", "b")],), ([],), (None,), ([("user", None)],)]
    found = [r[0] for r in spark.createDataFrame(rows, f"m {message}").select(formats.conversation(F.col("m"))).collect()]
    assert found == ["[USER] a\n\n[ASSISTANT] b", None, None, None]
    one = spark.createDataFrame([("t", "", None)], "a string, b string, c string")
    text = one.select(formats.lesson({"Topic": F.col("a"), "Question": F.col("b"), "Answer": F.col("c"), "Estimated Time": F.col("a")}).alias("x")).first()["x"]
    assert text == "### Topic: t\n\n### Metadata:\nEstimated Time: t minutes"


def test_sums_over_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["a"],)], "x array<string>")
    assert [r[0] for r in df.select(measures.sum_over_counts(F.col("x"), lambda n: n * n)).collect()] == [5.0, 0.0, 1.0]
    assert df.limit(0).select(measures.sum_over_counts(F.col("x"), lambda n: n)).count() == 0


def test_bands_of_scores_that_are_there(spark):
    df = spark.createDataFrame([(0.1, None), (None, None), (1.0, 1.0)], "difficulty_score double, readability_score double")
    assert [(r["band_id"], r["band_score"]) for r in completing.band_of_scores(df).collect()] == [("B0", 0.1), ("B2", 0.5), ("B5", 1.0)]
