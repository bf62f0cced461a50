"""The values by which records are mixed and sampled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_source(source: Column) -> Column:
    return F.lower(F.trim(source))


def bands(band_records: DataFrame) -> DataFrame:
    """``id, band``: the band in the row with the latest processed_at (of equal ones that with the greatest uuid)."""
    latest = band_records.where("id is not null").groupBy("id").agg(F.max(F.struct("processed_at", "uuid", "band")).alias("b"))
    return latest.select("id", F.col("b.band").alias("band"))


def records(documents: DataFrame, band_records: DataFrame, language_labels: DataFrame) -> DataFrame:
    """``id, source, dataset, domain, language, band, n_chars``: one row for each id; a missing value is null.

    Rows sent again hold the same content; should they differ, the greatest row counts. Texts are read for their length only.
    """
    rows = documents.where("id is not null").select("id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), normal_source(F.col("source")).alias("source"), "dataset", "domain", F.col("language").alias("label_text"))
    one = rows.groupBy("id").agg(F.max(F.struct("n_chars", "source", "dataset", "domain", "label_text")).alias("r")).select("id", "r.*")
    coded = one.join(F.broadcast(language_labels.select("label_text", F.col("lang_code").alias("language"))), "label_text", "left").drop("label_text")
    return coded.join(bands(band_records), "id", "left")
