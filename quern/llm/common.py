"""Parts that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.sources.readers import table

__all__ = ["bounded_rows", "keyed", "table", "unit"]


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table whose size doesn't grow with the corpus; an error if it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; it is meant to be a fixed table")
    return rows


def keyed(df: DataFrame, key: str, value: str, added: str | None = None) -> DataFrame:
    """One row for each key. Rows sent again hold the same content; where they don't, the latest ``added`` holds.
    Rows without a key are no records."""
    rows = df.where(F.col(key).isNotNull())
    order = F.struct(F.col(added), F.col(value)) if added and added in df.columns else F.struct(F.col(value))
    return rows.groupBy(key).agg(F.max(order).getField(value).alias(value))


def unit(seed: int, *columns: Column | str) -> Column:
    """A number in (0, 1) that depends on the seed and the columns only."""
    bits = F.xxhash64(F.lit(seed), *columns)
    return (F.shiftrightunsigned(bits, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))
