"""Functions that no built-in expresses, over Arrow batches."""

from __future__ import annotations

import html
import unicodedata
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Unicode normalization form C."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def unescaped(texts: pd.Series) -> pd.Series:
    """HTML entities as the characters they stand for."""
    return texts.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


@F.pandas_udf(DoubleType())
def compression(texts: pd.Series) -> pd.Series:
    """Compressed bytes for each byte; null for an empty text."""

    def one(t):
        raw = t.encode() if t else b""
        return len(zlib.compress(raw)) / len(raw) if raw else None

    return texts.map(one)
