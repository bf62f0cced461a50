"""Sending this package to the executors, which need not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_KEY = "quern.shipped"


def ship(spark: SparkSession) -> None:
    """Adds the package to the files of the application, once. The driver serves the file; executors load it from their copy."""
    if spark.conf.get(_KEY, None) == spark.sparkContext.applicationId:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quern-ship-")) / "quern.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set(_KEY, spark.sparkContext.applicationId)
