"""Makes this package importable by Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_lattica_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lattica-src-"), f"{ROOT.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    sc.addPyFile(path)
    sc._lattica_shipped = True
