"""What a session needs before it runs our plans."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package once per application, wherever the driver imports it from."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        archive = Path(tempfile.mkdtemp(prefix="helixlens-")) / "helixlens.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted([*PACKAGE.rglob("*.py"), *PACKAGE.rglob("*.tsv"), *PACKAGE.rglob("*.txt")]):
                z.write(p, Path(PACKAGE.name) / p.relative_to(PACKAGE))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)
    return spark
