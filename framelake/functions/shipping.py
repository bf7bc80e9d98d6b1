"""Sends this package to the executors, so that their Python workers can import it wherever the driver runs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="framelake-ship-")) / "framelake_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted((root / "framelake").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
