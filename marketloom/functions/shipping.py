"""Sends this package to Python workers that may not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="marketloom-")) / "marketloom.zip"
        with zipfile.ZipFile(path, "w") as out:
            for f in sorted(root.rglob("*.py")):
                out.write(f, f.relative_to(root.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)
