"""Sends this package to the executors, so that its Python functions can be loaded there."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Add the package's modules to the application as a zip file, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        name = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
        with zipfile.ZipFile(name, "w") as z:
            for module in sorted(top.rglob("*.py")):
                z.write(module, module.relative_to(top.parent))
        context.addPyFile(str(name))
        _shipped.add(context.applicationId)
    return spark
