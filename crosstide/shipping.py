"""Python workers import this package: it goes to the executors as a zip file through Spark."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="crosstide-code-")) / "crosstide.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
