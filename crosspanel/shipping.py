"""Executors need this package for the Python parts: it is sent to them once per application, as --py-files would do."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    package = Path(__file__).parent
    path = os.path.join(tempfile.mkdtemp(prefix="crosspanel-"), f"{package.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(path)
    _sent.add(context.applicationId)
