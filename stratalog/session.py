"""Session helpers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Let Python workers on any machine import this package: an archive of it goes to them with the application's files."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="stratalog-")) / "stratalog_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, f"{package.name}/{file.relative_to(package).as_posix()}")
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark
