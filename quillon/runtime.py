"""What a session needs besides Spark: this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors' Python workers, once per application, so that none needs it installed."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parent
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quillon-")), "quillon.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return spark
