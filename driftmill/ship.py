"""Make this package importable in the Python workers of every executor."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="driftmill-ship-")) / "driftmill.zip"
        with zipfile.ZipFile(target, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, str(source.relative_to(root.parent)))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
        assert importlib.util.find_spec("driftmill")
    return spark
