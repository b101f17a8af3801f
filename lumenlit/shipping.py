"""Bringing this package to Python workers that cannot import it by themselves."""

from __future__ import annotations

import atexit
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Distribute the package, compiled, to the workers of a session, once an application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    holder = tempfile.TemporaryDirectory(prefix="lumenlit-ship-")  # on the driver only; Spark serves the file to the executors
    atexit.register(holder.cleanup)
    path = Path(holder.name) / "lumenlit.zip"
    with zipfile.PyZipFile(path, "w") as archive:
        archive.writepy(str(Path(__file__).resolve().parent))
    context.addPyFile(str(path))
    _SHIPPED.add(context.applicationId)
