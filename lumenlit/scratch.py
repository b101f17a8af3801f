"""Cutting lineage in a folder that every executor can read.

Iterative operators must not recompute their past, and must survive the loss of
an executor.  A cut is a parquet table below the folder named by
``spark.checkpoint.dir``; only where that setting is absent (tests, notebooks in
local mode) a temporary folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: list[str] = []
_ROOTS: list[str] = []  # folders made by this process and not yet removed


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's, or in local mode our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _FALLBACK:
        holder = tempfile.TemporaryDirectory(prefix="lumenlit-")
        atexit.register(holder.cleanup)
        _FALLBACK.append(holder.name)
    return _FALLBACK[0]


class Scratch:
    """A set of cut tables with one lifetime."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"
        if not _ROOTS:
            atexit.register(release)
        _ROOTS.append(self.root)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a frame that reads it back."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete one cut that no live frame reads any more."""
        _delete(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        """Delete all cuts, once no live frame reads any of them."""
        _delete(self.spark, self.root)
        if self.root in _ROOTS:
            _ROOTS.remove(self.root)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession | None = None) -> int:
    """Delete every cut of this process; the number of folders removed.

    A query's result is lazy and reads its last cuts when it is written, so they
    live as long as the process and go at its end; a process that runs on may
    call this once its results are written.
    """
    spark = spark or SparkSession.getActiveSession()
    gone = 0
    while _ROOTS:
        root = _ROOTS.pop()
        try:
            _delete(spark, root)
            gone += 1
        except Exception:  # noqa: BLE001  the session has ended, and a cluster's shared folder is emptied by its owner
            break
    return gone
