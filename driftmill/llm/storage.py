"""Shared folders for tables that cut lineage and for files that operators write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset, a local session (tests) gets a fresh temporary folder; on a cluster that
    is an error, since a machine-local folder would not be seen by the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="driftmill-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/driftmill/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are broadcast at most: some 30 MB in an executor.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, kind: str) -> DataFrame:
    """``df``, rows of a few numbers, written; to be broadcast if it has BROADCAST_ROWS or fewer.

    Adaptive execution would find out too, but only after the other side of a join had been shuffled.
    """
    df = written(df, kind)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def open_folder(path: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:", "file://", 1))
