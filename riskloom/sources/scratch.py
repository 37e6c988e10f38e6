"""Paths for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[str] = []
_NAMING = threading.Lock()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a session of one machine that names none gets a temporary folder."""
    with _NAMING:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="riskloom-")
            spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """``df`` written to a new scratch path and read back.

    For tables that several later steps read: plans stay short, however many
    steps build on each other, and a lost executor costs no step before.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_so_far() -> int:
    """A mark for ``release``."""
    return len(_KEPT)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables kept after a mark; for callers that have written or shown all results, as whatever still reads them fails."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    while len(_KEPT) > since:
        where = hadoop.Path(_KEPT.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
