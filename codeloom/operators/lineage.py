"""Tables that cut lineage, and folders for tables that a query makes."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def _named(spark: SparkSession) -> str | None:
    """The folder in ``spark.checkpoint.dir``. It has to be set on a cluster; a single machine (``local[...]``) can do without."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/") if folder else None


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path for tables, in the shared folder (on a single machine without one, in a temporary folder)."""
    folder = _named(spark)
    if not folder:
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="codeloom-"))
        folder = _LOCAL[0]
    return f"{folder}/codeloom/{name}-{uuid.uuid4().hex[:12]}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read back, so that it is computed once and survives lost executors.
    On a single machine without such a folder it is persisted instead."""
    spark = df.sparkSession
    if not _named(spark):
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = new_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of steps that are saved (it acts when the driver's heap is collected)."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def measured_broadcasts(spark: SparkSession) -> None:
    """Tables are broadcast by the size that their exchange measured, not by an estimate from files: rows that are made of few or well
    compressed bytes (exploded lines, ids) are estimated at a small part of what they take in memory."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
