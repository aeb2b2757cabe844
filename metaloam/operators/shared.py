"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI below spark.checkpoint.dir.

    Where the setting is missing, a local session (as in tests) uses a folder of the warehouse; on a cluster that is refused,
    since the warehouse may be a folder of one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_metaloam"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    to = shared_folder(spark, purpose)
    df.write.parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._stored_at = to
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the folders of ``stored`` frames that nothing reads any more; other frames are left alone."""
    for df in frames:
        if to := getattr(df, "_stored_at", None):
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(to)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            df._stored_at = None
