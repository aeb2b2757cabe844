"""Sinks for incremental runs: only what isn't there yet is computed and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append_missing(df: DataFrame, key: str, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute rows for keys that the table at ``path`` lacks, append them, and return the table."""
    spark = df.sparkSession
    done = stored_or_none(spark, path)
    new = df.dropDuplicates([key])
    compute(new if done is None else new.join(done.select(key), key, "left_anti")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def guard_settings(spark: SparkSession, path: str, settings: dict[str, str]) -> None:
    """Write the settings of a run beside its output, or refuse to go on with others."""
    rows = sorted((k, str(v)) for k, v in settings.items())
    done = stored_or_none(spark, path)
    if done is None:
        spark.createDataFrame(rows, "name string, value string").write.parquet(path)
    elif [tuple(r) for r in done.orderBy("name").collect()] != rows:
        raise ValueError("the output was made with other settings")


def by_suffix(df: DataFrame, key: str, path: str, letters: int = 3) -> None:
    """Records partitioned by the last letters of their id, so a keyed lookup reads one folder."""
    df.withColumn("bucket", F.right(F.col(key), F.lit(letters))).write.mode("overwrite").partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, ids: DataFrame, key: str, letters: int = 3) -> tuple[DataFrame, DataFrame]:
    """Rows of the ids in such a table, and the ids that it lacks."""
    wanted = ids.select(key).distinct().withColumn("bucket", F.right(F.col(key), F.lit(letters)))
    found = spark.read.parquet(path).join(wanted, ["bucket", key], "left_semi")
    return found.drop("bucket"), wanted.select(key).join(found.select(key), key, "left_anti")
