"""Incremental batches on Structured Streaming: what is new since the last run, then stop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloam.sources.sinks import stored_or_none


def run_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str) -> int:
    """Read new Parquet files of ``source``, compute rows for keys that ``target`` lacks, append them; returns the batches.

    A batch that is run again after a failure finds its keys done, so each key is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = stored_or_none(spark, target)
        new = batch.dropDuplicates([key])
        transform(new if done is None else new.join(done.select(key), key, "left_anti")).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    return len(stream.recentProgress)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Events per tumbling window and type, with a watermark: the same on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
