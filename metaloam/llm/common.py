"""What the operators of this subpackage share: tables, the shared folder, hashing and word splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloam.operators.shared import discard, shared_folder, stored  # noqa: F401  the operators take them from here

#: Rows in an Arrow batch: bounds a Python worker's memory when texts are long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; Spark alone opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Let Python workers get at most BATCH_ROWS rows at once. One bound for all operators of a session, and one that is
    only ever lowered, so a frame that runs later runs with it too.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_sample(df: DataFrame, key: Column, share: Column) -> DataFrame:
    """Rows whose key hashes below ``share`` (0 to 1): the same rows in every run, without a shuffle."""
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 11) / F.lit(float(1 << 53))
    return df.filter(unit < share)


class WordIds(dict):
    """Words (bytes) to hash buckets, filled on demand and emptied when it gets large."""

    LIMIT = 150_000

    def __init__(self, bucket_of):
        super().__init__()
        self.bucket_of = bucket_of

    def __missing__(self, word):
        if len(self) >= self.LIMIT:
            self.clear()
        got = self[word] = self.bucket_of(word)
        return got
