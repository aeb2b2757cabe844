"""Token ids of documents as flat binary files.

A data set is a folder of shards. Shard ``k`` has ``<k>.bin`` (token ids, little-endian unsigned 16-bit, or 32-bit where
the vocabulary needs it), ``<k>.idx`` (64-bit unsigned offsets: where each document begins in the shard, and the end)
and ``<k>.doc`` (64-bit document ids). Documents lie in ascending order of doc_id over the shards in their order. The
manifest has one row per shard; the position of a shard's first token is the prefix sum of the shards before it.

Files are written by the tasks straight to the shared folder under a name of their own attempt, and the manifest lists
those of attempts that ended well, so retried or repeated tasks leave no trace in the data set.

Defined results: a null or empty text is a document of the end token alone; texts of any length are encoded whole. Rows with the same doc_id keep one order (by
a hash of the text, then the text); null ids come first and are stored as the least 64-bit number. Extra columns are not
stored. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloam.llm.common import bounded_batches, shared_folder, table
from metaloam.llm.tokens import encoder

NULL_ID = -(1 << 63)
MANIFEST = "shard long, name string, documents long, tokens long"


def _at(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1) -> pd.DataFrame:
    """Write the shards; returns the manifest, with ``first_token`` and ``first_document`` of each shard.

    One shuffle, by ranges of doc_id; the manifest has a row for each of its partitions.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = _at(folder)
        own, encode = None, encoder(tokenizer)
        kind = "<u2" if max(encode.size - 1, end_id) < 1 << 16 else "<u4"
        end, offsets, ids = np.array([end_id], np.uint32), [0], []
        for rows in batches:
            if own is None:
                store.create_dir(path, recursive=True)
                own = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
                out = store.open_output_stream(f"{path}/{own}.bin")
            for doc, own_ids in zip(rows["_id"], encode.encode_batch(list(rows["_text"])), strict=True):
                got = np.concatenate([own_ids, end])
                out.write(got.astype(kind).tobytes())
                offsets.append(offsets[-1] + len(got))
                ids.append(doc)
        if own is not None:
            out.close()
            for suffix, values in (("idx", np.array(offsets, "<u8")), ("doc", np.array(ids, "<i8"))):
                with store.open_output_stream(f"{path}/{own}.{suffix}") as f:
                    f.write(values.tobytes())
            yield pd.DataFrame({"shard": [int(own[:8])], "name": [own], "documents": [len(ids)], "tokens": [offsets[-1]]})

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.col("text").alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    placed = rows.repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie", "_text")
    manifest = placed.select("_id", "_text").mapInPandas(shard, MANIFEST).toPandas().sort_values("shard", ignore_index=True)
    for to, of in (("first_token", "tokens"), ("first_document", "documents")):
        manifest[to] = manifest[of].cumsum() - manifest[of]
    return manifest


class Shard:
    """One shard, memory-mapped where its folder is a local path and read whole otherwise."""

    def __init__(self, folder: str, name: str):
        store, path = _at(folder)

        def values(suffix: str, kind: str) -> np.ndarray:
            where = f"{path}/{name}.{suffix}"
            if store.type_name == "local":
                return np.memmap(where, kind, "r")
            with store.open_input_stream(where) as f:
                return np.frombuffer(f.readall(), kind)

        self.offsets, self.documents = values("idx", "<u8").astype(np.int64), values("doc", "<i8")
        size = store.get_file_info(f"{path}/{name}.bin").size
        self.tokens = values("bin", "<u2" if size == 2 * self.offsets[-1] else "<u4")

    def __len__(self) -> int:
        return len(self.documents)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[self.offsets[i] : self.offsets[i + 1]]


def read_documents(spark: SparkSession, folder: str, manifest: pd.DataFrame) -> DataFrame:
    """doc_id, start (position of the first id in the data set), n_tokens and ids_crc32, from the files alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, first in zip(rows["name"], rows["first_token"], strict=True):
                own = Shard(folder, name)
                for lo in range(0, len(own), 10_000):
                    part = range(lo, min(lo + 10_000, len(own)))
                    yield pd.DataFrame(
                        {
                            "doc_id": pd.array([None if own.documents[i] == NULL_ID else int(own.documents[i]) for i in part], "Int64"),
                            "start": first + own.offsets[part.start : part.stop],
                            "n_tokens": np.diff(own.offsets[part.start : part.stop + 1]),
                            "ids_crc32": np.array([zlib.crc32(own[i].astype("<u4").tobytes()) for i in part], np.int64),
                        }
                    )

    shards = spark.createDataFrame([(str(n), int(f)) for n, f in zip(manifest["name"], manifest["first_token"], strict=True)], "name string, first_token long")
    return shards.repartition(max(1, len(manifest))).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_folder(spark, "token-files")
    manifest = write(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, folder, manifest)
