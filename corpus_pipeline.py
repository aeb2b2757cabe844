"""A corpus pipeline: quality rules, quality classifier, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. The first four return the
columns of ``documents``; the last returns packed pieces. ``run`` writes each stage's rows to the shared folder and reads
them again, so a lost executor repeats one stage at most.

Defined results: as the operators state them. An empty table passes through all stages and gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metaloam.llm import decontaminate, near_dup, packing, quality_classifier, quality_rules
from metaloam.llm.common import stored, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7. The model learns from the labelled rows of the whole table, not held out."""
    model = quality_classifier.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of copies and near copies."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; other documents lose the words that a benchmark window covers."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids in sequences of at most 2048."""
    return packing.digests(spark, docs)


STAGES = [
    ("quality rules", rules),
    ("quality classifier", classifier),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Hash sketches, a trained model and a tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not pack:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
