"""A factorisation machine that scores whole texts for quality.

Features: hashed words (log counts, unit length), structure statistics of the text, and its length class as metadata.
The score is ``sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2))``, linear in the features.

The model is fitted on the driver from at most about ``max_rows`` labelled rows (a hash sample of the label table);
it has a fixed size and is broadcast. Scoring covers every row.

Defined results: null and empty texts are scored as texts without words, and texts of any length whole; repeated rows each
get a row; labels that are null are not used, repeated labels of an id count once with their largest value, and of the
rows of one id the least text is learned from; without usable labels, or with one class only, all scores equal the
smoothed share of label 1. A score equal to the threshold (a tie) is kept. An empty table gives no rows. Extra columns
are kept by ``keep``, whatever their names, and otherwise ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloam.llm.common import WordIds, bounded_batches, hash_sample, held_out, table
from metaloam.llm.quality_rules import measure

WORD_BITS = 15
N_STRUCTURE = 10
N_LENGTHS = 16
DIM = (1 << WORD_BITS) + N_STRUCTURE + N_LENGTHS
#: Labelled rows that a model is fitted on, at most (in expectation; the sample goes by hash).
MAX_ROWS = 4000
THRESHOLD = 0.7

_buckets = WordIds(lambda word: zlib.crc32(word.lower()) & ((1 << WORD_BITS) - 1))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    at, n = np.unique(np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    x = np.log1p(n)
    x /= max(math.sqrt(float(x @ x)), 1e-9)
    m_words, m_chars, symbols, dup_lines, repeated, lines, shouted, adjacent, bangs, distinct = measure(text)
    w, c = max(m_words, 1), max(m_chars, 1)
    stats = (
        min(1.0, 10 * symbols / c),
        shouted / w,
        adjacent / w,
        min(1.0, bangs / w),
        repeated / w,
        dup_lines / max(lines, 1),
        1 - distinct / w,
        min(1.0, 2 * text.count("|") / w),
        min(1.0, m_chars / w / 20),
        min(1.0, math.log1p(m_words) / 12),
    )
    at = np.concatenate([at, (1 << WORD_BITS) + np.arange(N_STRUCTURE + 1)])
    at[-1] = (1 << WORD_BITS) + N_STRUCTURE + min(N_LENGTHS - 1, len(text).bit_length())
    return at.astype(np.int32), np.concatenate([x, stats, [0.5]]).astype(np.float32)


@dataclass
class Rows:
    """Sparse rows: where each begins in ``at`` and ``x``; no row is empty."""

    at: np.ndarray
    x: np.ndarray
    begin: np.ndarray

    @classmethod
    def of(cls, rows: Iterable[tuple[np.ndarray, np.ndarray]]) -> Rows:
        rows = list(rows)
        sizes = np.array([0, *(len(a) for a, _ in rows)])
        return cls(np.concatenate([a for a, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(sizes)[:-1])

    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.begin, len(self.at)))


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def terms(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Margins and, per row, the sum of each factor."""
        weighted = self.factors[rows.at] * rows.x[:, None]
        sums = np.add.reduceat(weighted, rows.begin, axis=0)
        squares = np.add.reduceat((weighted**2).sum(1), rows.begin)
        flat = np.add.reduceat(self.linear[rows.at] * rows.x, rows.begin)
        return self.bias + flat + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, rows: Rows) -> np.ndarray:
        margins, _ = self.terms(rows)
        return 1 / (1 + np.exp(-np.clip(margins.astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int = 8, steps: int = 700, rate: float = 0.08, decay: float = 1e-5, batch: int = 64, seed: int = 7) -> FactorisationMachine:
        """AdaGrad on the logistic loss, about ``steps`` batches but 60 epochs at most; orders and first factors come from ``seed``."""
        rng = np.random.default_rng(seed)
        share = (labels.sum() + 1) / (len(labels) + 2)
        model = cls(float(np.log(share / (1 - share))), np.zeros(DIM, np.float32), np.zeros((DIM, k), np.float32))
        if len(np.unique(labels)) < 2:
            return model
        model.factors = rng.normal(0, 0.02, (DIM, k)).astype(np.float32)
        g_bias, g_linear, g_factors = 1.0, np.full(DIM, 1e-2, np.float32), np.full((DIM, k), 1e-2, np.float32)
        for _ in range(max(1, min(60, steps * batch // len(rows)))):
            order = rng.permutation(len(rows))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                own = Rows.of([rows[i] for i in part])
                margins, sums = model.terms(own)
                error = (1 / (1 + np.exp(-np.clip(margins, -30, 30))) - labels[part]).astype(np.float32)
                of = np.repeat(np.arange(len(part)), own.lengths())
                ids, place = np.unique(own.at, return_inverse=True)
                ex = error[of] * own.x
                dl = np.bincount(place, ex, len(ids)).astype(np.float32) / len(part) + decay * model.linear[ids]
                per = ex[:, None] * (sums[of] - model.factors[own.at] * own.x[:, None])
                df = np.stack([np.bincount(place, per[:, f], len(ids)) for f in range(k)], 1).astype(np.float32) / len(part) + decay * model.factors[ids]
                db = float(error.mean())
                g_bias += db * db
                g_linear[ids] += dl**2
                g_factors[ids] += df**2
                model.bias -= rate * db / math.sqrt(g_bias)
                model.linear[ids] -= rate * dl / np.sqrt(g_linear[ids])
                model.factors[ids] -= rate * df / np.sqrt(g_factors[ids])
        return model


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        made = [features(x) for x in rows["text"]]
        yield pd.DataFrame({"label": rows["label"], "at": [a.tobytes() for a, _ in made], "x": [x.tobytes() for _, x in made]})


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> FactorisationMachine:
    """Fit on rows that are not held out, from a hash sample of about ``max_rows`` of the labelled rows."""
    bounded_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col(label).alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.count()
    chosen = hash_sample(usable, F.col("doc_id"), F.lit(min(1.0, max_rows / max(n, 1)))).groupBy("doc_id").agg(F.max("label").alias("label"))
    # chosen has about max_rows rows whatever the size of the tables
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    # of the rows of one id the one with the least text: no id sends more than one to the driver
    rows = rows.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    made = rows.mapInPandas(lambda b: _featured_with_id(b), "doc_id long, label double, at binary, x binary").toPandas().sort_values("doc_id", ignore_index=True)
    pairs = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32)) for a, x in zip(made["at"], made["x"], strict=True)]
    return FactorisationMachine.fit(pairs, made["label"].to_numpy(np.float64))


def _featured_with_id(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = next(_featured(iter([rows])))
        out.insert(0, "doc_id", rows["doc_id"])
        yield out


def score(spark: SparkSession, model: FactorisationMachine, text: Column) -> Column:
    """The quality score of a text column."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.bias, model.linear, model.factors))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = FactorisationMachine(*shared.value)
        for texts in batches:
            yield pd.Series(own.score(Rows.of(features(x) for x in texts)) if len(texts) else [], dtype="float64")

    return F.pandas_udf(scored, "double")(text)


def keep(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return rows.withColumn("_score", score(docs.sparkSession, model, F.col("_text"))).filter(F.col("_score") >= threshold).select("_row.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("score", score(spark, model, F.col("text")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
