"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of non-letters become one separator, and n-grams of 1 to 3 characters are hashed into a fixed
number of buckets. Training counts come from a hash sample of at most about ``per_language`` documents of each language.
The matrix of log probabilities (buckets x languages) is broadcast in blocks of at most ``BLOCK_LANGUAGES`` languages, each
of a fixed size, however many languages there are. A text is its sparse counts of buckets, and a batch of texts is
multiplied with the matrix at once. Scoring covers whole texts.

The prediction has the greatest posterior. The score is the posterior of the same share of evidence for ``EVIDENCE``
n-grams (for all, where a text has fewer): whole texts have thousands, far from independent, and would all score 1. So it
tells clear texts from short, mixed or foreign ones.

Defined results: a null text or one without a letter (Unicode's categories L*) is ``und`` with score 0; rows without a
language train nothing; with no training rows at all, or an empty table, every text is ``und``. Ties go to the
alphabetically first language. Repeated rows each get a row. Texts of any length are counted whole, in blocks of bounded
size. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloam.llm.common import bounded_batches, hash_sample, held_out, table

BITS = 15
ORDERS = (1, 2, 3)
#: Documents of each language that train the model, at most (in expectation; the sample goes by hash).
PER_LANGUAGE = 2500
#: Languages of one matrix: 32 MB. Further languages have matrices of their own.
BLOCK_LANGUAGES = 256
#: N-grams whose mean evidence makes a score.
EVIDENCE = 3
UNKNOWN = "und"
_BLOCK = 1 << 20
_KNOWN = 0x110000
#: Products of counts and log probabilities that are held at once.
_CELLS = 4_000_000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(_KNOWN)), bool, _KNOWN))
    return _letters[0]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a whole text, in blocks of bounded size."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters()
    for lo in range(0, len(codes), _BLOCK):
        own = codes[max(0, lo - 2) : lo + _BLOCK]
        is_letter = known[own]
        if not is_letter.any():
            continue
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        c = np.concatenate([[0], np.where(is_letter, own, 0)[keep], [0]]).astype(np.uint64)
        out = []
        for n in ORDERS:
            h = np.zeros(len(c) - n + 1, np.uint64)
            for j in range(n):
                h = (h ^ c[j : j + len(h)]) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
            if n == 1:
                h = h[c != 0]
            out.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        yield np.concatenate(out)


def counts(text: str | None) -> np.ndarray:
    """How often a whole text has each bucket."""
    out = np.zeros(1 << BITS, np.int64)
    for part in grams(text):
        out += np.bincount(part, minlength=1 << BITS)
    return out


@dataclass
class NaiveBayes:
    languages: list[str]
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages

    def evidence(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text its number of n-grams, and per text and language the log of prior times likelihood."""
        n, totals, at, times, sizes = [], [], [], [], []

        def multiply() -> None:
            if not sizes:
                return
            rows = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            bucket, weight = np.concatenate(at), np.concatenate(times).astype(np.float32)
            products = self.log_prob[bucket] * weight[:, None]
            filled = np.array(sizes) > 0
            out = np.zeros((len(sizes), len(self.languages)))
            if filled.any():
                out[filled] = np.add.reduceat(products, rows[filled], axis=0, dtype=np.float64)
            totals.append(out + self.log_prior)
            at.clear(), times.clear(), sizes.clear()

        for text in texts:
            own = counts(text)
            has = np.flatnonzero(own)
            n.append(int(own.sum()))
            at.append(has)
            times.append(own[has])
            sizes.append(len(has))
            if sum(sizes) * max(1, len(self.languages)) >= _CELLS:
                multiply()
        multiply()
        return np.array(n, np.int64), np.concatenate([np.zeros((0, len(self.languages))), *totals])


def decided(models: list[NaiveBayes], texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and score of each text, over the languages of all models."""
    languages = [x for m in models for x in m.languages]
    if not languages:
        return [(UNKNOWN, 0.0)] * len(texts)
    parts = [m.evidence(texts) for m in models]
    n, totals = parts[0][0], np.concatenate([t for _, t in parts], axis=1)
    best = totals.argmax(1)
    shares = np.exp((totals - totals.max(1, keepdims=True)) * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None])
    scores = 1 / shares.sum(1)
    return [(languages[b], float(x)) if k else (UNKNOWN, 0.0) for b, x, k in zip(best, scores, n, strict=True)]


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}

    def told() -> Iterator[pd.DataFrame]:
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": own[at]})
        sums.clear()

    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            sums.setdefault(lang, np.zeros(1 << BITS, np.int64))
            sums[lang] += counts(text)
            if len(sums) >= BLOCK_LANGUAGES:
                yield from told()
    yield from told()


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[NaiveBayes]:
    """Fit on rows with a language that are not held out: a model for each block of languages, in alphabetic order."""
    bounded_batches(docs.sparkSession)
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    languages, all_rows, out = sorted(sizes), sum(sizes.values()), []
    for lo in range(0, len(languages), BLOCK_LANGUAGES):
        own = languages[lo : lo + BLOCK_LANGUAGES]
        shares = F.create_map(*(F.lit(x) for k in own for x in (k, min(1.0, per_language / sizes[k]))))
        sample = hash_sample(usable.filter(F.col("lang").isin(own)), F.xxhash64("doc_id", "text"), shares[F.col("lang")])
        # at most buckets x languages of a block reach the driver
        told = sample.select("lang", "text").mapInPandas(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        n = np.full((1 << BITS, len(own)), 0.05)
        place = {k: i for i, k in enumerate(own)}
        np.add.at(n, (told["bucket"].to_numpy(np.int64), told["lang"].map(place).to_numpy(np.int64)), told["n"].to_numpy(np.float64))
        prior = np.array([sizes[k] for k in own], np.float64)
        out.append(NaiveBayes(own, np.log(prior / all_rows), np.log(n / n.sum(0)).astype(np.float32)))
    return out


def predict(spark: SparkSession, models: list[NaiveBayes], text: Column) -> Column:
    """A struct of lang_pred and score for a text column."""
    bounded_batches(spark)
    shared = [spark.sparkContext.broadcast((m.languages, m.log_prior, m.log_prob)) for m in models]

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = [NaiveBayes(*x.value) for x in shared]
        for texts in batches:
            yield pd.DataFrame(decided(own, list(texts)), columns=["lang_pred", "score"])

    return F.pandas_udf(predicted, T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))(text)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = train(docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(spark, model, F.col("text")).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
