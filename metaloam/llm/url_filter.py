"""URL filtering: rules first, then logistic regression on hashed character n-grams of host and path.

A rule is ``suffix/path-prefix`` with a verdict. It fits its host and all subdomains where the url's path starts with
the rule's; the longest fitting rule wins. Other urls get the model's verdict. The model is trained on the driver from a
small labelled table of urls (a parameter; ``labelled_urls.tsv`` beside this module is the default) and has a fixed size.
``accuracy`` holds folds of the table out, by a hash of the url, and tells how many held-out urls get their label.

Defined results: a null url, or one without ``://``, has an empty host and path and the verdict of the model for it
(allow). Urls of any length are taken whole. Repeated rows each get a row; an empty table gives none. Columns of ``pages``
named host, path, rule, block_score or verdict are replaced by the operator's; all others pass through. Ties of rules: two
rules of one length cannot both fit a url unless they are equal, and then the last one given wins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloam.llm.common import ascii_lower, bounded_batches, table

BITS = 15
#: Fixed values of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The default table, url and label; 190 urls made by hand for it.
TABLE = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(path: str | Path = TABLE) -> pd.DataFrame:
    """A labelled table from a file with a header: url and label (1: block)."""
    rows = pd.read_csv(path, sep="\t", dtype=str, keep_default_na=False)
    return pd.DataFrame({"url": rows["url"], "label": (rows["label"] == "block").astype(int)})


def split_url(url: str | None) -> tuple[str, str]:
    got = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    host, path = (got[1], got[2]) if got else ("", "")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the n-grams (3 to 5) of the host's labels but the last, and of the words of the path."""
    names = host.rpartition(".")[0] or host
    out = set()
    for mark, text in (("h", names), ("p", path.lower())):
        for word in re.findall(r"[^\W\d_]+", text):
            edged = f"^{word}$"
            out.update(zlib.crc32(f"{mark}{edged[i : i + n]}".encode("utf-8", "surrogatepass")) >> (32 - BITS) for n in (3, 4, 5) for i in range(len(edged) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def train(labelled: pd.DataFrame, epochs: int = 300, rate: float = 2.0, decay: float = 2e-4) -> tuple[float, np.ndarray]:
    """Bias and weights by full-batch gradient descent; rows are unit vectors of their n-grams."""
    weights, bias = np.zeros(1 << BITS), -1.0
    rows = [grams(*split_url(u)) for u in labelled["url"]]
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    x = 1 / np.sqrt(np.maximum(1, np.bincount(of, minlength=len(rows))))[of] if len(at) else np.zeros(0)
    y = labelled["label"].to_numpy(np.float64)
    for _ in range(epochs if len(rows) else 0):
        error = 1 / (1 + np.exp(-(bias + np.bincount(of, weights[at] * x, len(rows))))) - y
        weights -= rate * (np.bincount(at, error[of] * x, len(weights)) / len(rows) * 50 + decay * weights)
        bias -= rate * 0.1 * error.mean()
    return bias, weights


def score(model: tuple[float, np.ndarray], host: str, path: str) -> float:
    """The probability that a url is to be blocked."""
    bias, weights = model
    at = grams(host, path)
    margin = bias + (weights[at].sum() / np.sqrt(len(at)) if len(at) else 0.0)
    return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def accuracy(labelled: pd.DataFrame, folds: int = 5) -> float:
    """The share of urls that a model trained without their fold gives their label."""
    fold = np.array([zlib.crc32(u.encode()) % folds for u in labelled["url"]], np.int64)
    right = 0
    for k in range(folds):
        model = train(labelled[fold != k])
        right += sum((score(model, *split_url(u)) >= 0.5) == (label == 1) for u, label in labelled[fold == k].itertuples(index=False))
    return right / max(1, len(labelled))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    found = "(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(whole, found, 1)), F.regexp_extract(whole, found, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        suffix, _, rest = text.partition("/")
        fits = ((host == suffix) | host.endswith(f".{suffix}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, url: str = "url", rules=RULES, labelled: pd.DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule, block_score (the model's) and verdict."""
    spark = pages.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(train(labelled_urls() if labelled is None else labelled))

    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared.value
        known: dict[tuple[str, str], float] = {}
        for hosts, paths in batches:
            out = []
            for host, path in zip(hosts, paths, strict=True):
                key = (host, re.sub(r"\d+", "0", path))  # digits are no feature
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = score(model, *key)
                out.append(known[key])
            yield pd.Series(out, dtype="float64")

    host, path = url_parts(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "block_score": F.pandas_udf(scored, "double")("host", "path")})
    return out.withColumn("verdict", F.coalesce(verdict, F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "block_score")
