"""Quality rules as a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one integer whose bit *i* is set
where rule *i* failed. A policy is a named set of rules, so verdicts of any policy and ablations come from bitwise
operations on the stored integer, without reading a text again.

Defined results: a null text is measured as a text without words; an empty text likewise (it fails ``few_words``).
Texts of any length are measured whole. Repeated rows (ties) each get their own row. Extra columns pass through; the
ledger's columns replace ones of the same name. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloam.llm.common import bounded_batches, table

WINDOW = 8
#: Fixed values of the contract: characters that count as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouted", "n_adjacent", "n_bangs", "n_distinct")


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (SQL over the measurements) is true."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 3 * word_chars"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule(4, "shouting", "100 * n_shouted > 25 * n_words"),
    Rule(5, "adjacent_repeats", "n_words >= 20 AND 100 * n_adjacent > 20 * n_words"),
    Rule(6, "exclamations", "100 * n_bangs > 20 * n_words"),
    Rule(7, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
)

#: Versioned policies: names of the rules that reject.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
}


def policy_mask(policy: str) -> int:
    names = set(POLICIES[policy])
    return sum(1 << r.bit for r in RULES if r.name in names)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows of ``window`` (a power of two) words that occur at least twice."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n, np.uint64)
    for j in range(window):
        rolled = rolled * np.uint64(0xBF58476D1CE4E5B9) + mixed[j : j + n]
    rolled.sort()
    if not (rolled[1:] == rolled[:-1]).any():  # distinct hashes: no window can repeat
        return 0
    ranks, span = ids.astype(np.int64), 1
    while span < window:  # ranks of windows of doubled length, free of collisions
        ranks = np.unique(ranks[:-span] * (int(ranks.max()) + 1) + ranks[span:], return_inverse=True)[1]
        span *= 2
    again = np.bincount(ranks)[ranks] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    adjacent = int((ids[1:] == ids[:-1]).sum())
    return (len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated_words(ids), len(lines), sum(map(bytes.isupper, words)), adjacent, text.count("!"), len(seen))


def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(x) for x in texts], columns=MEASURES, dtype="int64")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements, ``failures`` (a bit for each failed rule) and no other change."""
    bounded_batches(docs.sparkSession)
    measured = F.pandas_udf(_measured, T.StructType([T.StructField(n, T.LongType()) for n in MEASURES]))
    own = "_measured"
    while own in docs.columns:
        own += "_"
    out = docs.withColumn(own, measured(F.col(text)))
    out = out.withColumns({n: F.col(own)[n] for n in MEASURES}).drop(own)
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return out.withColumn("failures", failures.cast("long"))


def apply_policy(entries: DataFrame, policy: str = "v1", to: str = "kept") -> DataFrame:
    """A boolean column: true where no rule of the policy failed."""
    return entries.withColumn(to, F.col("failures").bitwiseAND(F.lit(policy_mask(policy))) == 0)


def ablation(entries: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone (kept again without the rule), and all.

    One aggregation over the stored bits; nothing is evaluated anew.
    """
    mask = policy_mask(policy)
    failed = F.col("failures").bitwiseAND(F.lit(mask))
    sums = [F.count(F.lit(1)).alias("n_documents")]
    rules = [r for r in RULES if mask >> r.bit & 1]
    for r in rules:
        sums.append(F.count_if(failed.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"failed_{r.bit}"))
        sums.append(F.count_if(failed == (1 << r.bit)).alias(f"alone_{r.bit}"))
    rows = F.array(*(F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule"), F.col(f"failed_{r.bit}").alias("n_failed"), F.col(f"alone_{r.bit}").alias("n_alone")) for r in rules))
    return entries.agg(*sums).select("n_documents", F.explode(rows).alias("r")).select("r.*", "n_documents")


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with the columns of ``docs``."""
    judged = apply_policy(ledger(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("text"))), policy)
    return judged.filter("kept").select("_row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("failures").bitwiseAND(F.lit(policy_mask("base"))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failures")


def _sql() -> str:
    space, not_space = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return f"""
WITH split AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
        list_filter(regexp_split_to_array(coalesce(text, ''), '{space}'), lambda x: x <> '') AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{not_space}')) AS l
    FROM documents
), windows AS (
    SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM split WHERE len(w) >= {WINDOW})
), again AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM windows) WHERE n > 1
), repeated AS (
    SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS p FROM again) GROUP BY r
), measured AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        len(l)::BIGINT AS n_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_shouted,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_adjacent,
        (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs
    FROM split LEFT JOIN repeated USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & {policy_mask("base")} <> 0 AS base_failed, failures & {policy_mask("v1")} = 0 AS kept, failures
FROM (SELECT *, ({bits})::BIGINT AS failures FROM measured)"""


SQL = _sql()
