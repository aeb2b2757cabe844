"""Operators on whole tables: upserts, differences, lookups and computing each distinct value once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloam.operators.ordering import first_per


def upsert_keep_first(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All existing rows, and new rows whose key isn't among them; each key once, existing rows first."""
    both = existing.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    order = [c for c in existing.columns if c != key]
    return first_per(both, [key], "_load", *order).drop("_load")


def latest_per_key(tables: list[DataFrame], key: str, later_wins: bool = True) -> DataFrame:
    """Union in load order; of each key the row of the last (or first) table stays."""
    both = None
    for i, t in enumerate(tables):
        t = t.withColumn("_load", F.lit(i))
        both = t if both is None else both.unionByName(t, allowMissingColumns=True)
    return first_per(both, [key], F.desc("_load") if later_wins else F.asc("_load")).drop("_load")


def missing_keys(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(present.select(key), key, "left_anti")


def key_audit(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are missing, extra and present more than once."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    p = present.groupBy(key).agg(F.count(F.lit(1)).alias("_p"))
    both = e.join(p, key, "full_outer")
    return both.agg(F.count_if(F.col("_p").isNull()).alias("n_missing"), F.count_if(F.col("_e").isNull()).alias("n_extra"), F.count_if(F.col("_p") > 1).alias("n_duplicate"))


def merge_lists(a: DataFrame, b: DataFrame, key: str, values: str) -> DataFrame:
    """Full outer merge; lists of both sides are united without repeats."""
    none = F.array().cast(a.schema[values].dataType)
    x, y = a.select(key, F.col(values).alias("_x")), b.select(key, F.col(values).alias("_y"))
    return x.join(y, key, "full_outer").select(key, F.array_union(F.coalesce("_x", none), F.coalesce("_y", none)).alias(values))


def wide_from_long(df: DataFrame, key: str, item: str, value: str, items: list[str], order: str | None = None) -> DataFrame:
    """Entity-attribute-value rows to one row for each key; the first value of an item by ``order`` stays, else the least."""
    return df.groupBy(key).pivot(item, items).agg(F.min_by(value, order) if order else F.min(value))


def distinct_apply(df: DataFrame, column: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Compute something for each distinct value once and join it back; ``compute`` gets and keeps ``column``."""
    return df.join(compute(df.select(column).distinct()), column, "left")


def first_known(df: DataFrame, key: str, ids: str, known: DataFrame, id_name: str) -> DataFrame:
    """Per row the first of its listed ids that the table ``known`` has: key and id; rows without one are left out."""
    listed = df.select(key, F.posexplode(ids).alias("_pos", id_name))
    return listed.join(known.select(id_name).distinct(), id_name).groupBy(key).agg(F.min_by(id_name, "_pos").alias(id_name))


def ordered_rules(df: DataFrame, rules: DataFrame, key: str, row: str = "row_id", text: str = "text") -> DataFrame:
    """The decision of the last rule that fits each row (equal scope key, and its pattern if it has one)."""
    fits = df.select(row, key, text).join(rules, key).filter(F.col("pattern").isNull() | F.regexp_like(F.col(text), F.col("pattern")))
    last = fits.groupBy(row).agg(F.max_by("decision", "rule_order").alias("decision"))
    return df.join(last, row, "left")
