"""Joins with a defined result for what does not match: side tables, defaults, aligned tables and paired runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that all tables have, each once. Partial counts are folded before they are moved."""
    tagged = reduce(DataFrame.unionAll, [t.select(F.col(key), F.lit(1 << i).cast("long").alias("_t")) for i, t in enumerate(tables)])
    return tagged.groupBy(key).agg(F.bit_or("_t").alias("_in")).filter(F.col("_in") == (1 << len(tables)) - 1).select(key)


def common_rows(tables: list[DataFrame], key: str) -> list[DataFrame]:
    """Each table's rows with a key that all of them have."""
    keys = common_keys(tables, key)
    return [t.join(keys, key, "left_semi") for t in tables]


def place_join(samples: DataFrame, coordinates: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Samples with their coordinates' place: coordinates take a place of exactly equal latitude and longitude, rows with a
    null go, and then samples without a place.
    """
    located = coordinates.join(places, ["latitude", "longitude"], "left").dropna()
    return located.join(samples, key, "right").dropna()


def mismatch_cache(mismatches: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Mismatches counted by key, with what a cache knows of the key; its columns get the suffix _cached."""
    counts = mismatches.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    known = cache.select(key, *(F.col(c).alias(f"{c}_cached") for c in cache.columns if c != key))
    return counts.join(known, key, "left")


def first_joined(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of ``left`` that have a match, each with the match that is first in the order."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*[c for c in right.columns if c != key]), order).alias("_r"))
    return left.join(first, key).select(*left.columns, "_r.*")


def paired_counts(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two runs on the same samples: how many both have right, only the first, only the second, neither. One row."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    x, y = F.col("x") == 1, F.col("y") == 1
    return both.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither"))


def aligned(left: DataFrame, right: DataFrame, key: str, text: str, vector: str, size: int) -> DataFrame:
    """Every row of ``left`` with the other side's text and vector; 'NA' and a vector of NaN where there is none."""
    none = F.array_repeat(F.lit(float("nan")), size)
    found = right.select(key, F.col(text).alias("_t"), F.col(vector).alias("_v"))
    return left.join(found, key, "left").select(*left.columns, F.coalesce("_t", F.lit("NA")).alias(text), F.coalesce(F.col("_v").cast("array<double>"), none).alias(vector))


def with_default(left: DataFrame, right: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    return left.join(right.select(key, F.col(value).alias("_v")), key, "left").select(*left.columns, F.coalesce("_v", F.lit(default)).alias(value))


def outer_lists(samples: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Full outer join; what either side lacks stays null."""
    return samples.join(ids, key, "full_outer")


def chained(left: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: a.join(b, key, "left"), others, left)


def renamed_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "left") -> DataFrame:
    """Join on keys of different names; the right one goes."""
    return left.join(right.withColumnRenamed(right_key, "_k"), F.col(left_key) == F.col("_k"), how).drop("_k")


def split_by_change(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Samples of both runs: key, old and new text, and whether the text is the same."""
    both = old.select(key, F.col(text).alias("old")).join(new.select(key, F.col(text).alias("new")), key)
    return both.withColumn("same", F.md5(F.col("old").cast("binary")).eqNullSafe(F.md5(F.col("new").cast("binary"))))


def distinct_pairs(both: DataFrame, key: str) -> DataFrame:
    """Each pair of old and new text once, with its least sample and how often it occurs."""
    return both.groupBy("old", "new").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n"))


def exploded_pick(samples: DataFrame, articles: DataFrame, key: str, ids: str, article: str, order: str) -> DataFrame:
    """Per sample the first article, by ``order``, of all that it lists; nulls where none is known."""
    listed = samples.select(key, F.explode_outer(ids).alias(article)).join(articles, article, "left")
    return listed.groupBy(key).agg(F.min_by(article, F.when(F.col(order).isNotNull(), F.struct(order, article))).alias(article), F.min(order).alias(order))


def rebuilt(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """Rows of groups that were not made anew, and all new rows."""
    return old.join(new.select(group).distinct(), group, "left_anti").unionByName(new)


def semi_of_any(rows: DataFrame, lists: list[DataFrame], key: str) -> DataFrame:
    return rows.join(reduce(DataFrame.unionAll, [x.select(key) for x in lists]).distinct(), key, "left_semi")


def with_group_size(rows: DataFrame, group: str, to: str = "group_size") -> DataFrame:
    """Each row with its group's size. Counts are joined, so that no task gathers a group's rows."""
    return rows.join(rows.groupBy(group).agg(F.count(F.lit(1)).alias(to)), group)


def scattered(rows: DataFrame, members: DataFrame, answers: DataFrame, key: str, request: str, answer: str, default: Column) -> DataFrame:
    """Answers to requests back at the rows of their members, with ``source``: rerank, or backoff with the default."""
    found = members.select(request, key).join(answers.select(request, F.col(answer).alias("_a")), request).select(key, "_a")
    return rows.join(found, key, "left").select(*rows.columns, F.coalesce("_a", default).alias(answer), F.when(F.col("_a").isNotNull(), "rerank").otherwise("backoff").alias("source"))


def two_index(samples: DataFrame, first: DataFrame, second: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Row numbers of two dictionary tables per sample; the second may lack it (-1)."""
    return samples.join(first.select(key, F.col("row").alias(a)), key).join(second.select(key, F.col("row").alias(b)), key, "left").fillna(-1, [b])


def unlinked(rows: DataFrame, linked: DataFrame, classes: DataFrame, key: str, label: str) -> DataFrame:
    """Rows that are not linked, with the coarse class of their label where it has one."""
    return rows.join(linked.select(key), key, "left_anti").join(classes, label, "left")


def distinct_list_values(rows: DataFrame, values: str) -> DataFrame:
    return rows.select(F.explode(values).alias("value")).distinct()


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def pair_difference(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """Distinct combinations of ``a`` that ``b`` lacks; nulls equal nulls."""
    return a.select(*columns).subtract(b.select(*columns))


def first_file_wins(parts: list[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Union of key tables in order, of each key the first part's row; and the keys that later parts have again."""
    names = [c for c in parts[0].columns if c != key]
    tagged = reduce(DataFrame.unionByName, [p.withColumn("_p", F.lit(i)) for i, p in enumerate(parts)])
    grouped = tagged.groupBy(key).agg(F.min_by(F.struct(*names), "_p").alias("_r"), F.countDistinct("_p").alias("_n"))
    return grouped.select(key, "_r.*"), grouped.filter("_n > 1").select(key)


def all_of(first: DataFrame, others: list[DataFrame], key: str) -> DataFrame:
    """Inner joins of tables that must all have a key."""
    return reduce(lambda a, b: a.join(b, key), others, first)
