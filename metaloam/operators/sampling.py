"""Samples by stable keys: the same rows in every run, whatever the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloam.functions.stable import stable_key
from metaloam.functions.text import tokens
from metaloam.operators.ordering import top_per


def n_per_class(df: DataFrame, label: str, key: str, n: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """Up to n rows of each class; with ``exact`` a class with fewer is an error."""
    out = top_per(df, [label], n, stable_key(seed, F.col(key)), key)
    if exact and (short := df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < n).limit(5).collect()):
        raise ValueError(f"fewer than {n} rows in {[r[label] for r in short]}")
    return out


def n_overall(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the least stable keys. Each task keeps n of its own, so n must fit in one."""
    return df.orderBy(stable_key(seed, F.col(key)), key).limit(n)


def shuffled_list(df: DataFrame, key: str, allowed: DataFrame | None = None, seed: int = 42, n: int | None = None) -> DataFrame:
    """Keys in a stable random order, of a whitelist only if there is one: key and place (from 0) of the first n.

    Places come from counts of ranges of the stable key, so no task sees all rows.
    """
    rows = df.select(key).distinct()
    if allowed is not None:
        rows = rows.join(allowed.select(key).distinct(), key, "left_semi")
    rows = rows.withColumn("_k", stable_key(seed, F.col(key))).withColumn("_range", F.substring("_k", 1, 3))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # 4,096 rows at most
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_k", key))
    out = rows.join(F.broadcast(before), "_range").select(key, (F.col("_before") + own - 1).alias("place"))  # as many rows
    return out if n is None else out.filter(F.col("place") < n)


def nested_caps(df: DataFrame, outer: str, inner: str, key: str, per_inner: int, per_outer: int, seed: int = 42) -> DataFrame:
    """At most ``per_inner`` rows of an inner group in an outer one, then at most ``per_outer`` of the outer one."""
    order = (stable_key(seed, F.col(key)), key)
    return top_per(top_per(df, [outer, inner], per_inner, *order), [outer], per_outer, *order)


def capped_then_n(df: DataFrame, group: str, key: str, per_group: int, n: int, seed: int = 42) -> DataFrame:
    return n_overall(top_per(df, [group], per_group, stable_key(seed, F.col(key)), key), key, n, seed + 1)


def large_classes(df: DataFrame, label: str, key: str, least: int, classes: int, members: int, seed: int = 42) -> DataFrame:
    """The largest ``classes`` classes of ``least`` rows or more (ties to the lesser name), a fixed number of each."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).orderBy(F.desc("_n"), label).limit(classes)
    return n_per_class(df.join(sizes.select(label), label, "left_semi"), label, key, members, seed)


def equal_classes(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest one has; that one number reaches the driver, and limits each task's rows."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    return top_per(df, [label], least or 0, stable_key(seed, F.col(key)), key)


def shares_of(df: DataFrame, label: str, total: int) -> DataFrame:
    """How many of ``total`` each class gets in proportion to its rows, rounded down; the first class takes the rest."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everyone = n.agg(F.sum("n").alias("all"), F.min(label).alias("first"))
    each = n.join(F.broadcast(everyone)).withColumn("own", F.floor(total * F.col("n") / F.col("all")).cast("long"))  # everyone is one row
    rest = each.agg((total - F.sum("own")).alias("rest"))
    return each.join(F.broadcast(rest)).select(label, (F.col("own") + F.when(F.col(label) == F.col("first"), F.col("rest")).otherwise(0)).alias("take"))


def proportional(df: DataFrame, label: str, key: str, total: int, seed: int = 42) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(label).orderBy(stable_key(seed, F.col(key)), key))
    limited = df.withColumn("_n", place).filter(F.col("_n") <= total)  # no class takes more, so tasks keep as many at most
    return limited.join(shares_of(df, label, total), label).filter("_n <= take").drop("_n", "take")


def split_rows(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that fulfil a predicate, and all others (null counts as not)."""
    yes = F.coalesce(predicate, F.lit(False))
    return df.filter(yes), df.filter(~yes)


def cut_to_shortest(df: DataFrame, a: str, b: str) -> DataFrame:
    """Two text columns cut to the lesser number of words of the two, row by row."""
    n = F.least(F.size(F.split(a, " ")), F.size(F.split(b, " ")))
    return df.withColumns({c: F.array_join(F.slice(F.split(c, " "), 1, n), " ") for c in (a, b)})


def pair_relation(a: Column, b: Column) -> Column:
    """How two names are related: same_head (last word), same_first, shared, none."""
    x, y = F.transform(tokens(a), F.lower), F.transform(tokens(b), F.lower)
    return F.when(F.element_at(x, -1) == F.element_at(y, -1), "same_head").when(x[0] == y[0], "same_first").when(F.arrays_overlap(x, y), "shared").otherwise("none")


def option_order(df: DataFrame, key: str, options: int, seed: int) -> DataFrame:
    """A stable permutation of 1 to ``options`` for each row; other numbers of options don't shift it."""
    keyed = F.transform(F.sequence(F.lit(1), F.lit(options)), lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string")).cast("binary")).alias("k"), i.alias("i")))
    return df.withColumn("order", F.transform(F.array_sort(keyed), lambda x: x["i"]))


def cumulative_arms(df: DataFrame, arms: list[tuple[str, Column]]) -> DataFrame:
    """A boolean for each arm: its own condition and those of all arms before it."""
    so_far = F.lit(True)
    for name, own in arms:
        so_far = so_far & F.coalesce(own, F.lit(False))
        df = df.withColumn(name, so_far)
    return df


def keyword_classes(df: DataFrame, text: str, first: tuple[str, str], second: tuple[str, str], ambiguous: bool = False) -> DataFrame:
    """``class``: the name of the pattern that a text has; both or neither drop a row, unless the first one wins."""
    a, b = F.col(text).rlike(first[1]), F.col(text).rlike(second[1])
    own = F.when(a & (F.lit(ambiguous) | ~b), first[0]).when(b & ~a, second[0])
    return df.withColumn("class", own).filter(F.col("class").isNotNull())
