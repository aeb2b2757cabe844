"""Operators over rows in an explicit order within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloam.functions.stable import stable_key


def first_per(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each group in the order; Spark limits each group before it is moved."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def cap_per_group(df: DataFrame, keys: list[str], key: str, n: int, seed: int = 22) -> DataFrame:
    """The n rows of each group with the least stable key: a sample that new rows change only where they belong to it."""
    return top_per(df, keys, n, stable_key(seed, F.col(key)), key)


def duplicate_flags(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """status: conflicting where a key has several labels, duplicate for all but the first row of a key, else ok."""
    by = Window.partitionBy(*keys)
    several = (F.min(label).over(by) != F.max(label).over(by)) | (F.count(label).over(by) != F.count(F.lit(1)).over(by)) & (F.count(label).over(by) > 0)
    return df.withColumn("status", F.when(several, "conflicting").when(F.row_number().over(by.orderBy(order)) > 1, "duplicate").otherwise("ok"))


def running_number(df: DataFrame, keys: list[str], order: str, starts: Column, to: str = "run") -> DataFrame:
    """Number of the run that a row belongs to: a running count of the rows that start one."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def transition_share(df: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Per group the share of rows whose label differs from the row before."""
    before = F.lag(label).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_m", F.when(before.isNotNull() & (F.col(label) != before), 1.0).otherwise(0.0)).groupBy(*keys).agg(F.avg("_m").alias("transition_share"), F.count(F.lit(1)).alias("n"))


def thirds(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """position: beginning, middle or end of a group, by thirds rounded up."""
    by = Window.partitionBy(*keys)
    n, i = F.count(F.lit(1)).over(by), F.row_number().over(by.orderBy(order))
    return df.withColumn("position", F.when(i <= F.ceil(n / 3), "beginning").when(i <= F.ceil(2 * n / 3), "middle").otherwise("end"))


def average_ranks(df: DataFrame, keys: list[str], value: str) -> Column:
    """Ranks with the mean for ties, as a column."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return F.rank().over(by.orderBy(value)) + (F.count(F.lit(1)).over((Window.partitionBy(*keys, value) if keys else Window.partitionBy(value))) - 1) / 2


def with_running_sum(df: DataFrame, order: str, value: str, to: str, ranges: int = 256) -> DataFrame:
    """``to``: the sum of ``value`` over all rows that come before in the order (of numbers).

    Rows are dealt to ranges by sampled bounds; a window runs inside each range, and prefix sums of the ranges' totals are added.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.5 / ranges))) if ranges > 1 else []
    bound = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    dealt = df.withColumn("_range", F.size(F.filter(bound, lambda c: c < F.col(order))))
    totals = dealt.groupBy("_range").agg(F.sum(value).alias("_s"))
    before = totals.select("_range", (F.sum("_s").over(Window.orderBy("_range")) - F.col("_s")).alias("_before"))  # a row for each range
    within = F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return dealt.join(F.broadcast(before), "_range").withColumn(to, F.col("_before") + F.coalesce(within, F.lit(0))).drop("_range", "_before")
