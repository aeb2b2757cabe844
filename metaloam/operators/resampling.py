"""Bootstraps over groups, with draws that depend on seed, round and position alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloam.operators.shared import stored


def draw(seed: int, round_: str, position: str, n) -> F.Column:
    """A number from 1 to n, from md5 of seed, round and position."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(round_).cast("string"), F.col(position).cast("string")).cast("binary"))
    return (F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), n) + 1).cast("long")


def group_bootstrap(df: DataFrame, group: str, a: str, b: str, rounds: int = 200, seed: int = 22) -> DataFrame:
    """Paired bootstrap over groups of mean(a) - mean(b): difference and its 2.5 and 97.5 percentiles; one row.

    Groups are folded to sums first, so what is drawn again is groups x rounds rows.
    """
    sums = df.groupBy(group).agg(F.sum(F.col(a).cast("double")).alias("sa"), F.sum(F.col(b).cast("double")).alias("sb"), F.count(F.lit(1)).alias("n"))
    numbered = sums.withColumns({"i": F.row_number().over(Window.orderBy(group)).cast("long"), "g": F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))})
    numbered = stored(numbered, "groups")  # a row for each group
    tries = numbered.select("i", "g", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    drawn = tries.select("round", draw(seed, "round", "i", F.col("g")).alias("i")).join(numbered.select("i", "sa", "sb", "n"), "i")
    means = drawn.groupBy("round").agg(((F.sum("sa") - F.sum("sb")) / F.sum("n")).alias("d"))
    ci = means.agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    whole = numbered.agg(((F.sum("sa") - F.sum("sb")) / F.sum("n")).alias("difference"))
    return whole.join(F.broadcast(ci))  # one row each
