"""Thresholds, temperatures and fusion of probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloam.operators.ordering import with_running_sum
from metaloam.operators.shared import discard, stored


def curve(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Per distinct confidence, from high to low: rows so far, their precision and coverage.

    Counts of distinct confidences are what is ordered, by ranges of the confidence.
    """
    n = df.groupBy(F.col(confidence).alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("hits"))
    total = n.agg(F.sum("n").alias("total"), F.sum("hits").alias("hits_total"))
    below = with_running_sum(with_running_sum(n, "threshold", "n", "n_below"), "threshold", "hits", "hits_below")
    out = below.join(F.broadcast(total)).withColumns({"n_above": F.col("total") - F.col("n_below"), "hits_above": F.col("hits_total") - F.col("hits_below")})  # total is one row
    return out.select("threshold", "n_above", (F.col("hits_above") / F.col("n_above")).alias("precision"), (F.col("n_above") / F.col("total")).alias("coverage"))


def precision_threshold(df: DataFrame, confidence: str, correct: str, target: float) -> DataFrame:
    """The lowest threshold whose precision reaches the target, and its coverage; one row, nulls if there is none."""
    fits = curve(df, confidence, correct).filter(F.col("precision") >= target)
    return fits.agg(F.min("threshold").alias("threshold"), F.max("coverage").alias("coverage"))


def choose_tau(points: DataFrame, metric: str, target: float) -> DataFrame:
    """The lowest tau that reaches the target, else the highest."""
    return points.agg(F.coalesce(F.min(F.when(F.col(metric) >= target, F.col("tau"))), F.max("tau")).alias("tau"))


def fit_temperature(scores: DataFrame, low: float = -8.0, high: float = 3.0, points: int = 23, rounds: int = 4) -> float:
    """The temperature with the least negative log-likelihood. ``scores``: sample, score, is_gold.

    A round evaluates a grid of log T in one aggregate, and the next one is as wide as two of its steps; a number for each
    point reaches the driver.
    """
    top = scores.groupBy("sample").agg(F.max("score").alias("top"))
    rows = stored(scores.join(top, "sample").select("sample", (F.col("score") - F.col("top")).alias("s"), "is_gold"), "scores")
    for _ in range(rounds):
        grid = [low + (high - low) * i / (points - 1) for i in range(points)]
        sums = [F.log(F.sum(F.exp(F.col("s") / math.exp(x)))).alias(f"z{i}") for i, x in enumerate(grid)]
        per = rows.groupBy("sample").agg(F.sum(F.when(F.col("is_gold"), F.col("s"))).alias("g"), *sums)
        losses = per.agg(*(F.avg(F.col(f"z{i}") - F.col("g") / math.exp(x)).alias(f"l{i}") for i, x in enumerate(grid))).first()
        best = min(range(points), key=lambda i: (losses[i] is None, losses[i]))
        step = (high - low) / (points - 1)
        low, high = grid[best] - step, grid[best] + step
    discard(rows)
    return math.exp(grid[best])


def fuse(base: Column, other: Column, weight: float, temperature: float = 1.0) -> Column:
    """Probabilities (arrays) proportional to exp((log base + weight log other) / temperature)."""
    raised = F.zip_with(base, other, lambda x, y: F.exp((F.log(F.greatest(x, F.lit(1e-6))) + weight * F.log(F.greatest(y, F.lit(1e-6)))) / temperature))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)
