"""Agreement between labels: counts, rates, tests and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloam.operators.ordering import with_running_sum


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Long confusion matrix: gold, predicted, n, and the share of the gold class."""
    n = df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("gold")))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each class, 0 where undefined. ``matrix``: gold, predicted, n."""
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("gold").alias("label")).agg(F.sum("n").alias("n_gold"), F.sum(hit).alias("tp"))
    cols = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    both = rows.join(cols, "label", "full_outer").fillna(0)
    p = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(0.0)
    r = F.when(F.col("n_gold") > 0, F.col("tp") / F.col("n_gold")).otherwise(0.0)
    return both.withColumns({"precision": p, "recall": r}).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def kappa(matrix: DataFrame) -> DataFrame:
    """Cohen's kappa of a long matrix, one row: n, observed, expected, kappa."""
    scores = class_scores(matrix)
    total = scores.agg(F.sum("n_gold").cast("double").alias("n"), F.sum("tp").alias("hits"), F.sum(F.col("n_gold") * F.col("n_predicted")).cast("double").alias("chance"))
    out = total.select("n", (F.col("hits") / F.col("n")).alias("observed"), (F.col("chance") / (F.col("n") * F.col("n"))).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") < 1, (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def residuals(matrix: DataFrame) -> DataFrame:
    """Expected counts and standardised residuals of each cell of the full table."""
    g = matrix.groupBy("gold").agg(F.sum("n").alias("rn"))
    p = matrix.groupBy("predicted").agg(F.sum("n").alias("cn"))
    full = g.join(F.broadcast(p)).join(matrix, ["gold", "predicted"], "left").fillna(0, ["n"])  # one row per class on each side
    full = full.withColumn("expected", F.col("rn") * F.col("cn") / F.sum("rn").over(Window.partitionBy("predicted")))
    return full.select("gold", "predicted", "n", "expected", ((F.col("n") - F.col("expected")) / F.sqrt("expected")).alias("residual"))


def moments(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sample deviation, standard error, 95 % normal interval, variation, and bias-corrected skewness and kurtosis."""
    x = F.col(value)
    n = F.count(x).cast("double")
    a = df.groupBy(*by).agg(n.alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.percentile(x, F.lit(0.5)).alias("median"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    m = F.col("n")
    sem = F.col("sd") / F.sqrt(m)
    return a.select(
        *by, m.cast("long").alias("n"), "mean", "sd", "median", sem.alias("sem"), (F.col("mean") - 1.959964 * sem).alias("ci_low"), (F.col("mean") + 1.959964 * sem).alias("ci_high"), (F.col("sd") / F.col("mean")).alias("cv"),
        F.when(m > 2, F.col("g1") * F.sqrt(m * (m - 1)) / (m - 2)).alias("skewness"),
        F.when(m > 3, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * F.col("g2") + 6)).alias("kurtosis"),
    )


def iqr_outliers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows outside 1.5 interquartile ranges of their group."""
    q = df.groupBy(*by).agg(F.percentile(value, F.lit(0.25)).alias("q1"), F.percentile(value, F.lit(0.75)).alias("q3"))
    wide = 1.5 * (F.col("q3") - F.col("q1"))
    return df.join(q, by).filter((F.col(value) < F.col("q1") - wide) | (F.col(value) > F.col("q3") + wide))


def majority_label(df: DataFrame, key: str, label: str, purity: float = 0.0, least: int = 1) -> DataFrame:
    """Per key its most frequent label (ties: the least) and share, at ``purity`` or more; labels with too few keys go."""
    n = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(key)
    top = n.withColumns({"share": F.col("n") / F.sum("n").over(by), "place": F.row_number().over(by.orderBy(F.desc("n"), label))}).filter((F.col("place") == 1) & (F.col("share") >= purity))
    keys = top.groupBy(label).agg(F.count(F.lit(1)).alias("keys")).filter(F.col("keys") >= least)
    return top.join(keys.select(label), label, "left_semi").select(key, label, "share")


def pair_purity(df: DataFrame, group: str, label: str) -> DataFrame:
    """Share of same-label pairs among all pairs of a group, over all groups; one row. Counts stand in for pairs."""
    n = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    per = n.groupBy(group).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("same"), F.sum("n").alias("t"))
    return per.agg(F.sum("same").alias("same_pairs"), F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("pairs")).withColumn("purity", F.col("same_pairs") / F.col("pairs"))


def collision_rate(df: DataFrame, value: str) -> DataFrame:
    """Chance that two random rows have the same value."""
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("v"))
    total = n.agg(F.sum(F.col("v") * (F.col("v") - 1)).cast("double").alias("same"), F.sum("v").cast("double").alias("n"))
    return total.select(F.col("n").cast("long").alias("n"), (F.col("same") / (F.col("n") * (F.col("n") - 1))).alias("rate"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by average ranks, from the distinct scores' counts; null for one class.

    Ranks come from running counts over distinct scores, by ranges of the score.
    """
    n = df.groupBy(score).agg(F.count_if(F.col(positive)).alias("p"), F.count(F.lit(1)).alias("t"))
    ranked = with_running_sum(n, score, "t", "below").withColumn("mean_rank", F.col("below") + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum(F.col("mean_rank") * F.col("p")).alias("ranks"), F.sum("p").cast("double").alias("p"), F.sum("t").cast("double").alias("t"))
    q = F.col("t") - F.col("p")
    return s.select(F.col("p").cast("long").alias("n_positive"), q.cast("long").alias("n_negative"), F.when((F.col("p") > 0) & (q > 0), (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * q)).alias("auc"))


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """rejected: true up to the last p, in ascending order, that is at most its rank / m * alpha."""
    by = by or []
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(p)), "_m": F.count(F.lit(1)).over(w)})
    last = F.max(F.when(F.col(p) <= F.col("_i") / F.col("_m") * alpha, F.col("_i"))).over(w)
    return ranked.withColumn("rejected", F.coalesce(F.col("_i") <= last, F.lit(False))).drop("_i", "_m")


def balanced_panel(df: DataFrame, sample: str, run: str, share: float = 1.0) -> DataFrame:
    """Rows of samples that occur in at least ``share`` of all runs."""
    runs = df.agg(F.countDistinct(run).alias("runs"))
    per = df.groupBy(sample).agg(F.countDistinct(run).alias("own"))
    return df.join(per.join(F.broadcast(runs)).filter(F.col("own") >= share * F.col("runs")).select(sample), sample, "left_semi")  # runs is one row


def weighted_summary(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Mean, deviation and percentiles as if each row were there ``weight`` times."""
    w, x = F.col(weight), F.col(value)
    mean = F.sum(w * x) / F.sum(w)
    return df.agg(F.sum(w).alias("n"), mean.alias("mean"), F.sqrt(F.sum(w * x * x) / F.sum(w) - mean * mean).alias("sd"), *(F.percentile(x, F.lit(q), w).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)))


def lenient_accuracy(exact: Column, lenient: Column) -> list[Column]:
    """Sum, count, mean and deviation in percent of exact and lenient agreement, rounded to two digits."""
    out = []
    for name, c in (("exact", exact), ("lenient", lenient)):
        x = c.cast("double")
        out += [F.sum(x).cast("long").alias(f"{name}_n"), F.round(F.avg(x) * 100, 2).alias(f"{name}_pct"), F.round(F.stddev_samp(x) * 100, 2).alias(f"{name}_sd")]
    return out
