"""Multi-parent hierarchies: closure, back-off, outcomes and coarsening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloam.operators.shared import discard, stored


def closure(edges: DataFrame, deepest: int | None = None) -> DataFrame:
    """node, ancestor and least distance, for all nodes of ``edges`` (child, parent); each node is its own at distance 0.

    Distances double in each round: paths of up to 2^k steps are joined to those of up to 2^k, until nothing changes. Cycles
    end at their length. Rounds are written to the shared folder, and a round's table goes when the next one is written.
    With ``deepest`` a graph with greater least distances is refused.
    """
    nodes = edges.select(F.col("child").alias("node")).union(edges.select("parent")).distinct()
    paths = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).union(edges.select("child", "parent", F.lit(1)))
    paths = stored(paths.groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "paths")
    told = lambda p: p.agg(F.count(F.lit(1)), F.sum("distance"), F.max("distance")).first()
    known = told(paths)
    while True:
        on = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("distance").alias("more"))
        farther = stored(paths.join(on, "ancestor").groupBy("node", F.col("far").alias("ancestor")).agg(F.min(F.col("distance") + F.col("more")).alias("distance")), "paths")
        discard(paths)
        paths, before, known = farther, known, told(farther)
        if deepest is not None and (known[2] or 0) > deepest:
            raise ValueError(f"ancestors farther than {deepest} steps")
        if known == before:
            return paths


def label_counts(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """Per node how many labels lie at or below it, its depth (number of proper ancestors) and whether it is a label."""
    below = paths.join(labels.select(F.col("label").alias("node")), "node").groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n_below"))
    depth = paths.filter("distance > 0").groupBy("node").agg(F.count(F.lit(1)).alias("depth"))
    own = labels.select(F.col("label").alias("node"), F.lit(True).alias("is_label"))
    return below.join(depth, "node", "left").join(own, "node", "left").select("node", "n_below", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("is_label", F.lit(False)).alias("is_label"))


def back_off(probabilities: DataFrame, paths: DataFrame, counts: DataFrame, tau: float | list[float], tolerance: float = 1e-12) -> DataFrame:
    """Per sample (sample, label, p) the most specific label among its best one and that one's ancestors with mass >= tau.

    Most specific: fewest labels below, then deeper, then more mass (to 9 digits), then the lesser name. A sample without one
    abstains (pick is null). Several taus are answered at once, with a column tau.
    """
    mass = probabilities.join(paths.select(F.col("node").alias("label"), "ancestor"), "label").groupBy("sample", F.col("ancestor").alias("node")).agg(F.sum("p").alias("q"))
    top = probabilities.groupBy("sample").agg(F.max_by("label", F.struct("p", "label")).alias("label"))
    own = top.join(paths.select(F.col("node").alias("label"), F.col("ancestor").alias("node")), "label").join(mass, ["sample", "node"]).join(counts.filter("is_label"), "node")
    taus = F.array(*map(F.lit, tau if isinstance(tau, list) else [tau]))
    fits = own.withColumn("tau", F.explode(taus)).filter(F.col("q") >= F.col("tau") - tolerance)
    # the least struct of a group is found by partial aggregation
    rank = F.struct("n_below", -F.col("depth"), -F.round("q", 9), "node")
    picked = fits.groupBy("tau", "sample").agg(F.min_by(F.struct(F.col("node").alias("pick"), "q"), rank).alias("r")).select("tau", "sample", "r.*")
    out = top.select("sample", F.explode(taus).alias("tau")).join(picked, ["tau", "sample"], "left")
    return out if isinstance(tau, list) else out.drop("tau")


def outcomes(picks: DataFrame, gold: DataFrame, paths: DataFrame) -> DataFrame:
    """outcome of each pick against the gold label: exact, coarser, too_specific, other or abstain."""
    both = picks.join(gold, "sample")
    up = paths.filter("distance > 0").select(F.col("node").alias("gold"), F.col("ancestor").alias("pick"), F.lit(True).alias("up"))
    down = paths.filter("distance > 0").select(F.col("node").alias("pick"), F.col("ancestor").alias("gold"), F.lit(True).alias("down"))
    both = both.join(up, ["gold", "pick"], "left").join(down, ["gold", "pick"], "left")
    outcome = F.when(F.col("pick").isNull(), "abstain").when(F.col("pick") == F.col("gold"), "exact").when(F.col("up"), "coarser").when(F.col("down"), "too_specific").otherwise("other")
    return both.select("sample", "gold", "pick", outcome.alias("outcome"))


def summary(found: DataFrame) -> DataFrame:
    """Coverage and strict and lenient accuracy among the answered."""
    answered = F.count_if(F.col("outcome") != "abstain")
    return found.agg(
        F.count(F.lit(1)).alias("n"), (answered / F.count(F.lit(1))).alias("coverage"),
        (F.count_if(F.col("outcome") == "exact") / answered).alias("strict"), (F.count_if(F.col("outcome").isin("exact", "coarser")) / answered).alias("lenient"),
    )


def coarsen(support: DataFrame, paths: DataFrame, least: int) -> DataFrame:
    """Per label (label, n) its nearest ancestor with at least that support, descendants counted; ties: the lesser name."""
    total = support.join(paths.select(F.col("node").alias("label"), "ancestor"), "label").groupBy("ancestor").agg(F.sum("n").alias("s")).filter(F.col("s") >= least)
    up = support.join(paths.select(F.col("node").alias("label"), "ancestor", "distance"), "label").join(total, "ancestor")
    near = up.groupBy("label").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("coarse"))
    return support.select("label").join(near, "label", "left")
