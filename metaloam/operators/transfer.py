"""Label transfer: ranked labels, hybrids, metrics against gold labels, thresholds fitted across folds, checks of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloam.functions import vectors as V
from metaloam.operators.calibration import precision_threshold
from metaloam.operators.ordering import top_per, with_running_sum


def ranked(scores: DataFrame, sample: str, k: int = 5) -> DataFrame:
    """``scores`` (sample, label, score) to one row each: top (labels, best first, ties to the lesser) and confidence, the
    best one's share of all scores.
    """
    total = scores.groupBy(sample).agg(F.sum("score").alias("_all"))
    best = top_per(scores, [sample], k, F.desc("score"), "label")
    rows = best.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "label"))).alias("_top"))
    return rows.join(total, sample).select(sample, F.transform("_top", lambda x: x["label"]).alias("top"), (-F.col("_top")[0]["s"] / F.col("_all")).alias("confidence"))


def hybrid(linear: DataFrame, cosine: DataFrame, sample: str, weight: float) -> DataFrame:
    """Linear score plus ``weight`` times cosine for every label of ``cosine``; a label that the classifier never saw scores -1."""
    known = linear.select(sample, "label", F.col("score").alias("_l"))
    return cosine.join(known, [sample, "label"], "left").select(sample, "label", (F.coalesce("_l", F.lit(-1.0)) + weight * F.col("score")).alias("score"))


def candidate_strings(probabilities: DataFrame, sample: str, k: int, digits: int = 4) -> DataFrame:
    """The k most probable labels of a sample as ``label:p;label:p``."""
    best = top_per(probabilities, [sample], k, F.desc("p"), "label")
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("p")).alias("s"), "label", "p"))), lambda x: F.concat(x["label"], F.lit(":"), F.format_string(f"%.{digits}f", x["p"])))
    return best.groupBy(sample).agg(F.array_join(parts, ";").alias("candidates"))


def transfer_metrics(preds: DataFrame, key: str, parents: DataFrame, paths: DataFrame, target: float = 0.9) -> DataFrame:
    """One row of metrics for ``preds``: gold, top (labels, best first), confidence, seen (gold was in training).

    top1 and top5; hits that count a parent or child, or an ancestor; macro top1 over gold labels; top1 of the more confident
    half, of labels never seen; and the least confidence that keeps a precision of ``target``, with its coverage.
    ``parents``: child, parent; ``paths``: node, ancestor, distance.
    """
    rows = preds.select(key, "gold", "confidence", "seen", F.col("top")[0].alias("p"), F.array_contains("top", F.col("gold")).alias("top5"))
    edges = parents.select(F.col("child").alias("_a"), F.col("parent").alias("_b"))
    both = edges.union(edges.select("_b", "_a")).distinct().withColumn("_near", F.lit(True))
    up = paths.filter("distance > 0").select(F.col("node").alias("_g"), F.col("ancestor").alias("_u"), F.lit(True).alias("_up"))
    rows = rows.join(both, (F.col("p") == F.col("_a")) & (F.col("gold") == F.col("_b")), "left").join(up, (F.col("gold") == F.col("_g")) & (F.col("p") == F.col("_u")), "left")
    hit = F.col("p") == F.col("gold")
    rows = rows.select(key, "gold", "confidence", "seen", "top5", hit.alias("hit"), (hit | F.coalesce("_near", F.lit(False))).alias("near"), (hit | F.coalesce("_up", F.lit(False))).alias("above"))
    share = lambda c: F.avg(F.col(c).cast("double"))
    whole = rows.agg(F.count(F.lit(1)).alias("n"), share("hit").alias("top1"), share("top5").alias("top5"), share("near").alias("top1_or_parent_child"), share("above").alias("top1_gold_or_ancestor"), F.count_if(~F.col("seen")).alias("n_unseen_label"), F.avg(F.when(~F.col("seen"), F.col("hit").cast("double"))).alias("top1_unseen_label"))
    macro = rows.groupBy("gold").agg(share("hit").alias("a")).agg(F.avg("a").alias("macro_top1"))
    # the more confident half: rows before the middle of the order, of equal confidences the lesser keys
    counted = rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("_n"))
    below = with_running_sum(counted, "confidence", "_n", "_below")
    total = counted.agg(F.sum("_n").alias("_all"))
    edge = below.join(F.broadcast(total)).withColumn("_room", F.floor(F.col("_all") / 2) - (F.col("_all") - F.col("_below") - F.col("_n")))  # total is one row
    kept = rows.join(edge.filter("_room > 0").select("confidence", "_n", "_room"), "confidence")
    sure, tied = kept.filter("_room >= _n"), kept.filter("_room < _n")
    half = sure.select("hit").union(_first_of(tied, key).select("hit")).agg(share("hit").alias("top1_confident_half"))
    cut = precision_threshold(rows, "confidence", "hit", target).select(F.col("threshold").alias("threshold_at_precision"), F.col("coverage").alias("coverage_at_precision"))
    out = whole
    for one in (macro, half, cut):
        out = out.join(F.broadcast(one))  # one row each
    return out


def _first_of(tied: DataFrame, key: str) -> DataFrame:
    """Of the rows at the edge as many as there is room for, by their keys; the edge has one confidence."""
    room = tied.agg(F.max("_room")).first()[0] or 0
    return tied.orderBy(key).limit(int(room))


def cross_fitted(found: DataFrame, fold: str, target: float, lenient: bool = False) -> DataFrame:
    """Per fold the least tau whose accuracy on all other folds reaches the target, else the greatest, and the fold's own
    outcomes at it: fold, tau, n, answered, right. ``found``: fold, tau, outcome.
    """
    good = ("exact", "coarser") if lenient else ("exact",)
    per = found.groupBy(fold, "tau").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") != "abstain").alias("answered"), F.count_if(F.col("outcome").isin(*good)).alias("right"))
    all_of = per.groupBy("tau").agg(F.sum("answered").alias("_a"), F.sum("right").alias("_r"))
    others = per.join(all_of, "tau").withColumn("_ok", (F.col("_r") - F.col("right")) >= target * (F.col("_a") - F.col("answered"))).withColumn("_ok", F.col("_ok") & (F.col("_a") > F.col("answered")))
    chosen = others.groupBy(fold).agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col("tau"))), F.max("tau")).alias("tau"))
    return per.join(chosen, [fold, "tau"]).select(fold, "tau", "n", "answered", "right")


def text_vectors(rows: DataFrame, text: str, vector: str, tolerance: float = 1e-6) -> DataFrame:
    """Texts whose rows have vectors that differ: text, n, and the greatest spread of one dimension.

    Least and greatest values of each dimension are folded by partial aggregation.
    """
    each = rows.select(text, F.posexplode(vector).alias("pos", "x")).groupBy(text, "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    return each.groupBy(text).agg(F.max("n").alias("n"), F.max(F.col("hi") - F.col("lo")).cast("double").alias("spread")).filter(F.col("spread") > tolerance)


def id_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows, distinct ids and rows without one; one row."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.sum("n").alias("n"), F.count(key).alias("ids"), F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("no_id"))


def token_estimate(text: Column) -> Column:
    """A fourth of the characters, rounded down."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def cost_estimate(rows: DataFrame, text: str, price_in: float, price_out: float, tokens_out: int) -> DataFrame:
    """Requests, estimated tokens and cost per million tokens; one row."""
    told = rows.agg(F.count(F.lit(1)).alias("requests"), F.sum(token_estimate(F.col(text))).alias("tokens_in"))
    return told.withColumn("tokens_out", F.col("requests") * tokens_out).withColumn("cost", F.round((F.col("tokens_in") * price_in + F.col("tokens_out") * price_out) / 1e6, 6))


def ranking_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two results (key, label, score): share of equal labels and the greatest difference of scores; one row."""
    both = a.select(key, F.col("label").alias("_x"), F.col("score").alias("_s")).join(b.select(key, F.col("label").alias("_y"), F.col("score").alias("_t")), key)
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_x").eqNullSafe(F.col("_y")).cast("double")).alias("same"), F.max(F.abs(F.col("_s") - F.col("_t"))).alias("most"))


def rank_of(df: DataFrame, value: str, to: str) -> DataFrame:
    """Mean ranks of a value, from counts of distinct values by ranges."""
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("_t"))
    ranks = with_running_sum(n, value, "_t", "_below").select(value, (F.col("_below") + (F.col("_t") + 1) / 2).alias(to))
    return df.join(ranks, value)


def correlations(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation of two columns; one row."""
    both = rank_of(rank_of(df, a, "_ra"), b, "_rb")
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def reference_cosine(rows: DataFrame, reference: DataFrame, text: str, vector: str) -> DataFrame:
    """Per text of both tables the best cosine of its rows with the reference's."""
    both = rows.select(text, F.col(vector).alias("_v")).join(reference.select(text, F.col(vector).alias("_w")), text)
    return both.groupBy(text).agg(F.max(V.cosine(F.col("_v"), F.col("_w"))).alias("best"))
