"""Validation of runs against gold labels: agreement, scores, tests between runs, and reports by group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloam.functions import tails
from metaloam.operators.ordering import with_running_sum


def agreement_by_run(df: DataFrame, run: str, exact: str, lenient: str) -> DataFrame:
    """Per run sum, count, percent and deviation in percent of both agreements, and a label of the exact one."""
    out = []
    for name, c in (("exact", exact), ("lenient", lenient)):
        x = F.col(c).cast("double")
        out += [F.sum(x).cast("long").alias(f"{name}_sum"), F.count(x).alias(f"{name}_count"), F.round(F.avg(x) * 100, 2).alias(f"{name}_pct"), F.round(F.round(F.stddev_samp(x), 2) * 100, 2).alias(f"{name}_sd")]
    rows = df.groupBy(run).agg(*out)
    return rows.withColumn("label", F.concat(F.format_string("%.2f", "exact_pct"), F.lit("%\n(n="), F.col("exact_count"), F.lit(")")))


def run_scores(df: DataFrame, run: str, gold: str, predicted: str) -> DataFrame:
    """Per run accuracy and macro precision, recall and F1 over the classes of either side, 0 where undefined."""
    n = df.groupBy(run, F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0)
    rows = n.groupBy(run, F.col("g").alias("c")).agg(F.sum("n").alias("ng"), F.sum(hit).alias("tp"))
    cols = n.groupBy(run, F.col("p").alias("c")).agg(F.sum("n").alias("np"))
    both = rows.join(cols, [run, "c"], "full_outer").fillna(0, ["ng", "np", "tp"])
    precision = F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0)
    recall = F.when(F.col("ng") > 0, F.col("tp") / F.col("ng")).otherwise(0.0)
    both = both.withColumns({"pr": precision, "re": recall}).withColumn("f1", F.when(F.col("pr") + F.col("re") > 0, 2 * F.col("pr") * F.col("re") / (F.col("pr") + F.col("re"))).otherwise(0.0))
    return both.groupBy(run).agg((F.sum("tp") / F.sum("ng")).alias("accuracy"), F.avg("pr").alias("precision"), F.avg("re").alias("recall"), F.avg("f1").alias("f1"))


def score_ranges(scores: DataFrame, columns: tuple[str, ...] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    """Least and greatest value of each score over all runs: metric, low, high."""
    told = scores.agg(*(F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in columns))
    return told.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c)["low"].alias("low"), F.col(c)["high"].alias("high")) for c in columns))).alias("r")).select("r.*")


def _tests(batches: Iterator[pd.DataFrame], least_overlap: float) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r.common >= least_overlap * min(r.n1, r.n2):
                kind, (stat, p) = "McNemar", tails.mcnemar(r.first_only, r.second_only)
            else:
                m1, m2 = r.s1 / r.n1, r.s2 / r.n2
                if r.s1 in (0, r.n1) or r.s2 in (0, r.n2):
                    a, b, c, d = r.s1, r.n1 - r.s1, r.s2, r.n2 - r.s2
                    kind, stat, p = "Fisher exact", (a * d / (b * c) if b * c else float("inf") if a * d else float("nan")), tails.fisher_exact(a, b, c, d)
                else:
                    kind, (stat, p) = "Independent T-test", tails.student(m1, m1 * (1 - m1) * r.n1, r.n1, m2, m2 * (1 - m2) * r.n2, r.n2)
            out.append((r.run1, r.run2, kind, float(stat), float(p)))
        yield pd.DataFrame(out, columns=["run1", "run2", "test", "statistic", "p"])


def run_tests(df: DataFrame, run: str, sample: str, agreement: str, least_overlap: float = 0.9) -> DataFrame:
    """Each pair of runs: a paired test where their samples overlap enough, Fisher's where one has no variance, else a t-test;
    p is adjusted by Bonferroni. Counts are made by a join on the sample; a row for each pair reaches Python.
    """
    each = df.select(F.col(run).alias("run"), F.col(sample).alias("sample"), F.col(agreement).cast("int").alias("hit"))
    totals = each.groupBy("run").agg(F.count("hit").alias("n"), F.sum("hit").cast("long").alias("s"))
    a = each.select("sample", F.col("run").alias("run1"), F.col("hit").alias("h1"))
    b = each.select("sample", F.col("run").alias("run2"), F.col("hit").alias("h2"))
    met = a.join(b, "sample").filter("run1 < run2").groupBy("run1", "run2").agg(F.count(F.lit(1)).alias("common"), F.count_if(F.expr("h1 = 1 AND h2 = 0")).alias("first_only"), F.count_if(F.expr("h1 = 0 AND h2 = 1")).alias("second_only"))
    t1, t2 = (totals.select(F.col("run").alias(f"run{i}"), F.col("n").alias(f"n{i}"), F.col("s").alias(f"s{i}")) for i in (1, 2))
    pairs = t1.join(t2, F.col("run1") < F.col("run2")).join(met, ["run1", "run2"], "left").fillna(0)  # a row for each run on each side
    tested = pairs.mapInPandas(lambda it: _tests(it, least_overlap), "run1 string, run2 string, test string, statistic double, p double")
    m = totals.agg(F.count(F.lit(1)).alias("k")).select((F.col("k") * (F.col("k") - 1) / 2).alias("m"))
    adjusted = tested.join(F.broadcast(m)).withColumn("adjusted", F.least(F.lit(1.0), F.col("p") * F.col("m")))  # m is one row
    return adjusted.select("run1", "run2", "test", F.round("statistic", 2).alias("statistic"), F.round("p", 5).alias("p"), F.round("adjusted", 5).alias("adjusted"))


def similarity_test(a: DataFrame, b: DataFrame, key: str, value: str, threshold: float = 0.8) -> DataFrame:
    """Two runs' similarities on their common samples: a paired t-test where these cover enough of the smaller run, else an
    independent one; p is multiplied by the number of common samples. One row; six sums reach Python.
    """
    sizes = a.agg(F.count(F.lit(1)).alias("na")).join(F.broadcast(b.agg(F.count(F.lit(1)).alias("nb"))))  # one row each
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.var_samp(F.col("x") - F.col("y")).alias("vd"))

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                share = r.n / min(r.na, r.nb)
                if share >= threshold:
                    kind, (t, p) = "ttest_rel", tails.paired(r.mx - r.my, r.vd, r.n)
                else:
                    kind, (t, p) = "ttest_ind", tails.student(r.mx, r.vx * (r.n - 1), r.n, r.my, r.vy * (r.n - 1), r.n)
                yield pd.DataFrame([(share * 100, kind, float(t), float(p), min(1.0, float(p) * r.n))], columns=["overlap", "test", "statistic", "p", "adjusted"])

    out = sums.join(F.broadcast(sizes)).mapInPandas(tested, "overlap double, test string, statistic double, p double, adjusted double")
    return out.select(F.round("overlap", 4).alias("overlap"), "test", F.round("statistic", 2).alias("statistic"), F.round("p", 5).alias("p"), F.round("adjusted", 5).alias("adjusted"))


def mann_whitney(df: DataFrame, value: str, first: str) -> DataFrame:
    """U of the rows where ``first`` is true, and the two-sided p of the normal approximation with ties and continuity.

    Counts of distinct values are what is ranked: their running sums go by ranges of the value, so no task orders them all.
    """
    n = df.groupBy(F.col(value).alias("v")).agg(F.count_if(F.col(first)).alias("a"), F.count(F.lit(1)).alias("t"))
    ranked = with_running_sum(n, "v", "t", "before")
    s = ranked.agg(
        F.sum((F.col("before") + (F.col("t") + 1) / 2) * F.col("a")).alias("ranks"),
        F.sum("a").cast("double").alias("n1"),
        F.sum("t").cast("double").alias("n"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"),
    )
    s = s.withColumn("u", F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2).withColumn("n2", F.col("n") - F.col("n1"))
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (F.col("n") + 1 - F.col("ties") / (F.col("n") * (F.col("n") - 1))))
    z = F.greatest(F.lit(0.0), (F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5)) / sd

    @F.pandas_udf("double")
    def two_sided(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 2 * tails.normal_sf(x))

    return s.select(F.round("u", 2).alias("u"), F.round(F.least(F.lit(1.0), two_sided(z)), 3).alias("p"))


def letters(k: int, pairs: list[tuple[int, int]], p_values: list[float], alpha: float = 0.05) -> list[str]:
    """Compact letter display: groups that don't differ share a letter; groups are built greedily in their order."""
    differ = {frozenset(pair) for pair, p in zip(pairs, p_values, strict=True) if p < alpha}
    alike = lambda i, group: all(frozenset((i, j)) not in differ for j in group)
    groups: list[list[int]] = []
    for i in range(k):
        fitting = [g for g in groups if alike(i, g)]
        for g in fitting:
            g.append(i)
        if not fitting:
            groups.append([i])
            for j in range(i):
                if alike(j, groups[-1]):
                    groups[-1].append(j)
    return ["".join(chr(97 + n) for n, g in enumerate(groups) if i in g) for i in range(k)]


def macro_accuracy(df: DataFrame, label: str, correct: str) -> DataFrame:
    """The mean over classes of each class's accuracy; one row."""
    return df.groupBy(label).agg(F.avg(F.col(correct).cast("double")).alias("a")).agg(F.avg("a").alias("macro"))


def mixed_mean(df: DataFrame, label: str, value: str, mix: DataFrame) -> DataFrame:
    """Class means weighted to a target mix (label, w); one row."""
    means = df.groupBy(label).agg(F.avg(F.col(value).cast("double")).alias("m"))
    return means.join(mix, label).agg((F.sum(F.col("w") * F.col("m")) / F.sum("w")).alias("mean"))


def conditional_means(df: DataFrame, flag: str, value: str) -> DataFrame:
    """Rows and mean of flagged and of other rows; one row."""
    x, f = F.col(value).cast("double"), F.coalesce(F.col(flag), F.lit(False))
    return df.agg(F.count_if(f).alias("n_flagged"), F.avg(F.when(f, x)).alias("flagged"), F.count_if(~f).alias("n_other"), F.avg(F.when(~f, x)).alias("other"))


def baseline_differences(df: DataFrame, arm: str, run: str, value: str, baseline: str) -> DataFrame:
    """Per arm mean and deviation over runs, and the least and greatest paired difference to the baseline's run."""
    per = df.groupBy(arm, run).agg(F.avg(F.col(value).cast("double")).alias("m"))
    base = per.filter(F.col(arm) == baseline).select(run, F.col("m").alias("b"))
    d = F.col("m") - F.col("b")
    return per.join(base, run, "left").groupBy(arm).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.min(d).alias("least"), F.max(d).alias("most"))


def strict_and_lenient(df: DataFrame, by: str, answer: Column, strict: Column, lenient: Column) -> DataFrame:
    """Per group rows, the share that is answered, and strict and lenient accuracy of what is answered."""
    a = answer.isNotNull()
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(a.cast("double")).alias("answered"), F.avg(F.when(a, strict.cast("double"))).alias("strict"), F.avg(F.when(a, lenient.cast("double"))).alias("lenient"))


def probability_band(p: Column, edges: tuple[float, ...] = (0.5, 0.7, 0.9)) -> Column:
    out = F.lit(f"<{edges[0]:g}")
    for e in edges:
        out = F.when(p >= e, F.lit(f">={e:g}")).otherwise(out)
    return out


def partition_scores(df: DataFrame, text: str, label: str) -> DataFrame:
    """Equal texts as a partition against labels, over pairs: precision, recall, F1; one row. Counts stand in for pairs."""
    pairs = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    both = df.groupBy(text, label).agg(F.count(F.lit(1)).alias("n"))
    hit = both.agg(pairs("n").alias("hit"))
    said = both.groupBy(text).agg(F.sum("n").alias("n")).agg(pairs("n").alias("said"))
    true = both.groupBy(label).agg(F.sum("n").alias("n")).agg(pairs("n").alias("true"))
    one = hit.join(F.broadcast(said)).join(F.broadcast(true))  # one row each
    return one.select((F.col("hit") / F.col("said")).alias("precision"), (F.col("hit") / F.col("true")).alias("recall"), (2 * F.col("hit") / (F.col("said") + F.col("true"))).alias("f1"))


def text_spread(df: DataFrame, text: str, cluster: str) -> DataFrame:
    """Per text its rows and clusters."""
    return df.groupBy(text).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(cluster).alias("clusters"))


def nesting(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    """Per fine class its rows, coarse classes and the greatest share of one of them."""
    n = df.groupBy(fine, coarse).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(fine).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"), (F.max("n") / F.sum("n")).alias("purity"))


def coarse_map(df: DataFrame, term: str, label: str, least: float = 0.2) -> DataFrame:
    """Per term its rows, majority class (ties: the lesser) and the classes with a share of ``least`` or more, sorted."""
    n = df.groupBy(term, label).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(term).agg(F.sum("n").alias("n_term"), F.min_by(label, F.struct(-F.col("n"), label)).alias("majority"))
    kept = n.join(total, term).filter(F.col("n") >= least * F.col("n_term"))
    return kept.groupBy(term, "n_term", "majority").agg(F.array_sort(F.collect_list(label)).alias("classes"))


def second_choice(df: DataFrame, key: str, label: str, unknown: str = "unknown") -> DataFrame:
    """Majority label of a key; where ``unknown`` wins the next one, if there is one."""
    n = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key).agg(F.min_by(label, F.struct((F.col(label) == unknown).cast("int"), -F.col("n"), label)).alias("known"), F.min_by(label, F.struct(-F.col("n"), label)).alias("top")).select(key, F.when(F.col("top") != unknown, F.col("top")).otherwise(F.col("known")).alias("majority"))


def error_shares(df: DataFrame, gold: str, predicted: str, more_than: int = 2) -> DataFrame:
    """Errors only: cells with more than a few, as shares of what is left of their row."""
    n = df.filter(F.col(gold) != F.col(predicted)).groupBy(gold, predicted).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)
    total = n.groupBy(gold).agg(F.sum("n").alias("all"))
    return n.join(total, gold).select(gold, predicted, "n", (F.col("n") / F.col("all")).alias("share"))


def field_matches(rows: DataFrame, sample: str, key: str, kind: str) -> DataFrame:
    """Per field and kind of match the samples that have it: each once."""
    return rows.groupBy(key, kind).agg(F.countDistinct(sample).alias("samples"))


def top_fields(counts: DataFrame, key: str, n: str, most: int) -> DataFrame:
    return counts.orderBy(F.desc(n), key).limit(most)


def exploded_counts(df: DataFrame, label: str, key: str, ids: str) -> DataFrame:
    """Per class rows, rows with ids, distinct samples and distinct ids."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(ids) > 0).alias("with_ids"), F.countDistinct(key).alias("samples"))
    each = df.select(label, F.explode(ids).alias("id")).groupBy(label).agg(F.countDistinct("id").alias("ids"))
    return per.join(each, label, "left").fillna(0, ["ids"])


def size_reduction(df: DataFrame, before: str, after: str) -> DataFrame:
    """Bytes before and after, and the reduction in percent; one row."""
    told = df.agg(F.sum(F.octet_length(before)).alias("before"), F.sum(F.octet_length(after)).alias("after"))
    return told.withColumn("reduction", F.round(100 * (1 - F.col("after") / F.col("before")), 4))


def recall_and_invention(df: DataFrame, by: str, carried: str, mentioned: str) -> DataFrame:
    """Per group how many of the records that have a value are carried, and how many of the others are mentioned all the same."""
    return df.groupBy(by).agg(F.avg(F.when(F.col("present"), F.col(carried).cast("double"))).alias("recall"), F.avg(F.when(~F.col("present"), F.col(mentioned).cast("double"))).alias("invention"))
