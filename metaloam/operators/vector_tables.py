"""Vector tables: a dictionary of distinct texts, gathers, pair statistics, corrected neighbours and nearest terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloam.functions import vectors as V
from metaloam.operators.ordering import top_per


def encoded(rows: DataFrame, text: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows without their vector but with vec_id, and a dictionary (vec_id, text, vector) of distinct texts.

    vec_id is the text's digest, so no numbering orders all texts; a text's vector is its first by partial aggregation.
    """
    keyed = rows.withColumn("vec_id", F.md5(F.col(text).cast("binary")))
    return keyed.drop(vector), keyed.filter(F.col(text).isNotNull()).groupBy("vec_id").agg(F.first(text).alias(text), F.first(vector).alias(vector))


def decoded(facts: DataFrame, dictionary: DataFrame, vector: str) -> DataFrame:
    """Each row with its unit vector; null where the dictionary lacks it."""
    return facts.join(dictionary.select("vec_id", V.unit(F.col(vector)).alias(vector)), "vec_id", "left")


def gathered(wanted: DataFrame, dictionary: DataFrame, key: str, vector: str, strict: bool = False) -> DataFrame:
    """Every wanted row, repeats too, with its vector and ``found``; a missing one is an error if ``strict``."""
    distinct = dictionary.groupBy(key).agg(F.first(vector).alias(vector))
    out = wanted.join(distinct, key, "left").withColumn("found", F.col(vector).isNotNull())
    if strict and not out.filter("NOT found").isEmpty():
        raise ValueError("vectors are missing: " + ", ".join(str(r[0]) for r in out.filter("NOT found").select(key).distinct().limit(5).collect()))
    return out


def latest_snapshot(names: DataFrame, name: str, kinds: tuple[str, ...]) -> DataFrame:
    """Files ``<domain>_<kind>_<date>`` of the latest date that has any: domain, kind, date, name; a domain that lacks a
    kind at that date is an error.
    """
    found = names.select(name, *(F.regexp_extract(name, rf"^(.*)_({'|'.join(kinds)})_(\d{{8}})\.tsv(?:\.gz)?$", i + 1).alias(c) for i, c in enumerate(("domain", "kind", "date")))).filter("date <> ''")
    last = found.agg(F.max("date").alias("date"))
    kept = found.join(F.broadcast(last), "date")  # one row
    short = kept.groupBy("domain").agg(F.countDistinct("kind").alias("n")).filter(F.col("n") < len(kinds))
    if missing := [r["domain"] for r in short.orderBy("domain").limit(5).collect()]:
        raise ValueError(f"files are missing for {missing}")
    return kept.select("domain", "kind", "date", name)


def pair_statistics(pairs: DataFrame, sim: str, same: str) -> DataFrame:
    """Pairs of equal and of different labels: numbers, means, their gap, and Cohen's d with pooled deviation; one row."""
    s, d = F.when(F.col(same), F.col(sim)), F.when(~F.col(same), F.col(sim))
    told = pairs.agg(F.count(s).alias("n_same"), F.count(d).alias("n_different"), F.avg(s).alias("same"), F.avg(d).alias("different"), F.var_samp(s).alias("_vs"), F.var_samp(d).alias("_vd"))
    pooled = F.sqrt(((F.col("n_same") - 1) * F.col("_vs") + (F.col("n_different") - 1) * F.col("_vd")) / (F.col("n_same") + F.col("n_different") - 2))
    return told.withColumn("gap", F.col("same") - F.col("different")).withColumn("cohens_d", F.col("gap") / pooled).drop("_vs", "_vd")


def shifted_pairs(rows: DataFrame, key: str, place: str, n: int, shift: int) -> DataFrame:
    """Each row paired with the one ``shift`` places on, around the end: a shuffled background without a cross join.

    ``place`` numbers the rows from 0 to n - 1, such as a stable random order.
    """
    other = rows.select(F.pmod(F.col(place) - shift, F.lit(n)).alias(place), *(F.col(c).alias(f"{c}_2") for c in rows.columns if c != place))
    return rows.join(other, place)


def lift(aligned: DataFrame, background: DataFrame, sim: str) -> DataFrame:
    """Mean similarity of aligned and of background pairs, and how much the first is above; one row."""
    a, b = (x.agg(F.avg(sim).alias(n), F.stddev_pop(sim).alias(f"{n}_sd")) for x, n in ((aligned, "aligned"), (background, "background")))
    return a.join(F.broadcast(b)).withColumn("lift", F.col("aligned") - F.col("background"))  # one row each


def hub_corrected(found: DataFrame, local: DataFrame) -> DataFrame:
    """Similarities less half of an item's mean similarity to its own neighbours (item_id, mean), ranked again."""
    out = found.join(local.select("item_id", F.col("mean").alias("_m")), "item_id", "left").withColumn("sim", F.round(F.col("sim") - F.coalesce("_m", F.lit(0.0)) / 2, 9)).drop("_m", "rank")
    best = F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "item_id")))
    return out.groupBy("query_id").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("rank", "x")).select("query_id", F.col("x.item_id").alias("item_id"), (-F.col("x.s")).alias("sim"), (F.col("rank") + 1).alias("rank"))


def top_mean(found: DataFrame, k: int) -> DataFrame:
    """Mean of a query's k greatest similarities, and the item of the greatest."""
    kept = found.filter(F.col("rank") <= k)
    return kept.groupBy("query_id").agg(F.avg("sim").alias("mean"), F.min_by("item_id", "rank").alias("nearest"))


def weighted_vote(found: DataFrame, labels: DataFrame, tau: float, prior: DataFrame | None = None, power: float = 0.0) -> DataFrame:
    """Votes of weight exp((sim - greatest) / tau), times a class's frequency to a power: query_id, predicted, share."""
    top = found.groupBy("query_id").agg(F.max("sim").alias("_top"))
    votes = found.join(top, "query_id").join(labels.select(F.col("id").alias("item_id"), "label"), "item_id").groupBy("query_id", "label").agg(F.sum(F.exp((F.col("sim") - F.col("_top")) / tau)).alias("w"))
    if prior is not None:
        votes = votes.join(prior.select("label", F.col("share").alias("_p")), "label").withColumn("w", F.col("w") * F.pow("_p", F.lit(power)))
    votes = votes.withColumn("w", F.round("w", 9))
    return votes.groupBy("query_id").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("predicted"), (F.max("w") / F.sum("w")).alias("share"))


def group_at_k(found: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Per query the share of its k neighbours of its own group, over what can be reached: min(others of the group, k) / k.

    ``rows``: id, grp. Queries alone in their group are left out.
    """
    sizes = rows.groupBy("grp").agg((F.count(F.lit(1)) - 1).alias("others"))
    own = rows.join(sizes, "grp").filter("others > 0").select(F.col("id").alias("query_id"), "grp", "others")
    theirs = rows.select(F.col("id").alias("item_id"), F.col("grp").alias("g"))
    met = found.filter(F.col("rank") <= k).join(theirs, "item_id").join(own, "query_id")
    share = F.avg((F.col("g") == F.col("grp")).cast("double"))
    return met.groupBy("query_id", "others").agg(share.alias("share")).select("query_id", "share", (F.col("share") / (F.least("others", F.lit(k)) / k)).alias("of_reachable"))


def agreeing_nearest(found: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Nearest neighbours of a similarity of ``least`` or more: how many queries have one, and how many share its label; one row."""
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("a"))
    theirs = labels.select(F.col("id").alias("item_id"), F.col("label").alias("b"))
    near = found.filter((F.col("rank") == 1) & (F.col("sim") >= least)).join(own, "query_id").join(theirs, "item_id")
    return near.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("agree"))


def nearest_terms(keywords: DataFrame, found: DataFrame, terms: DataFrame, key: str, word: str, least: float) -> DataFrame:
    """Per row its keywords' nearest terms, in order and each once; a keyword without a near term stays itself.

    ``keywords``: key, words (array); ``found``: word, term_id, sim; ``terms``: term_id, term.
    """
    near = found.filter(F.col("sim") >= least).groupBy(word).agg(F.max_by("term_id", F.struct("sim", -F.col("term_id"))).alias("term_id")).join(terms, "term_id").select(word, "term")
    each = keywords.select(key, F.posexplode("words").alias("pos", word)).join(near, word, "left").withColumn("t", F.coalesce("term", word))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"])
    return each.groupBy(key).agg(F.array_distinct(listed).alias("terms"))




def k_nearest_euclidean(pairs: DataFrame, query: str, a: str, b: str, item: str, k: int) -> DataFrame:
    """Of given candidate pairs the k items of the least distance to a query (ties: the lesser item)."""
    return top_per(pairs.withColumn("distance", F.round(V.euclidean(F.col(a), F.col(b)), 6)), [query], k, "distance", item)


def request_batch(rows: DataFrame, p: str, quantile: float, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows less sure than the quantile of their probabilities, as requests of distinct content and the rows that each answers.

    The quantile is exact; a request is the digest of its content.
    """
    limit = rows.agg(F.percentile(p, F.lit(quantile)).alias("_limit"))
    asked = rows.join(F.broadcast(limit)).filter(F.col(p) < F.col("_limit")).withColumn("request", F.md5(F.concat_ws("\t", *content).cast("binary"))).drop("_limit")  # one row
    return asked.groupBy("request").agg(*(F.first(c).alias(c) for c in content), F.count(F.lit(1)).alias("n")), asked
