"""Mapping texts to terms, decoding candidates, proposals and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metaloam.functions.text import is_missing, squeeze


def exact_index(terms: DataFrame) -> DataFrame:
    """name and term: each label and synonym of ``terms`` (term, label, synonyms), folded; labels win, then the lesser term."""
    fold = lambda c: squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    names = terms.select("term", fold(F.col("label")).alias("name"), F.lit(0).alias("rank")).union(terms.select("term", F.explode("synonyms").alias("s")).select("term", fold(F.col("s")), F.lit(1)))
    return names.filter("name <> ''").groupBy("name").agg(F.min_by("term", F.struct("rank", "term")).alias("term"))


def exact_terms(rows: DataFrame, text: str, index: DataFrame) -> DataFrame:
    """``rows`` with the term whose label or synonym the text is, null for none."""
    folded = squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))
    return rows.withColumn("_name", folded).join(index.withColumnRenamed("name", "_name"), "_name", "left").drop("_name")


def decode_candidates(found: DataFrame, sample: str, paths: DataFrame, allowed: DataFrame, tau: float) -> DataFrame:
    """Per sample (sample, label, p) the deepest allowed node whose mass reaches tau: pick and q; ties to more mass, then the
    lesser name. Samples without one abstain.
    """
    depth = paths.filter("distance > 0").groupBy("node").agg(F.count(F.lit(1)).alias("depth"))
    mass = found.join(paths.select(F.col("node").alias("label"), "ancestor"), "label").groupBy(sample, F.col("ancestor").alias("node")).agg(F.sum("p").alias("q"))
    fits = mass.filter(F.col("q") >= tau - 1e-12).join(allowed, "node", "left_semi").join(depth, "node", "left")
    rank = F.struct(-F.coalesce("depth", F.lit(0)), -F.round("q", 9), "node")
    picked = fits.groupBy(sample).agg(F.min_by(F.struct(F.col("node").alias("pick"), "q"), rank).alias("r")).select(sample, "r.*")
    return found.select(sample).distinct().join(picked, sample, "left")


def flat_decode(found: DataFrame, sample: str, tau: float) -> DataFrame:
    """Per sample its most probable label, null where it doesn't reach tau."""
    top = found.groupBy(sample).agg(F.min_by(F.struct("label", "p"), F.struct(-F.col("p"), "label")).alias("t"))
    return top.select(sample, F.when(F.col("t.p") >= tau, F.col("t.label")).alias("pick"))


def proposal(vote: Column, model: Column, nearest: Column) -> Column:
    """What three ways of relabelling agree on: the label and by how many it is meant; null where all differ."""
    agreed = F.when((vote == model) & (model == nearest), F.struct(vote.alias("label"), F.lit(3).alias("n")))
    for a, b in ((vote, model), (vote, nearest), (model, nearest)):
        agreed = F.coalesce(agreed, F.when(a == b, F.struct(a.alias("label"), F.lit(2).alias("n"))))
    return agreed


def broader_lists(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """Per broader node the labels at or below it, sorted; only nodes with several."""
    below = paths.join(labels.select(F.col("label").alias("node")), "node", "left_semi").groupBy("ancestor").agg(F.array_sort(F.collect_set("node")).alias("labels"))
    return below.filter(F.size("labels") > 1)


def unpivoted(rows: DataFrame, key: str, slots: tuple[str, ...], prefixes: tuple[str, ...]) -> DataFrame:
    """One row for each sample, slot and value ``a;b`` of an allowed prefix: key, slot, value."""
    each = rows.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, slots)), F.array(*(F.col(s).cast("string") for s in slots)))).alias("slot", "values"))
    split = each.select(key, "slot", F.explode(F.split("values", ";")).alias("value")).select(key, "slot", F.trim("value").alias("value"))
    return split.filter(F.regexp_extract("value", "^([A-Za-z]+)[:_]", 1).isin(*prefixes)).distinct()


def value_inventory(rows: DataFrame, columns: tuple[str, ...], profile: str = "record") -> DataFrame:
    """Per column how many values are missing words, null, and other: column, missing, nulls, other. One pass."""
    told = rows.agg(*(F.struct(F.count_if(F.col(c).isNotNull() & is_missing(F.col(c).cast("string"), profile)).alias("missing"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c)["missing"].alias("missing"), F.col(c)["nulls"].alias("nulls"), (F.col(c)["n"] - F.col(c)["missing"] - F.col(c)["nulls"]).alias("other")) for c in columns))
    return told.select(F.explode(each).alias("r")).select("r.*")


def swapped_coordinates(rows: DataFrame, key: str, reversals: DataFrame, order: str) -> DataFrame:
    """Samples with both coordinates, the last of each by ``order``; those of the reversal list with the two exchanged."""
    last = rows.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(key).agg(F.max_by(F.struct("lat", "lon"), order).alias("c"), F.count(F.lit(1)).alias("n"))
    both = last.join(reversals.select(key, F.lit(True).alias("_r")).distinct(), key, "left")
    return both.select(key, F.when(F.col("_r"), F.col("c.lon")).otherwise(F.col("c.lat")).alias("lat"), F.when(F.col("_r"), F.col("c.lat")).otherwise(F.col("c.lon")).alias("lon"), (F.col("n") > 1).alias("repeated"))


def escaped_line(*values: Column) -> Column:
    """Columns as one tab-separated line; tabs and line breaks inside become backslash escapes, nulls empty cells."""
    return F.concat_ws("\t", *(F.replace(F.replace(F.replace(F.coalesce(v.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\t"), F.lit("\\t")), F.lit("\n"), F.lit("\\n")) for v in values))


def validated(rows: DataFrame, required: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required values, and the rejected others with the first one that they lack."""
    missing = F.coalesce(*(F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required))
    told = rows.withColumn("lacks", missing)
    return told.filter("lacks IS NULL").drop("lacks"), told.filter("lacks IS NOT NULL")


def first_per_text(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Each distinct text with its least key."""
    return rows.filter(F.col(text).isNotNull()).groupBy(text).agg(F.min(key).alias(key))


def marker_counts(old: DataFrame, new: DataFrame, key: str, text: str, markers: dict[str, str]) -> DataFrame:
    """Samples of both runs: per marker how many texts have it before and after: marker, old, new."""
    both = old.select(key, F.col(text).alias("_a")).join(new.select(key, F.col(text).alias("_b")), key)
    told = both.agg(*(F.struct(F.count_if(F.col("_a").rlike(p)).alias("old"), F.count_if(F.col("_b").rlike(p)).alias("new")).alias(n) for n, p in markers.items()))
    return told.select(F.explode(F.array(*(F.struct(F.lit(n).alias("marker"), F.col(n)["old"].alias("old"), F.col(n)["new"].alias("new")) for n in markers))).alias("r")).select("r.*")
