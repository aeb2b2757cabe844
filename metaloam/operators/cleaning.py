"""Cleaning of records and labels: field filters, status cascades, audits, overrides and label maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metaloam.functions.text import canonical, is_missing, numbers, tokens

#: Decisions that a review may take.
DECISIONS = ("keep", "drop", "control")


def clean_lines(lines: DataFrame, line: str, labels: DataFrame, drop: tuple[str, ...] = ("experiment", "run")) -> DataFrame:
    """``key=value`` lines, cleaned: keys that start with a dropped word and missing values go, codes (table of code and
    label) become quoted labels, lines without ``=`` stay as they are.
    """
    key, value = F.split_part(F.col(line), F.lit("="), F.lit(1)), F.substring(F.col(line), F.instr(F.col(line), "=") + 1, F.char_length(line))
    paired = F.contains(F.col(line), F.lit("="))
    rows = lines.withColumns({"_key": F.when(paired, key), "_value": F.when(paired, value)})
    unwanted = reduce(lambda a, b: a | b, (F.lower("_key").startswith(x) for x in drop)) | is_missing(F.col("_value"))
    rows = rows.filter(~paired | ~unwanted).join(labels.select(F.col("code").alias("_value"), F.col("label").alias("_label")), "_value", "left")
    cleaned = F.when(~paired, F.col(line)).otherwise(F.concat("_key", F.lit("="), F.coalesce(F.concat(F.lit('"'), "_label", F.lit('"')), "_value")))
    return rows.select(*(c for c in lines.columns if c != line), cleaned.alias(line))


def record_text(lines: DataFrame, sample: str, pos: str, line: str, drop: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Per sample its distinct lines in order, keys lower-cased without sample or study prefix, joined; cut only if asked."""
    key = F.regexp_replace(F.lower(F.split_part(F.col(line), F.lit("="), F.lit(1))), "^(sample|study)_", "")
    value = F.trim(F.substring(F.col(line), F.instr(F.col(line), "=") + 1, F.char_length(line)))
    rows = lines.filter(F.contains(F.col(line), F.lit("="))).select(sample, pos, key.alias("_key"), value.alias("_value")).filter(~F.col("_key").isin(*drop) & ~is_missing(F.col("_value")))
    once = rows.groupBy(sample, "_key", "_value").agg(F.min(pos).alias("_pos"))
    parts = once.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct("_pos", F.concat("_key", F.lit(": "), "_value").alias("t")))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["t"]), "; ")
    return parts.select(sample, (text if most is None else F.substring(text, 1, most)).alias("text"))


def label_status(labels: DataFrame, value: str, terms: DataFrame, ontologies: tuple[str, ...], control: tuple[str, ...]) -> DataFrame:
    """``labels`` with term (PREFIX_digits or '') and status: empty, control_value, no_code, not_in_index, obsolete,
    other_ontology or ok, the first in this order. ``terms``: term, obsolete (boolean).
    """
    raw = F.trim(F.coalesce(F.col(value), F.lit("")))
    prefix, digits = (F.regexp_extract(raw, r"([A-Za-z]+)[:_](\d+)", i) for i in (1, 2))
    term = F.when(digits != "", F.concat(F.upper(prefix), F.lit("_"), digits)).otherwise("")
    rows = labels.withColumn("term", term).join(terms.select("term", F.col("obsolete").alias("_obsolete")), "term", "left")
    status = (
        F.when(raw == "", "empty")
        .when((F.col("term") == "") & F.lower(raw).isin(*control), "control_value")
        .when(F.col("term") == "", "no_code")
        .when(~F.upper(prefix).isin(*ontologies), "other_ontology")
        .when(F.col("_obsolete"), "obsolete")
        .when(F.col("_obsolete").isNull(), "not_in_index")
        .otherwise("ok")
    )
    return rows.withColumn("status", status).drop("_obsolete").select(*labels.columns, "term", "status")


def mapped_label(labels: DataFrame, slot: str, term: str, status: str, mapping: DataFrame) -> DataFrame:
    """``clean``: the target of (slot, term), else of ('*', term), else the term where its status is ok, else ''.

    ``mapping``: slot, from_id, to_id; a blank target counts.
    """
    own = mapping.select(F.trim("slot").alias("_slot"), F.trim("from_id").alias("_from"), F.trim(F.coalesce("to_id", F.lit(""))).alias("_to"))
    exact = own.filter("_slot <> '*'").withColumnRenamed("_to", "_exact")
    wide = own.filter("_slot = '*'").select(F.col("_from").alias("_any_from"), F.col("_to").alias("_any"))
    rows = labels.join(exact, (F.col(slot) == F.col("_slot")) & (F.col(term) == F.col("_from")), "left").join(wide, F.col(term) == F.col("_any_from"), "left")
    return rows.select(*labels.columns, F.coalesce("_exact", "_any", F.when(F.col(status) == "ok", F.col(term)).otherwise("")).alias("clean"))


def audit_hits(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text has, points and underscores read as spaces."""
    spaced = F.regexp_replace(text, "[_.]+", " ")
    return F.filter(F.array(*(F.when(spaced.rlike(p), F.lit(n)) for n, p in patterns.items())), lambda x: x.isNotNull())


def control_evidence(sub_biome: Column, keywords: Column, sub: str, strong: str, weak: str, lab_sub: str, lab_keyword: str) -> Column:
    """What makes a sample a control: its sub-biome, a strong keyword, or a weak one in the context of a laboratory; else ''."""
    first = lambda pattern: F.get(F.filter(keywords, lambda k: k.rlike(pattern)), F.lit(0))
    lab = sub_biome.rlike(lab_sub) | F.exists(keywords, lambda k: k.rlike(lab_keyword))
    return (
        F.when(sub_biome.rlike(sub), F.concat(F.lit("sub-biome: "), sub_biome))
        .when(first(strong).isNotNull(), F.concat(F.lit("keyword: "), first(strong)))
        .when(first(weak).isNotNull() & lab, F.concat(F.lit("keyword + lab context: "), first(weak)))
        .otherwise("")
    )


def checked_overrides(rules: DataFrame) -> DataFrame:
    """Rules with a decision, lower-cased; an unknown decision, or a missing column, is an error."""
    if missing := {"scope", "id", "pattern", "decision"} - set(rules.columns):
        raise ValueError(f"rules need {sorted(missing)}")
    own = rules.withColumn("decision", F.lower(F.trim("decision"))).filter("decision <> ''")
    if bad := [r["decision"] for r in own.filter(~F.col("decision").isin(*DECISIONS)).select("decision").distinct().limit(10).collect()]:
        raise ValueError(f"unknown decisions {bad}")
    return own


def overridden(samples: DataFrame, rules: DataFrame, study: str, sample: str, text: str) -> DataFrame:
    """``decision`` of the last rule that fits a sample: study rules first, then sample rules, each in their order.

    ``rules``: rule_order, scope ('study' or 'sample'), id, pattern (null or '': any text), decision. A key that a third of
    the samples share is met by few rules, so the join is on the rules' side small, and adaptive execution splits it.
    """
    fits = None
    for rank, (scope, key) in enumerate((("study", study), ("sample", sample))):
        own = rules.filter(F.col("scope") == scope).select(F.col("id").alias(key), "pattern", "decision", F.struct(F.lit(rank).alias("rank"), "rule_order").alias("_at"))
        met = samples.select(sample, study, text).join(own, key).filter((F.coalesce("pattern", F.lit("")) == "") | F.expr(f"regexp_like({text}, pattern)")).select(sample, "decision", "_at")
        fits = met if fits is None else fits.unionByName(met)
    last = fits.groupBy(sample).agg(F.max_by("decision", "_at").alias("decision"))
    return samples.join(last, sample, "left")


def carries(value: Column, keywords: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The keywords carry a value: one of its numbers, or, for one without numbers, one of its canonical words."""
    n, words = numbers(value), F.transform(F.transform(tokens(value), F.lower), lambda w: canonical(w, synonyms or {}))
    known = F.transform(F.transform(tokens(keywords), F.lower), lambda w: canonical(w, synonyms or {}))
    return F.when(F.size(n) > 0, F.arrays_overlap(n, numbers(keywords))).otherwise(F.arrays_overlap(words, known))


def leaks(value: Column, term_id: Column, label: Column) -> Column:
    """The value tells its gold label: it has the term's id in either spelling, or equals or holds the label."""
    low = F.lower(F.trim(value))
    other = F.replace(F.lower(term_id), F.lit("_"), F.lit(":"))
    return F.contains(low, F.lower(term_id)) | F.contains(low, other) | F.contains(low, F.lower(F.trim(label)))


def first_values(rows: DataFrame, key: str, field: str, value: str, priority: tuple[str, ...], most: int) -> DataFrame:
    """Per key its first ``most`` distinct values, fields in the order of priority; other fields are left out."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(field))
    once = rows.withColumn("_rank", rank).filter("_rank > 0").groupBy(key, value).agg(F.min("_rank").alias("_rank"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_rank", value))
    kept = once.withColumn("_n", place).filter(F.col("_n") <= most)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias("picked"))


def matching(df: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """Rows that equal every given value; null asks for null."""
    for c, v in conditions.items():
        df = df.filter(F.col(c).eqNullSafe(F.lit(v)))
    return df


def differing_columns(df: DataFrame) -> DataFrame:
    """Columns with several values (null counts as one): column and n. One pass; counts are approximate only above none."""
    told = df.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("n"), F.count(F.lit(1)).alias("all")).alias(c) for c in df.columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), ((F.col(c)["lo"] < F.col(c)["hi"]) | ((F.col(c)["n"] > 0) & (F.col(c)["n"] < F.col(c)["all"]))).alias("differs")) for c in df.columns))
    return told.select(F.explode(rows).alias("r")).select("r.*").filter("differs").select("column")


def telling_tokens(names: DataFrame, name: str) -> DataFrame:
    """Parts of names between signs that not every name has: token and n."""
    each = names.select(name, F.explode(F.array_distinct(tokens(F.col(name)))).alias("token"))
    total = names.agg(F.countDistinct(name).alias("all"))
    n = each.groupBy("token").agg(F.countDistinct(name).alias("n"))
    return n.join(F.broadcast(total)).filter("n < all").select("token", "n")  # total is one row


def finite_rows(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has no null, NaN or infinite part."""
    return df.filter(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def review_table(rows: DataFrame, study: str, hits: str, modal: str, text: str, patterns: dict[str, str], around: int = 60, examples: int = 3) -> DataFrame:
    """Per study and audit name: samples hit, samples of the study, the most frequent ``modal`` and examples in context."""
    size = rows.groupBy(study).agg(F.count(F.lit(1)).alias("n_study"))
    each = rows.select(study, modal, text, F.explode(hits).alias("hit"))
    spot = F.lit("")
    for name, p in patterns.items():
        spot = F.when(F.col("hit") == name, F.regexp_extract(F.regexp_replace(text, "[_.]+", " "), f"(.{{0,{around}}}(?:{p}).{{0,{around}}})", 1)).otherwise(spot)
    each = each.withColumn("spot", spot)
    counts = each.groupBy(study, "hit", modal).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(study, "hit").agg(F.sum("n").alias("n_hit"), F.min_by(modal, F.struct(-F.col("n"), modal)).alias("modal"))
    shown = each.groupBy(study, "hit", "spot").agg(F.lit(1).alias("one"))
    place = F.row_number().over(Window.partitionBy(study, "hit").orderBy("spot"))
    shown = shown.withColumn("_n", place).filter(F.col("_n") <= examples).groupBy(study, "hit").agg(F.array_sort(F.collect_list("spot")).alias("examples"))
    return top.join(size, study).join(shown, [study, "hit"])
