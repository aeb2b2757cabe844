"""Readers of record dumps, tables, term files and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``>ID`` lines, each followed by key=value lines: sample_id, pos, key, value.

    Records are split at line starts with ``>``, so plain files split between tasks; gzip files are dealt out after the
    scan. Lines without ``=`` have a null value; records with an empty id are left out.
    """
    text = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("record"))
    if path.endswith(".gz"):
        text = text.repartition(spark.sparkContext.defaultParallelism * 4)
    lines = F.split("record", "\r?\n")
    rows = text.select(F.trim(F.get(lines, F.lit(0))).alias("sample_id"), F.posexplode_outer(F.slice(lines, 2, F.size(lines))).alias("pos", "line"))
    line = F.trim("line")
    cut = F.instr(line, "=")
    return rows.filter((F.col("sample_id") != "") & (F.coalesce(line, F.lit("")) != "")).select(
        "sample_id", "pos", F.trim(F.when(cut > 0, F.substring(line, F.lit(1), cut - 1)).otherwise(line)).alias("key"), F.when(cut > 0, F.trim(F.substring(line, cut + 1, F.char_length(line)))).alias("value")
    )


def record_text(records: DataFrame, drop_keys: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """sample_id and text: cleaned ``key=value`` parts in order without repeats, joined by ``; ``; cut only if asked."""
    from metaloam.functions.text import is_missing

    key = F.regexp_replace(F.lower("key"), "^(sample|study)_", "")
    kept = records.filter(~is_missing(F.col("value")) & ~key.isin(*drop_keys) & ~key.rlike("^(experiment|run)"))
    part = kept.select("sample_id", "pos", F.concat(key, F.lit("="), F.col("value")).alias("part"))
    joined = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])), "; ")
    return part.groupBy("sample_id").agg((joined if most is None else F.substring(joined, 1, most)).alias("text"))


def read_strings(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """A table with a header, all columns strings, empty cells as empty strings."""
    return spark.read.csv(path, sep=sep, header=True, quote="", nullValue="\0").fillna("")


def read_pairs(spark: SparkSession, path: str, keywords: bool = False) -> DataFrame:
    """``id<TAB>text`` lines without a header: cleaned, malformed and missing ones left out."""
    from metaloam.functions.text import clean_text, is_missing

    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("sample_id"), clean_text(F.get(parts, F.lit(1)), keywords).alias("text"))
    return rows.filter((F.col("sample_id") != "") & ~is_missing(F.col("text"), "answer"))


def read_terms(spark: SparkSession, path: str, prefix: str, name: str = "") -> DataFrame:
    """``[Term]`` stanzas of an OBO file with the prefix: ontology, term_id, label, synonyms, definition, parents, obsolete."""
    text = spark.read.text(path, lineSep="\n\n").filter(F.trim("value").startswith("[Term]"))

    def one(tag: str) -> F.Column:
        return F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{tag}: *(.*)$", 1)), F.lit(""))

    quoted = F.nullif(F.regexp_extract("value", r'(?m)^def: *"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    out = text.select(
        F.lit(name or prefix.lower()).alias("ontology"), one("id").alias("term_id"), one("name").alias("label"),
        F.regexp_extract_all("value", F.lit(r'(?m)^synonym: *"((?:[^"\\]|\\.)*)"'), F.lit(1)).alias("synonyms"), quoted.alias("definition"),
        F.regexp_extract_all("value", F.lit(r"(?m)^is_a: *([^\s!]+)"), F.lit(1)).alias("parents"), F.regexp_like("value", F.lit(r"(?m)^is_obsolete: *true")).alias("obsolete"),
    )
    return out.filter(F.col("term_id").startswith(f"{prefix}:"))


def read_owl(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Classes of an OWL RDF/XML file: term_id, label, parents, obsolete."""
    schema = T.StructType(
        [
            T.StructField("_rdf:about", T.StringType()),
            T.StructField("rdfs:label", T.ArrayType(T.StringType())),
            T.StructField("rdfs:subClassOf", T.ArrayType(T.StructType([T.StructField("_rdf:resource", T.StringType())]))),
            T.StructField("owl:deprecated", T.StringType()),
        ]
    )
    raw = spark.read.format("xml").option("rowTag", "owl:Class").schema(schema).load(path)
    code = lambda c: F.replace(F.regexp_extract(c, r"([A-Za-z]+_\w+)$", 1), F.lit("_"), F.lit(":"))
    out = raw.select(code(F.col("`_rdf:about`")).alias("term_id"), F.get(F.col("`rdfs:label`"), F.lit(0)).alias("label"), F.filter(F.transform(F.coalesce(F.col("`rdfs:subClassOf`"), F.array()), lambda p: code(p["_rdf:resource"])), lambda p: p != "").alias("parents"), (F.lower(F.coalesce(F.col("`owl:deprecated`"), F.lit(""))) == "true").alias("obsolete"))
    return out.filter(F.col("term_id").startswith(f"{prefix}:"))


def read_json_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of id to embedding and labels: sample_id, embedding, sub_biome, biome.

    Entries are told apart by the brace and comma that end one, so a file of any size is split between tasks and no row
    holds more than an entry.
    """
    value = "struct<embedding:array<float>,`sub-biome`:string,biome:string>"
    entries = spark.read.text(path, lineSep="},").select(F.trim(F.regexp_replace("value", r"[\s,}]+$", "")).alias("value"))
    found = r'(?s)^[\s{]*"((?:[^"\\]|\\.)*)"\s*:\s*(\{.*)$'
    rows = entries.filter(F.col("value").rlike(found)).select(F.regexp_extract("value", found, 1).alias("sample_id"), F.from_json(F.concat(F.regexp_extract("value", found, 2), F.lit("}")), value).alias("v"))
    return rows.select("sample_id", "v.embedding", F.col("v.`sub-biome`").alias("sub_biome"), "v.biome")


def read_meta_lines(spark: SparkSession, path: str) -> DataFrame:
    """``word id , meta {json}`` lines: sample_id and a map."""
    parts = F.split("value", r" , meta (?=\{)", 2)
    return spark.read.text(path).filter(F.size(parts) == 2).select(F.get(F.split(F.get(parts, F.lit(0)), r"\s+"), F.lit(1)).alias("sample_id"), F.from_json(F.get(parts, F.lit(1)), "map<string,string>").alias("meta"))


def read_labelled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Headerless CSV with two columns or more: sample and predicted, and apart from them the malformed lines."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parts = F.from_csv("value", F.lit("sample string, predicted string"), {"mode": "PERMISSIVE"})
    rows = lines.select("value", parts.alias("p")).select("value", "p.*")
    good = F.col("sample").isNotNull() & F.col("predicted").isNotNull()
    return rows.filter(good).drop("value"), rows.filter(~good).select("value")


def read_clusters(spark: SparkSession, path: str, noise: str = "-1") -> DataFrame:
    """``run.sample<TAB>cluster`` lines after a header: samples whose runs all agree, without noise."""
    rows = spark.read.csv(path, sep="\t", header=True).toDF("sid", "cluster_id")
    kept = rows.filter(F.col("cluster_id") != noise).select(F.regexp_replace("sid", r"^[^.]*\.", "").alias("sample_id"), "cluster_id")
    per = kept.groupBy("sample_id").agg(F.min("cluster_id").alias("cluster_id"), F.max("cluster_id").alias("_other"))
    return per.filter(F.col("cluster_id") == F.col("_other")).select("sample_id", "cluster_id")
