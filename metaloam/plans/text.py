"""Queries on text, measurements and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.functions import measure as M
from metaloam.functions import text as X
from metaloam.functions.stable import stable_fold, stable_key, stable_share
from metaloam.operators import agreement, models, ordering
from metaloam.operators.shared import stored
from metaloam.registry import query, table

_TOK = "regexp_extract_all(text, '[A-Za-z0-9]+')"


@query(f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({_TOK})) AS term FROM documents) GROUP BY term HAVING count(*) >= 3")
def token_df(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 3")


@query(f"""WITH n AS (SELECT term, count(*) AS n FROM (SELECT unnest({_TOK}) AS term FROM documents) GROUP BY term)
SELECT count(*) AS vocabulary, sum(n)::BIGINT AS uses, (sum(n) FILTER (WHERE n >= 10))::BIGINT AS uses_10, (sum(n) FILTER (WHERE n >= 100))::BIGINT AS uses_100 FROM n""")
def token_mass(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("uses"), F.sum(F.when(F.col("n") >= 10, F.col("n"))).alias("uses_10"), F.sum(F.when(F.col("n") >= 100, F.col("n"))).alias("uses_100"))


@query(f"""WITH t AS (SELECT doc_id, source, unnest(list_distinct({_TOK})) AS term FROM documents), s AS (SELECT term FROM t GROUP BY term HAVING count(DISTINCT source) >= 5)
SELECT doc_id, count(s.term) AS kept, count(*) AS of FROM t LEFT JOIN s USING (term) GROUP BY doc_id""")
def identity_strip(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    # folded to (term, source) first, so a word of all documents is a row for each source
    shared = stored(t.groupBy("term", "source").agg(F.lit(1).alias("one")).filter("source IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5").select("term", F.lit(1).alias("k")), "shared-terms")
    few = shared.count() <= models.BROADCAST_TERMS
    return t.join(F.broadcast(shared) if few else shared, "term", "left").groupBy("doc_id").agg(F.count("k").alias("kept"), F.count(F.lit(1)).alias("of"))


@query(r"""SELECT p_partkey, round(CASE WHEN greatest(length(p_name), length(p_type)) > 0 THEN 1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE ELSE 1 END, 6) AS levenshtein,
round(CASE WHEN len(list_distinct(list_concat(a, b))) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE ELSE 0 END, 6) AS jaccard,
contains(lower(trim(p_name)), lower(trim(p_type))) OR contains(lower(trim(p_type)), lower(trim(p_name))) AS lenient
FROM (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(p_name, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 2)) AS a,
list_distinct(list_filter(list_transform(regexp_extract_all(p_type, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 2)) AS b FROM part)""")
def string_similarity(spark, sf_dir):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.levenshtein_similarity(a, b), 6).alias("levenshtein"), F.round(X.jaccard(X.token_set(a), X.token_set(b)), 6).alias("jaccard"), X.lenient_match(a, b).alias("lenient"))


#: Worked cases of the rules, as the oracle expects them.
VALUES = ("NA", "Sea level.", "2300 masl", "500 ft", "1.2 km", "30 cm", "1200m", "12,5", "100-200", "100-200 m", "abc", "12,000", "1.234,56", "1,234.56", "-5")
_CLASSES = ("missing", "sea_level", "masl", "feet", "km", "cm", "meters", "bare_number", "range_or_composite", "meters", "other", "bare_number", "bare_number", "bare_number", "bare_number")
_METRES = (None, 0.0, 2300.0, 152.4, 1200.0, 0.3, 1200.0, 12.5, None, 100.0, None, 12.0, 1.23456, 1234.56, -5.0)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{c}', {'NULL' if m is None else m}::DOUBLE, {'NULL' if m is None else str(0 <= m <= 10000).lower()}::BOOLEAN)" for v, c, m in zip(VALUES, _CLASSES, _METRES, strict=True)) + ") t(value, unit, metres, plausible)")
def measurements(spark, sf_dir):
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, VALUES))).alias("value"))
    out = rows.withColumn("unit", M.unit_class(F.col("value"))).withColumn("metres", F.round(M.to_metres(F.col("value"), F.col("unit")), 6))
    return out.withColumn("plausible", M.plausible(F.col("metres")))


@query("""SELECT c_custkey, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km FROM (SELECT c_custkey, pow(sin((b - a) / 2), 2) + cos(a) * cos(b) * pow(sin(radians(lon) / 2), 2) AS h FROM
(SELECT c_custkey, radians(c_custkey % 90) AS a, radians(c_nationkey) AS b, c_custkey % 180 AS lon FROM customer))""")
def haversine_km(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    km = M.haversine((F.col("c_custkey") % 90).cast("double"), F.lit(0.0), F.col("c_nationkey").cast("double"), (F.col("c_custkey") % 180).cast("double"))
    return c.select("c_custkey", F.round(km, 4).alias("km"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, event_type FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")


@query("""SELECT doc_id, md5('22:' || doc_id::VARCHAR) AS key, (list_sum(list_transform(string_split(md5('22:' || doc_id::VARCHAR), ''), lambda d: instr('0123456789abcdef', d) - 1)) % 5)::INT AS fold,
round(('0x' || md5('22:' || doc_id::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE, 9) AS share FROM documents""")
def stable_folds(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", stable_key(22, d).alias("key"), stable_fold(22, d, 5).alias("fold"), F.round(stable_share(22, d), 9).alias("share"))


@query("""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('22:' || doc_id::VARCHAR), doc_id) <= 20""")
def stable_cap_per_group(spark, sf_dir):
    return ordering.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 20)


@query("""WITH t AS (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT lang, sum(n * (n - 1) / 2) AS same, sum(n) AS t FROM t GROUP BY lang)
SELECT sum(same)::DOUBLE AS same_pairs, sum(t * (t - 1) / 2)::DOUBLE AS pairs, round(sum(same) / sum(t * (t - 1) / 2), 9) AS purity FROM s""")
def pair_purity(spark, sf_dir):
    return agreement.pair_purity(table(spark, sf_dir, "documents").select("lang", F.md5(F.col("text").cast("binary")).alias("text")), "lang", "text").withColumn("purity", F.round("purity", 9))


@query("""SELECT sum(v)::BIGINT AS n, round(sum(v * (v - 1))::DOUBLE / (sum(v) * (sum(v) - 1)), 9) AS rate FROM (SELECT text, count(*) AS v FROM documents GROUP BY text)""")
def collision_rate(spark, sf_dir):
    return agreement.collision_rate(table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text")), "text").withColumn("rate", F.round("rate", 9))


@query("""SELECT d.doc_id, CASE WHEN count(DISTINCT quality) OVER (PARTITION BY text) > 1 THEN 'conflicting' WHEN row_number() OVER (PARTITION BY text ORDER BY d.doc_id) > 1 THEN 'duplicate' ELSE 'ok' END AS status
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def conflicting_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text"))
    return ordering.duplicate_flags(d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id"), ["text"], "doc_id", "quality").select("doc_id", "status")
