"""Queries of mapping, decoding and inventories, on parts, customers, orders and the area hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.operators import hierarchy as H
from metaloam.operators import mapping as M
from metaloam.operators import ordering as O  # noqa: E741
from metaloam.plans import trees
from metaloam.registry import query, table


@query("""WITH n AS (SELECT 'T' || p_partkey AS term, p_name AS name, 0 AS rank FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'T' || p_partkey, lower(p_type) || ' ' || p_size, 1 FROM part WHERE p_partkey % 3 = 0), i AS (SELECT name, arg_min(term, row(rank, term)) AS term FROM n GROUP BY name)
SELECT p_partkey, term FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE lower(p_type) || ' ' || p_size END AS name FROM part) LEFT JOIN i USING (name)""")
def exact_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    terms = p.filter("p_partkey % 3 = 0").select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("term"), F.col("p_name").alias("label"), F.array(F.concat("p_type", F.lit("-"), F.col("p_size").cast("string"))).alias("synonyms"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_type", F.lit(" "), F.col("p_size").cast("string"), F.lit(".")))
    return M.exact_terms(p.select("p_partkey", said.alias("said")), "said", M.exact_index(terms)).select("p_partkey", "term")


def _probabilities(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("sample"), F.concat(F.lit("s"), (F.floor(F.col("o_custkey") % 50 / 7) * 6 + F.col("o_orderkey") % 3).cast("string")).alias("label"), "o_totalprice")
    w = o.groupBy("sample", "label").agg(F.sum("o_totalprice").alias("w"))
    total = w.groupBy("sample").agg(F.sum("w").alias("all"))
    paths = H.closure(trees._edges(spark, sf_dir))
    labels = paths.filter("distance = 0 AND substring(node, 1, 1) IN ('s', 'n')").select(F.col("node").alias("label"))
    return w.join(total, "sample").select("sample", "label", F.round(F.col("w") / F.col("all"), 9).alias("p")).join(labels, "label", "left_semi"), paths


@query(
    trees._BACK_OFF
    + """, f AS (SELECT mass.sample, mass.node, q, coalesce(depth, 0) AS depth FROM mass LEFT JOIN depth USING (node) WHERE q >= 0.4 - 1e-12 AND node[1] IN ('n', 'r')), k AS (SELECT sample, node, q FROM f QUALIFY row_number() OVER (PARTITION BY sample ORDER BY depth DESC, round(q, 9) DESC, node) = 1)
SELECT sample, node AS pick, round(q, 6) AS q FROM (SELECT DISTINCT sample FROM pr) LEFT JOIN k USING (sample)"""
)
def decoded_candidates(spark, sf_dir):
    p, paths = _probabilities(spark, sf_dir)
    allowed = paths.filter("distance = 0 AND substring(node, 1, 1) IN ('n', 'r')").select("node")
    return M.decode_candidates(p, "sample", paths, allowed, 0.4).withColumn("q", F.round("q", 6))


@query(trees._BACK_OFF + " SELECT sample, CASE WHEN max(p) >= 0.2 THEN arg_min(label, row(-p, label)) END AS pick FROM pr GROUP BY sample")
def flat_decoding(spark, sf_dir):
    return M.flat_decode(_probabilities(spark, sf_dir)[0], "sample", 0.2)


@query("""SELECT o_orderkey, CASE WHEN a = b AND b = c THEN a WHEN a = b THEN a WHEN a = c THEN a WHEN b = c THEN b END AS label, CASE WHEN a = b AND b = c THEN 3 WHEN a = b OR a = c OR b = c THEN 2 END AS n
FROM (SELECT o_orderkey, o_orderstatus AS a, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END AS b, CASE o_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS c FROM orders)""")
def relabel_proposals(spark, sf_dir):
    k = F.col("o_custkey") % 3
    said = M.proposal(F.col("o_orderstatus"), F.when(F.col("o_totalprice") > 200000, "F").otherwise("O"), F.when(k == 0, "F").when(k == 1, "O").otherwise("P"))
    return table(spark, sf_dir, "orders").select("o_orderkey", said.alias("r")).select("o_orderkey", "r.label", "r.n")


@query(trees._CLOSURE + " SELECT ancestor, string_agg(DISTINCT node, ';' ORDER BY node) AS labels FROM c WHERE node[1] = 's' GROUP BY ancestor HAVING count(DISTINCT node) > 1")
def broader_classes(spark, sf_dir):
    paths = H.closure(trees._edges(spark, sf_dir))
    labels = paths.filter("distance = 0 AND substring(node, 1, 1) = 's'").select(F.col("node").alias("label"))
    return M.broader_lists(paths, labels).withColumn("labels", F.array_join("labels", ";"))


@query("""SELECT DISTINCT c_custkey, slot, value FROM (SELECT c_custkey, 'a' AS slot, 'ENV:' || c_nationkey AS value FROM customer UNION ALL SELECT c_custkey, 'a', 'ENV:' || (c_nationkey + 1) FROM customer UNION ALL SELECT c_custkey, 'b', 'FOO_' || (c_custkey % 3) FROM customer)""")
def unpivoted_labels(spark, sf_dir):
    n = F.col("c_nationkey")
    a = F.concat(F.lit("ENV:"), n.cast("string"), F.lit("; ENV:"), (n + 1).cast("string"), F.lit(";X:9"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), F.concat(F.lit("FOO_"), (F.col("c_custkey") % 3).cast("string")).alias("b"))
    return M.unpivoted(rows, "c_custkey", ("a", "b"), ("ENV", "FOO"))


@query("""SELECT 'seg' AS "column", count(*) FILTER (WHERE c_custkey % 5 = 0) AS missing, count(*) FILTER (WHERE c_custkey % 5 = 1) AS nulls, count(*) FILTER (WHERE c_custkey % 5 > 1) AS other FROM customer UNION ALL SELECT 'name', 0, 0, count(*) FROM customer""")
def missing_values(spark, sf_dir):
    k = F.col("c_custkey") % 5
    rows = table(spark, sf_dir, "customer").select(F.when(k == 0, " Not Collected").when(k > 1, F.col("c_mktsegment")).alias("seg"), F.col("c_name").alias("name"))
    return M.value_inventory(rows, ("seg", "name"))


@query("""WITH l AS (SELECT o_custkey, arg_max(o_orderkey % 90, o_orderkey) AS lat, arg_max(o_orderkey % 180, o_orderkey) AS lon, count(*) > 1 AS repeated FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY 1)
SELECT o_custkey, CASE WHEN o_custkey % 10 = 0 THEN lon ELSE lat END AS lat, CASE WHEN o_custkey % 10 = 0 THEN lat ELSE lon END AS lon, repeated FROM l""")
def swapped_coordinates(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 13 != 0, k % 90).alias("lat"), (k % 180).alias("lon"))
    return M.swapped_coordinates(rows, "o_custkey", rows.filter("o_custkey % 10 = 0"), "o_orderkey")


@query(r"""SELECT p_partkey, p_partkey || chr(9) || 'a\tb\\' || p_name || '\n' || chr(9) || '' AS line FROM part""")
def escaped_lines(spark, sf_dir):
    said = F.concat(F.lit("a\tb\\"), "p_name", F.lit("\n"))
    return table(spark, sf_dir, "part").select("p_partkey", M.escaped_line(F.col("p_partkey"), said, F.lit(None)).alias("line"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'seg' WHEN c_custkey % 6 = 1 THEN 'name' END AS lacks FROM customer")
def validated_rows(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 != 0, F.col("c_mktsegment")).alias("seg"), F.when(k % 6 == 1, F.lit("  ")).otherwise(F.col("c_name")).alias("name"))
    good, bad = M.validated(rows, ("seg", "name"))
    return good.select("c_custkey", F.lit(None).cast("string").alias("lacks")).unionByName(bad.select("c_custkey", "lacks"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def first_of_each_text(spark, sf_dir):
    return M.first_per_text(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@query("""SELECT 'ring' AS marker, count(*) FILTER (WHERE contains(p_name, 'ring')) AS "old", count(*) FILTER (WHERE contains(p_name, 'ring') AND p_partkey % 2 = 0) AS "new" FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'red', count(*) FILTER (WHERE contains(p_name, 'red')), count(*) FILTER (WHERE contains(p_name, 'red') AND p_partkey % 2 = 0) FROM part WHERE p_partkey % 3 <> 0""")
def marker_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    new = p.filter("p_partkey % 3 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise("").alias("p_name"))
    return M.marker_counts(p, new, "p_partkey", "p_name", {"ring": "ring", "red": "red"})


@query("SELECT conv_id, turn, text IS NULL OR trim(text, ' ') = '' AS empty, length(trim(coalesce(text, ''), ' '))::INT AS size FROM conversations")
def trimmed_lines(spark, sf_dir):
    said = F.trim(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (said == "").alias("empty"), F.char_length(said).alias("size"))


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""")
def latest_answers(spark, sf_dir):
    return O.first_per(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id", "event_type"], F.desc("event_id"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS complete FROM customer GROUP BY ALL")
def class_and_subclass_counts(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("complete"))
