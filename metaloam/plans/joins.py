"""Queries of joins and set operations, on customers, orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.operators import joins as J
from metaloam.registry import query, table


def _o(spark, sf_dir, *c):
    return table(spark, sf_dir, "orders").select(*c)


@query("""SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def keys_of_all_runs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return J.common_keys([o.filter(F.col("o_orderstatus") == s) for s in "FOP"], "o_custkey")


@query("""WITH k AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_custkey IN (SELECT * FROM k)""")
def rows_of_common_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = J.common_rows([o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'")], "o_custkey")
    return a.unionByName(b).select("o_orderkey", "o_custkey")


@query("""WITH x AS (SELECT c_custkey, (c_nationkey % 7)::DOUBLE AS latitude, CASE WHEN c_custkey % 11 <> 0 THEN (c_nationkey % 3)::DOUBLE END AS longitude FROM customer),
p AS (SELECT DISTINCT (n_nationkey % 7)::DOUBLE AS latitude, (n_nationkey % 3)::DOUBLE AS longitude, 'p' || (n_nationkey % 7) || '-' || (n_nationkey % 3) AS place FROM nation WHERE n_nationkey % 5 <> 0)
SELECT c_custkey, place, c_mktsegment FROM x JOIN p USING (latitude, longitude) JOIN customer USING (c_custkey) WHERE c_custkey % 2 = 0""")
def sample_places(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    where = c.select("c_custkey", (F.col("c_nationkey") % 7).cast("double").alias("latitude"), F.when(F.col("c_custkey") % 11 != 0, (F.col("c_nationkey") % 3).cast("double")).alias("longitude"))
    lat, lon = F.col("n_nationkey") % 7, F.col("n_nationkey") % 3
    places = n.filter("n_nationkey % 5 <> 0").select(lat.cast("double").alias("latitude"), lon.cast("double").alias("longitude"), F.concat(F.lit("p"), lat, F.lit("-"), lon).alias("place")).distinct()
    return J.place_join(c.filter("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment"), where, places, "c_custkey").select("c_custkey", "place", "c_mktsegment")


@query("""SELECT s_nationkey AS n_key, count(*) AS n, any_value(CASE WHEN s_nationkey < 12 THEN 'NATION_' || s_nationkey END) AS name_cached FROM supplier GROUP BY s_nationkey""")
def mismatches_with_cache(spark, sf_dir):
    cache = table(spark, sf_dir, "nation").filter("n_nationkey < 12").select(F.col("n_nationkey").alias("n_key"), F.col("n_name").alias("name"))
    return J.mismatch_cache(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_key")), cache, "n_key")


@query("""SELECT o_orderkey, l_quantity FROM orders JOIN (SELECT l_orderkey, arg_min(l_quantity, row(l_linenumber, l_partkey, l_suppkey)) AS l_quantity FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def first_measure(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return J.first_joined(_o(spark, sf_dir, "o_orderkey"), lines, "o_orderkey", "at").select("o_orderkey", "l_quantity")


@query("""WITH r AS (SELECT o_custkey, o_orderstatus, max((o_totalprice > 200000)::INT) AS v FROM orders GROUP BY ALL), b AS (SELECT a.v AS x, b.v AS y FROM r a JOIN r b USING (o_custkey) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O')
SELECT count(*) FILTER (WHERE x = 1 AND y = 1) AS both, count(*) FILTER (WHERE x = 1 AND y = 0) AS first_only, count(*) FILTER (WHERE x = 0 AND y = 1) AS second_only, count(*) FILTER (WHERE x = 0 AND y = 0) AS neither FROM b""")
def paired_runs(spark, sf_dir):
    r = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max((F.col("o_totalprice") > 200000).cast("int")).alias("v"))
    return J.paired_counts(r.filter("o_orderstatus = 'F'"), r.filter("o_orderstatus = 'O'"), "o_custkey", "v")


@query("""SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'NA' ELSE 'vec ' || label END AS said, round(embedding[1]::DOUBLE, 6) AS head FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE vec_id % 2 = 0) ON doc_id = vec_id""")
def aligned_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("doc_id"), F.concat(F.lit("vec "), "label").alias("said"), "embedding")
    out = J.aligned(table(spark, sf_dir, "documents").select("doc_id"), e, "doc_id", "said", "embedding", 64)
    x = F.round(F.col("embedding")[0], 6)
    return out.select("doc_id", "said", F.when(~F.isnan(x), x).alias("head"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'NATION_' || c_nationkey ELSE '' END AS n_name FROM customer""")
def name_or_blank(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.with_default(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), n, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("""SELECT k, c_acctbal, n FROM (SELECT c_custkey AS k, c_acctbal FROM customer WHERE c_custkey % 3 <> 0) FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) USING (k)""")
def outer_samples(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").filter("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return J.outer_lists(table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), "c_acctbal"), ids, "k")


@query("""SELECT c_custkey AS k, c_mktsegment, n, s_name FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN supplier ON c_custkey = s_suppkey""")
def chain_of_joins(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return J.chained(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment"), [n, s], "k")


@query("SELECT s_suppkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey")
def join_on_other_name(spark, sf_dir):
    return J.renamed_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").filter("n_regionkey < 3"), "s_nationkey", "n_nationkey").select("s_suppkey", "n_name")


_RUNS = "b AS (SELECT p_partkey, p_type AS old, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS new FROM part WHERE p_partkey % 5 <> 0)"


def _runs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    new = p.filter("p_partkey % 5 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("text"))
    return J.split_by_change(p.select("p_partkey", F.col("p_type").alias("text")), new, "p_partkey", "text")


@query(f"WITH {_RUNS} SELECT p_partkey, old = new AS same FROM b")
def changed_texts(spark, sf_dir):
    return _runs(spark, sf_dir).select("p_partkey", "same")


@query(f"WITH {_RUNS} SELECT old, new, min(p_partkey) AS p_partkey, count(*) AS n FROM b WHERE old <> new GROUP BY ALL")
def changed_pairs(spark, sf_dir):
    return J.distinct_pairs(_runs(spark, sf_dir).filter("NOT same"), "p_partkey")


@query("""WITH l AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey) AS ids FROM lineitem GROUP BY 1), e AS (SELECT k, unnest(ids) AS p FROM l), f AS (SELECT k, p, p_retailprice AS y FROM e LEFT JOIN part ON p = p_partkey AND p_size > 25)
SELECT k, arg_min(p, row(y, p)) FILTER (WHERE y IS NOT NULL) AS p, min(y) AS y FROM f GROUP BY k""")
def listed_articles(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("ids"))
    articles = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("p"), F.col("p_retailprice").alias("y"))
    return J.exploded_pick(lists, articles, "k", "ids", "p", "y")


@query("""SELECT p_brand, p_partkey FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50) UNION ALL SELECT p_brand, p_partkey FROM part WHERE p_size = 50""")
def rebuilt_groups(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return J.rebuilt(p, p.filter("p_size = 50"), "p_brand").drop("p_size")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) OR c_custkey IN (SELECT s_suppkey FROM supplier)""")
def in_any_list(spark, sf_dir):
    a = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return J.semi_of_any(table(spark, sf_dir, "customer").select("c_custkey"), [a, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"))], "c_custkey")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS group_size FROM orders")
def group_sizes(spark, sf_dir):
    return J.with_group_size(_o(spark, sf_dir, "o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "group_size")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 1 THEN 'answer ' || o_custkey ELSE o_orderstatus END AS answer, CASE WHEN o_custkey % 4 = 1 THEN 'rerank' ELSE 'backoff' END AS source FROM orders""")
def answers_to_rows(spark, sf_dir):
    o = _o(spark, sf_dir, "o_orderkey", "o_custkey", "o_orderstatus")
    answers = o.filter("o_custkey % 4 = 1").select(F.col("o_custkey").alias("request"), F.concat(F.lit("answer "), "o_custkey").alias("answer")).distinct()
    return J.scattered(o, o.select(F.col("o_custkey").alias("request"), "o_orderkey"), answers, "o_orderkey", "request", "answer", F.col("o_orderstatus")).select("o_orderkey", "answer", "source")


@query("SELECT c_custkey, c_nationkey::BIGINT AS first_row, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 2 ELSE -1 END AS second_row FROM customer WHERE c_custkey % 2 = 0")
def index_of_two_tables(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    first = c.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_nationkey").cast("long").alias("row"))
    second = c.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") * 2).alias("row"))
    return J.two_index(c.select("c_custkey"), first, second, "c_custkey", "first_row", "second_row")


@query("""SELECT c_custkey, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'made' WHEN 'MACHINERY' THEN 'made' END AS coarse FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def unlinked_samples(spark, sf_dir):
    classes = spark.createDataFrame([("BUILDING", "made"), ("MACHINERY", "made")], "c_mktsegment string, coarse string")
    linked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return J.unlinked(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), linked, classes, "c_custkey", "c_mktsegment").select("c_custkey", "c_mktsegment", "coarse")


@query("SELECT DISTINCT l_partkey AS value FROM lineitem")
def values_of_lists(spark, sf_dir):
    return J.distinct_list_values(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("v")), "v")


@query("SELECT c_nationkey, c_mktsegment FROM customer EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 8000")
def pairs_not_in(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return J.pair_difference(c, c.filter("c_acctbal > 8000"), "c_nationkey", "c_mktsegment")


_PARTS = "f AS (SELECT o_custkey AS k, o_orderstatus AS s, max(o_totalprice) AS x FROM orders GROUP BY ALL)"


def _parts(spark, sf_dir):
    f = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).agg(F.max("o_totalprice").alias("x"))
    return J.first_file_wins([f.filter(F.col("s") == s) for s in "FOP"], "k")


@query(f"WITH {_PARTS} SELECT k, arg_min(s, s) AS s, arg_min(x, s) AS x FROM f GROUP BY k")
def merged_files(spark, sf_dir):
    return _parts(spark, sf_dir)[0]


@query(f"WITH {_PARTS} SELECT k FROM f GROUP BY k HAVING count(*) > 1")
def repeated_file_keys(spark, sf_dir):
    return _parts(spark, sf_dir)[1]


@query("""SELECT c_custkey AS k, c_acctbal, s_acctbal, p_size FROM customer JOIN supplier ON c_custkey = s_suppkey JOIN part ON c_custkey = p_partkey""")
def joined_tables(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    return J.all_of(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal"), [s, p], "k")
