"""Queries of samples, on customers, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.operators import sampling as S
from metaloam.registry import query, table


def _key(column: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {column}::VARCHAR)"


@query(f"SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_key('c_custkey')}, c_custkey) <= 12")
def sample_per_class(spark, sf_dir):
    return S.n_per_class(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 12, exact=True)


@query(f"SELECT o_orderkey FROM orders ORDER BY {_key('o_orderkey')}, o_orderkey LIMIT 100")
def sample_overall(spark, sf_dir):
    return S.n_overall(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100)


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {_key('c_custkey')}, c_custkey) - 1 AS place FROM customer WHERE c_nationkey < 12")
def shuffled_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return S.shuffled_list(c, "c_custkey", c.filter("c_nationkey < 12"))


@query(f"""SELECT o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY {_key('o_orderkey')}, o_orderkey) <= 9)
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_key('o_orderkey')}, o_orderkey) <= 20""")
def nested_sample(spark, sf_dir):
    return S.nested_caps(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", "o_orderkey", 9, 20).select("o_orderkey")


@query(f"""SELECT o_orderkey FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY {_key('o_orderkey')}, o_orderkey) <= 2) ORDER BY {_key('o_orderkey', 43)}, o_orderkey LIMIT 80""")
def capped_sample(spark, sf_dir):
    return S.capped_then_n(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 2, 80).select("o_orderkey")


@query(f"""WITH k AS (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 5 ORDER BY count(*) DESC, 1 LIMIT 6)
SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN (SELECT * FROM k) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY {_key('c_custkey')}, c_custkey) <= 4""")
def sample_of_large_classes(spark, sf_dir):
    return S.large_classes(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 5, 6, 4)


@query(f"""SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_key('c_custkey')}, c_custkey) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment))""")
def sample_of_equal_classes(spark, sf_dir):
    return S.equal_classes(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey")


_SHARES = "n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), f AS (SELECT c_mktsegment, floor(40 * n / (SELECT sum(n) FROM n))::BIGINT AS own FROM n), s AS (SELECT c_mktsegment, own + CASE WHEN c_mktsegment = (SELECT min(c_mktsegment) FROM n) THEN 40 - (SELECT sum(own) FROM f) ELSE 0 END AS take FROM f)"


@query(f"WITH {_SHARES} SELECT c_custkey FROM customer JOIN s USING (c_mktsegment) QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_key('c_custkey')}, c_custkey) <= take")
def proportional_sample(spark, sf_dir):
    return S.proportional(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 40).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice > 200000 AS large FROM orders")
def rows_by_predicate(spark, sf_dir):
    a, b = S.split_rows(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 200000)
    return a.select("o_orderkey", F.lit(True).alias("large")).unionByName(b.select("o_orderkey", F.lit(False).alias("large")))


@query("""SELECT conv_id, array_to_string(string_split(a, ' ')[1:n], ' ') AS a, array_to_string(string_split(b, ' ')[1:n], ' ') AS b FROM (SELECT conv_id, a, b, least(len(string_split(a, ' ')), len(string_split(b, ' '))) AS n FROM
(SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b FROM conversations GROUP BY conv_id HAVING count(text) FILTER (WHERE turn = 0) > 0 AND count(text) FILTER (WHERE turn = 1) > 0))""")
def texts_of_equal_length(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*(F.max(F.when(F.col("turn") == i, F.col("text"))).alias(n) for i, n in enumerate("ab")))
    return S.cut_to_shortest(c.filter("a IS NOT NULL AND b IS NOT NULL"), "a", "b")


@query("""SELECT p_partkey, CASE WHEN a[-1] = b[-1] THEN 'same_head' WHEN a[1] = b[1] THEN 'same_first' WHEN len(list_intersect(a, b)) > 0 THEN 'shared' ELSE 'none' END AS relation FROM (SELECT x.p_partkey, string_split(lower(x.p_name), ' ') AS a, string_split(lower(y.p_name), ' ') AS b FROM part x JOIN part y ON y.p_partkey = x.p_partkey + 1)""")
def name_relations(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    nxt = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(nxt, "p_partkey").select("p_partkey", S.pair_relation(F.col("p_name"), F.col("other")).alias("relation"))


@query("""SELECT s_suppkey, array_to_string(list(i ORDER BY md5('7:' || s_suppkey || ':' || i), i), '') AS "order" FROM (SELECT s_suppkey, unnest(range(1, 6)) AS i FROM supplier) GROUP BY s_suppkey""")
def option_orders(spark, sf_dir):
    return S.option_order(table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", 5, 7).withColumn("order", F.array_join("order", ""))


@query("SELECT o_orderkey, o_totalprice > 50000 AS a, o_totalprice > 50000 AND o_orderstatus = 'F' AS b, o_totalprice > 50000 AND o_orderstatus = 'F' AND o_custkey % 2 = 0 AS c FROM orders")
def training_arms(spark, sf_dir):
    arms = [("a", F.col("o_totalprice") > 50000), ("b", F.col("o_orderstatus") == "F"), ("c", F.col("o_custkey") % 2 == 0)]
    return S.cumulative_arms(table(spark, sf_dir, "orders"), arms).select("o_orderkey", "a", "b", "c")


@query(r"""SELECT p_partkey, CASE WHEN regexp_matches(p_name, '\bring\b') THEN 'ring' ELSE 'red' END AS class FROM part WHERE regexp_matches(p_name, '\bring\b') <> regexp_matches(p_name, '\bred\b')""")
def two_keyword_classes(spark, sf_dir):
    return S.keyword_classes(table(spark, sf_dir, "part"), "p_name", ("ring", r"\bring\b"), ("red", r"\bred\b")).select("p_partkey", "class")
