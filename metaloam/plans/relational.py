"""Queries of joins, sets, windows, pivots and upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.functions.measure import left_closed_bin
from metaloam.operators import ordering as O  # noqa: E741
from metaloam.operators import tables as T
from metaloam.registry import query, table
from metaloam.streaming.incremental import windowed_counts


@query("""WITH e AS (SELECT o_custkey AS k, o_orderkey AS v, 0 AS load FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT c_custkey AS k, -1 AS v, 1 AS load FROM customer)
SELECT k, v FROM (SELECT * FROM e UNION ALL SELECT * FROM n) QUALIFY row_number() OVER (PARTITION BY k ORDER BY load, v) = 1""")
def upsert_keep_first(spark, sf_dir):
    old = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return T.upsert_keep_first(old, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v")), "k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def retry_difference(spark, sf_dir):
    return T.missing_keys(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""WITH p AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT k FROM p)) AS n_missing, (SELECT count(*) FROM p WHERE k NOT IN (SELECT c_custkey FROM customer)) AS n_extra, (SELECT count(*) FROM p WHERE n > 1) AS n_duplicate""")
def key_audit(spark, sf_dir):
    return T.key_audit(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""WITH a AS (SELECT l_suppkey AS k, list(DISTINCT l_returnflag) AS v FROM lineitem GROUP BY 1), b AS (SELECT s_suppkey AS k, ['x'] AS v FROM supplier)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(coalesce(a.v, []), coalesce(b.v, [])))), ',') AS v FROM a FULL JOIN b USING (k)""")
def merged_lists(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.collect_set("l_returnflag").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.array(F.lit("x")).alias("v"))
    return T.merge_lists(a, b, "k", "v").select("k", F.array_join(F.array_sort("v"), ",").alias("v"))


@query("""SELECT o_custkey, min(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS "F", min(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS "O", min(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def wide_from_long(spark, sf_dir):
    return T.wide_from_long(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", ["F", "O", "P"])


@query("""SELECT conv_id, round(avg(m), 6) AS transition_share, count(*) AS n FROM (SELECT conv_id, CASE WHEN lag(role) OVER w IS NOT NULL AND role <> lag(role) OVER w THEN 1.0::DOUBLE ELSE 0 END AS m FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY 1""")
def transition_share(spark, sf_dir):
    return O.transition_share(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").withColumn("transition_share", F.round("transition_share", 6))


@query("""SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS run,
CASE WHEN i <= ceil(n / 3.0) THEN 'beginning' WHEN i <= ceil(2 * n / 3.0) THEN 'middle' ELSE 'end' END AS position
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def running_batches(spark, sf_dir):
    c = O.running_number(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return O.thirds(c, ["conv_id"], "turn").select("conv_id", "turn", "run", "position")


@query("""SELECT bin, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 50000 THEN '[0,50000)' WHEN o_totalprice < 100000 THEN '[50000,100000)' WHEN o_totalprice < 200000 THEN '[100000,200000)' END AS bin FROM orders) GROUP BY 1""")
def price_bins(spark, sf_dir):
    named = left_closed_bin(F.col("o_totalprice"), [0, 50000, 100000, 200000])
    return table(spark, sf_dir, "orders").groupBy(named.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def study_summary(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s"))
    joined = per.join(c.select("c_custkey", "c_nationkey"), "c_custkey").join(n, F.col("c_nationkey") == n["n_nationkey"])
    return joined.groupBy("n_name").agg(F.sum("n").alias("n_orders"), F.round(F.sum("s"), 2).alias("total"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def hourly_events(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""SELECT l_orderkey, min({'n': l_linenumber, 'p': l_partkey}).p AS first_part, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def first_known(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey"))["l_partkey"].alias("first_part"), F.countDistinct("l_suppkey").alias("suppliers"))
