"""Queries of agreement, statistics and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.operators import agreement as A
from metaloam.operators import calibration
from metaloam.registry import query, table

_PAIRS = "p AS (SELECT o_orderstatus AS gold, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS predicted FROM orders), n AS (SELECT gold, predicted, count(*) AS n FROM p GROUP BY ALL)"
_SCORES = """, g AS (SELECT gold AS label, sum(n) AS n_gold, coalesce(sum(n) FILTER (WHERE gold = predicted), 0) AS tp FROM n GROUP BY gold), q AS (SELECT predicted AS label, sum(n) AS n_predicted FROM n GROUP BY predicted),
b AS (SELECT label, coalesce(n_gold, 0)::BIGINT AS n_gold, coalesce(tp, 0)::BIGINT AS tp, coalesce(n_predicted, 0)::BIGINT AS n_predicted FROM g FULL JOIN q USING (label))"""


def _matrix(spark, sf_dir):
    predicted = F.when(F.col("o_totalprice") > 200000, "F").when(F.col("o_totalprice") > 100000, "O").otherwise("P")
    return A.confusion(table(spark, sf_dir, "orders").select(F.col("o_orderstatus"), predicted.alias("predicted")), "o_orderstatus", "predicted")


@query(f"WITH {_PAIRS} SELECT gold, predicted, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY gold), 6) AS share FROM n")
def confusion_matrix(spark, sf_dir):
    return _matrix(spark, sf_dir).withColumn("share", F.round("share", 6))


@query(f"""WITH {_PAIRS}{_SCORES}, s AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp::DOUBLE / n_predicted ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN tp::DOUBLE / n_gold ELSE 0 END AS r FROM b)
SELECT label, n_gold, tp, n_predicted, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""")
def class_scores(spark, sf_dir):
    return A.class_scores(_matrix(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(f"""WITH {_PAIRS}{_SCORES}, t AS (SELECT sum(n_gold)::DOUBLE AS n, sum(tp) AS h, sum(n_gold * n_predicted)::DOUBLE AS c FROM b)
SELECT n::BIGINT AS n, round(h / n, 6) AS observed, round(c / (n * n), 6) AS expected, round((h / n - c / (n * n)) / (1 - c / (n * n)), 6) AS kappa FROM t""")
def cohen_kappa(spark, sf_dir):
    return A.kappa(_matrix(spark, sf_dir)).select(F.col("n").cast("long").alias("n"), *(F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")))


@query(f"""WITH {_PAIRS}, g AS (SELECT gold, sum(n) AS rn FROM n GROUP BY gold), q AS (SELECT predicted, sum(n) AS cn FROM n GROUP BY predicted),
f AS (SELECT g.gold, q.predicted, coalesce(n.n, 0) AS n, rn * cn / (SELECT sum(n) FROM n)::DOUBLE AS e FROM g CROSS JOIN q LEFT JOIN n ON n.gold = g.gold AND n.predicted = q.predicted)
SELECT gold, predicted, n::BIGINT AS n, round(e, 5) AS expected, round((n - e) / sqrt(e), 5) AS residual FROM f""")
def contingency_residuals(spark, sf_dir):
    return A.residuals(_matrix(spark, sf_dir).drop("share")).withColumns({c: F.round(c, 5) for c in ("expected", "residual")})


@query("""SELECT l_returnflag, count(*) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS sd, round(quantile_cont(x, 0.5), 5) AS median, round(stddev_samp(x) / sqrt(count(*)), 5) AS sem,
round(avg(x) - 1.959964 * stddev_samp(x) / sqrt(count(*)), 5) AS ci_low, round(avg(x) + 1.959964 * stddev_samp(x) / sqrt(count(*)), 5) AS ci_high, round(stddev_samp(x) / avg(x), 5) AS cv,
round(skewness(x), 4) AS skewness, round(kurtosis(x), 4) AS kurtosis FROM (SELECT l_returnflag, l_quantity::DOUBLE AS x FROM lineitem) GROUP BY l_returnflag""")
def descriptive_moments(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"))
    out = A.moments(rows, ["l_returnflag"], "x")
    return out.withColumns({c: F.round(c, 5) for c in ("mean", "sd", "median", "sem", "ci_low", "ci_high", "cv")} | {c: F.round(c, 4) for c in ("skewness", "kurtosis")})


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_extendedprice * CASE WHEN l_partkey % 50 = 0 THEN 9 ELSE 1 END AS x FROM lineitem), q AS (SELECT l_returnflag, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey FROM v JOIN q USING (l_returnflag) WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers(spark, sf_dir):
    x = F.col("l_extendedprice") * F.when(F.col("l_partkey") % 50 == 0, 9).otherwise(1)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", x.alias("x"))
    return A.iqr_outliers(rows, ["l_returnflag"], "x").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL),
t AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY o_custkey) AS share, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS i FROM n),
k AS (SELECT *, count(*) OVER (PARTITION BY o_orderpriority) AS keys FROM t WHERE i = 1 AND share >= 0.3)
SELECT o_custkey, o_orderpriority, round(share, 6) AS share FROM k WHERE keys >= 5""")
def majority_label_per_key(spark, sf_dir):
    return A.majority_label(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", 0.3, 5).withColumn("share", F.round("share", 6))


@query("""WITH r AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM r WHERE k >= 0.8 * (SELECT count(DISTINCT o_orderpriority) FROM orders))""")
def balanced_panel(spark, sf_dir):
    return A.balanced_panel(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", 0.8).select("o_orderkey", "o_custkey")


@query("""WITH t AS (SELECT unnest(range(1, l_quantity::BIGINT + 1)) AS i, l_extendedprice::DOUBLE AS x FROM lineitem)
SELECT count(*)::BIGINT AS n, round(avg(x), 2) AS mean, round(stddev_pop(x), 1) AS sd, round(quantile_cont(x, 0.25), 3) AS p25, round(quantile_cont(x, 0.5), 3) AS p50, round(quantile_cont(x, 0.75), 3) AS p75 FROM t""")
def weighted_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("w"), F.col("l_extendedprice").cast("double").alias("x"))
    return A.weighted_summary(rows, "x", "w").withColumns({"mean": F.round("mean", 2), "sd": F.round("sd", 1)} | {c: F.round(c, 3) for c in ("p25", "p50", "p75")})


@query("""WITH n AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL) SELECT quality, toxic, n FROM n""")
def label_crosstab(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT o_orderkey, o_orderpriority, pow((o_custkey * 7919 % 1009) / 1009.0::DOUBLE, 4) AS p FROM orders), i AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY p) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS m FROM p),
l AS (SELECT o_orderpriority, max(i) AS last FROM i WHERE p <= i / m::DOUBLE * 0.05 GROUP BY 1), d AS (SELECT o_orderpriority, max(p) AS cut FROM i JOIN l USING (o_orderpriority) WHERE i <= last GROUP BY 1) SELECT o_orderkey, p <= coalesce(cut, -1) AS rejected FROM p LEFT JOIN d USING (o_orderpriority)""")
def bh_fdr(spark, sf_dir):
    p = F.pow((F.col("o_custkey") * 7919 % 1009) / 1009.0, 4)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", p.alias("p"))
    return A.benjamini_hochberg(rows, "p", by=["o_orderpriority"]).select("o_orderkey", "rejected")


@query("""WITH r AS (SELECT round(o_totalprice / 500000, 2) AS c, o_totalprice > 150000 AND o_custkey % 5 <> 0 AS ok FROM orders), n AS (SELECT c, count(*) AS n, count(*) FILTER (WHERE ok) AS h FROM r GROUP BY c),
k AS (SELECT c, sum(n) OVER w AS n, sum(h) OVER w AS h FROM n WINDOW w AS (ORDER BY c DESC)) SELECT min(c) AS threshold, round(max(n) / (SELECT count(*) FROM r)::DOUBLE, 9) AS coverage FROM k WHERE h / n::DOUBLE >= 0.75""")
def precision_threshold(spark, sf_dir):
    x = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.round(x / 500000, 2).alias("c"), ((x > 150000) & (F.col("o_custkey") % 5 != 0)).alias("ok"))
    return calibration.precision_threshold(rows, "c", "ok", 0.75).withColumn("coverage", F.round("coverage", 9))


@query("""SELECT round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f_mean, count(*) AS n, round(corr(o_totalprice, o_custkey), 6) AS pearson FROM orders""")
def correlation(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.round(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 2).alias("f_mean"), F.count(F.lit(1)).alias("n"), F.round(F.corr("o_totalprice", "o_custkey"), 6).alias("pearson"))
