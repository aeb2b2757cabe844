"""Queries of label transfer and of checks on vectors, on embeddings, orders, customers and the area hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.functions import vectors as X
from metaloam.operators import hierarchy as H
from metaloam.operators import transfer as T
from metaloam.plans import neighbours as P
from metaloam.plans import trees
from metaloam.registry import query, table

_VOTES = P._BLOCKED + ", s AS (SELECT query_id, ql, il AS label, sum(sim) AS score FROM found GROUP BY ALL), t AS (SELECT query_id, any_value(ql) AS gold, list(label ORDER BY round(score, 6) DESC, label)[1:5] AS top, round(max(round(score, 6)) / sum(round(score, 6)), 3) AS confidence FROM s GROUP BY query_id)"


def _votes(spark, sf_dir):
    v, found = P._found(spark, sf_dir, True)
    items = v.select(F.col("id").alias("item_id"), "label")
    return v, found.join(items, "item_id").groupBy("query_id", "label").agg(F.round(F.sum("sim"), 6).alias("score"))


@query(_VOTES + " SELECT query_id, array_to_string(top, ';') AS top, confidence FROM t")
def ranked_labels(spark, sf_dir):
    out = T.ranked(_votes(spark, sf_dir)[1], "query_id")
    return out.select("query_id", F.array_join(F.transform("top", lambda x: x.cast("string")), ";").alias("top"), F.round("confidence", 3).alias("confidence"))


@query(
    _VOTES
    + """, e AS (SELECT DISTINCT label AS child, label // 2 AS parent FROM embeddings WHERE label > 0), m AS (SELECT query_id, gold, confidence, gold % 4 <> 0 AS seen, top[1] AS p, list_contains(top, gold) AS top5, top[1] = gold AS hit,
top[1] = gold OR (gold > 0 AND top[1] = gold // 2) OR (top[1] > 0 AND gold = top[1] // 2) AS near, top[1] = gold OR (gold > 0 AND top[1] IN (gold // 2, gold // 4, gold // 8, gold // 16)) AS above FROM t), h AS (SELECT hit FROM m ORDER BY confidence DESC, query_id LIMIT (SELECT count(*) // 2 FROM m)),
n AS (SELECT confidence AS c, count(*) AS n, count(*) FILTER (WHERE hit) AS h FROM m GROUP BY 1), k AS (SELECT c, sum(n) OVER w AS n, sum(h) OVER w AS h FROM n WINDOW w AS (ORDER BY c DESC)), x AS (SELECT min(c) AS threshold, max(n) AS n FROM k WHERE h / n::DOUBLE >= 0.6)
SELECT count(*) AS n, round(avg(hit::INT), 6) AS top1, round(avg(top5::INT), 6) AS top5, round(avg(near::INT), 6) AS top1_or_parent_child, round(avg(above::INT), 6) AS top1_gold_or_ancestor, count(*) FILTER (WHERE NOT seen) AS n_unseen_label, round(avg(hit::INT) FILTER (WHERE NOT seen), 6) AS top1_unseen_label,
(SELECT round(avg(a), 6) FROM (SELECT avg(hit::INT) AS a FROM m GROUP BY gold)) AS macro_top1, (SELECT round(avg(hit::INT), 6) FROM h) AS top1_confident_half, (SELECT threshold FROM x) AS threshold_at_precision, (SELECT round(n / (SELECT count(*) FROM m)::DOUBLE, 6) FROM x) AS coverage_at_precision FROM m"""
)
def transfer_metrics(spark, sf_dir):
    v, votes = _votes(spark, sf_dir)
    gold = v.select(F.col("id").alias("query_id"), F.col("label").alias("gold"))
    preds = T.ranked(votes, "query_id").join(gold, "query_id").withColumns({"confidence": F.round("confidence", 3), "seen": F.col("gold") % 4 != 0})
    labels = v.select("label").distinct()
    parents = labels.filter("label > 0").select(F.col("label").alias("child"), F.floor(F.col("label") / 2).cast("long").alias("parent"))
    out = T.transfer_metrics(preds, "query_id", parents, H.closure(parents), 0.6)
    shares = ("top1", "top5", "top1_or_parent_child", "top1_gold_or_ancestor", "top1_unseen_label", "macro_top1", "top1_confident_half", "coverage_at_precision")
    return out.withColumns({c: F.round(c, 6) for c in shares})


@query(_VOTES + """, l AS (SELECT * FROM s WHERE label % 3 <> 0), a AS (SELECT s.query_id, s.label, round(coalesce(round(l.score, 6) / 10, -1) + 0.5 * round(s.score, 6), 4) AS score FROM s LEFT JOIN l ON l.query_id = s.query_id AND l.label = s.label) SELECT query_id, label::BIGINT AS label, score FROM a""")
def hybrid_scores(spark, sf_dir):
    votes = _votes(spark, sf_dir)[1]
    linear = votes.filter("label % 3 <> 0").withColumn("score", F.col("score") / 10)
    return T.hybrid(linear, votes, "query_id", 0.5).withColumn("score", F.round("score", 4))


@query("""WITH w AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT o_custkey, label, n / sum(n) OVER (PARTITION BY o_custkey)::DOUBLE AS p FROM w)
SELECT o_custkey, string_agg(label || ':' || printf('%.4f', p), ';' ORDER BY p DESC, label) AS candidates FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, label) <= 3) GROUP BY 1""")
def candidate_lists(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("o_custkey").agg(F.sum("n").alias("all"))
    return T.candidate_strings(n.join(total, "o_custkey").withColumn("p", F.col("n") / F.col("all")), "o_custkey", 3)


@query(
    trees._BACK_OFF
    + """, g AS (SELECT tau, sample, pick, 's' || (sample % 8 * 6) AS gold FROM picks), o AS (SELECT tau, g.sample % 4 AS fold, CASE WHEN pick IS NULL THEN 'abstain' WHEN pick = gold THEN 'exact' WHEN u.node IS NOT NULL THEN 'coarser' ELSE 'other' END AS outcome FROM g LEFT JOIN c u ON u.node = gold AND u.ancestor = pick AND u.distance > 0),
f AS (SELECT fold, tau, count(*) AS n, count(*) FILTER (WHERE outcome <> 'abstain') AS answered, count(*) FILTER (WHERE outcome IN ('exact', 'coarser')) AS good FROM o GROUP BY ALL), t AS (SELECT tau, sum(answered) AS a, sum(good) AS r FROM f GROUP BY tau),
k AS (SELECT fold, coalesce(min(tau) FILTER (WHERE a > answered AND r - good >= 0.15 * (a - answered)), max(tau)) AS tau FROM f JOIN t USING (tau) GROUP BY fold) SELECT fold, tau, n, answered, good AS "right" FROM f JOIN k USING (fold, tau)"""
)
def cross_fitted_back_off(spark, sf_dir):
    picks, paths = trees._picks(spark, sf_dir)
    keyed = picks.select(F.struct("tau", "sample").alias("sample"), "pick")
    gold = keyed.select("sample", F.concat(F.lit("s"), (F.col("sample.sample") % 8 * 6).cast("string")).alias("gold"))
    found = H.outcomes(keyed, gold, paths).select("sample.tau", (F.col("sample.sample") % 4).alias("fold"), "outcome")
    return T.cross_fitted(found, "fold", 0.15, lenient=True)


@query("SELECT 'label ' || label AS name, count(*) AS n, round(max(hi - lo)::DOUBLE, 5) AS spread FROM (SELECT label, pos, min(x) AS lo, max(x) AS hi, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY ALL) JOIN (SELECT label, count(*) AS k FROM embeddings GROUP BY 1) USING (label) GROUP BY label, k HAVING max(hi - lo) > 0.5".replace("count(*) AS n, round", "max(n) AS n, round"))
def same_text_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("name"), "embedding")
    return T.text_vectors(e, "name", "embedding", 0.5).withColumn("spread", F.round("spread", 5))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS ids, 0::BIGINT AS no_id FROM events")
def id_counts(spark, sf_dir):
    return T.id_counts(table(spark, sf_dir, "events"), "user_id")


@query("SELECT count(*) AS requests, sum(length(coalesce(text, '')) // 4)::BIGINT AS tokens_in, count(*) * 50 AS tokens_out, round((sum(length(coalesce(text, '')) // 4) * 0.15::DOUBLE + count(*) * 50 * 0.6) / 1e6, 6) AS cost FROM documents")
def request_cost(spark, sf_dir):
    return T.cost_estimate(table(spark, sf_dir, "documents"), "text", 0.15, 0.6, 50)


@query("""WITH a AS (SELECT c_custkey AS k, c_mktsegment AS l, c_acctbal AS s FROM customer), b AS (SELECT k, CASE WHEN k % 10 = 0 THEN 'other' ELSE l END AS l, s + (k % 4) / 4.0 AS s FROM a) SELECT count(*) AS n, round(avg((a.l = b.l)::INT), 6) AS same, round(max(abs(a.s - b.s))::DOUBLE, 6) AS most FROM a JOIN b USING (k)""")
def ranking_difference(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label"), F.col("c_acctbal").alias("score"))
    b = a.select("k", F.when(F.col("k") % 10 == 0, "other").otherwise(F.col("label")).alias("label"), (F.col("score") + (F.col("k") % 4) / 4).alias("score"))
    return T.ranking_difference(a, b, "k").withColumns({"same": F.round("same", 6), "most": F.round("most", 6)})


_HALVES = "h AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b, label FROM embeddings), p AS (SELECT x.vec_id, round(list_cosine_similarity(x.a, y.a), 6) AS sa, round(list_cosine_similarity(x.b, y.b), 6) AS sb FROM h x JOIN h y ON y.vec_id = x.vec_id + 1)"


def _halves(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    y = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("ya"), F.col("b").alias("yb"))
    return h.join(y, "vec_id").select("vec_id", F.round(X.cosine(F.col("a"), F.col("ya")), 6).alias("sa"), F.round(X.cosine(F.col("b"), F.col("yb")), 6).alias("sb"))


@query(f"WITH {_HALVES}, r AS (SELECT sa, sb, rank() OVER (ORDER BY sa) + (count(*) OVER (PARTITION BY sa) - 1) / 2.0 AS ra, rank() OVER (ORDER BY sb) + (count(*) OVER (PARTITION BY sb) - 1) / 2.0 AS rb FROM p) SELECT count(*) AS n, round(corr(sa, sb), 4) AS pearson, round(corr(ra, rb), 4) AS spearman FROM r")
def space_correlations(spark, sf_dir):
    return T.correlations(_halves(spark, sf_dir), "sa", "sb").withColumns({c: F.round(c, 4) for c in ("pearson", "spearman")})


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.label, round(max(list_cosine_similarity(a.e, b.e)), 5) AS best FROM v a JOIN v b ON a.label = b.label WHERE a.vec_id % 25 = 0 AND b.vec_id % 25 = 5 GROUP BY a.label""")
def reference_cosines(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return T.reference_cosine(e.filter("vec_id % 25 = 0"), e.filter("vec_id % 25 = 5"), "label", "embedding").withColumn("best", F.round("best", 5))
