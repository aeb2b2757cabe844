"""Queries on vector columns. Neighbour searches take as queries every row whose id is divisible by 20, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaloam.functions import vectors as V
from metaloam.operators import agreement, calibration
from metaloam.operators import neighbours as N
from metaloam.registry import query, table

_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
_FOUND = f"""
WITH v AS (SELECT vec_id AS id, label, vec_id % 7 AS grp, {_UNIT} AS u FROM embeddings),
pairs AS (SELECT q.id AS query_id, i.id AS item_id, round(list_dot_product(q.u, i.u), 9) AS sim, q.label AS ql, i.label AS il, i.grp AS ig
    FROM v q JOIN v i ON q.id <> i.id AND <blocked> WHERE q.id % 20 = 0),
found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id) AS rank FROM pairs QUALIFY rank <= 10)
"""
_ALL, _BLOCKED = (_FOUND.replace("<blocked>", x) for x in ("true", "q.grp <> i.grp"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"), (F.col("vec_id") % 7).alias("grp"))


def _found(spark: SparkSession, sf_dir: str, blocked: bool = False) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    return v, N.top_k(v.filter("id % 20 = 0"), v, 10, blocked_by_group=blocked)


@query(_BLOCKED + "SELECT query_id, ql::BIGINT AS label, round(avg((ql = il)::INT), 6) AS purity FROM found GROUP BY ALL")
def knn_purity_blocked(spark, sf_dir):
    v, found = _found(spark, sf_dir, True)
    return N.purity(found, v).withColumn("purity", F.round("purity", 6))


@query(_ALL + "SELECT query_id, item_id, round(sim, 6) AS sim, rank::INT AS rank FROM found")
def knn_top_k(spark, sf_dir):
    return _found(spark, sf_dir)[1].withColumn("sim", F.round("sim", 6))


@query(_ALL + """, votes AS (SELECT query_id, il AS label, round(sum(sim), 6) AS votes FROM found GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS n, sum(votes) OVER (PARTITION BY query_id) AS t FROM votes)
SELECT query_id, label::BIGINT AS predicted, round(votes / t, 5) AS confidence FROM r WHERE n = 1""")
def knn_vote(spark, sf_dir):
    v, found = _found(spark, sf_dir)
    return N.vote(found, v).withColumn("confidence", F.round("confidence", 5))


@query(_ALL + """, s AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY query_id, ig) AS share FROM found),
votes AS (SELECT query_id, il AS label, round(sum(share), 9) AS votes, min(rank) AS closest FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, closest, label) AS n, sum(votes) OVER (PARTITION BY query_id) AS t FROM votes)
SELECT query_id, label::BIGINT AS predicted, round(votes / t, 5) AS confidence FROM r WHERE n = 1""")
def knn_group_vote(spark, sf_dir):
    v, found = _found(spark, sf_dir)
    return N.group_vote(found, v).withColumn("confidence", F.round("confidence", 5))


@query(_BLOCKED + """, nearest AS (SELECT query_id, sim AS nearest_sim FROM found WHERE rank = 1), limit_ AS (SELECT quantile_cont(nearest_sim, 0.05) AS t FROM nearest)
SELECT query_id, round(nearest_sim, 6) AS nearest_sim, round(t, 6) AS threshold, nearest_sim >= t AS covered FROM nearest, limit_""")
def coverage_flag(spark, sf_dir):
    return N.coverage(_found(spark, sf_dir, True)[1]).withColumns({c: F.round(c, 6) for c in ("nearest_sim", "threshold")})


@query("""WITH u AS (SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings),
p AS (SELECT q.id AS query_id, i.id AS item_id, round(list_dot_product(q.a, i.a) / sqrt(list_dot_product(q.a, q.a)) / sqrt(list_dot_product(i.a, i.a)), 9) AS sa,
    round(list_dot_product(q.b, i.b) / sqrt(list_dot_product(q.b, q.b)) / sqrt(list_dot_product(i.b, i.b)), 9) AS sb FROM u q JOIN u i ON q.id <> i.id WHERE q.id % 20 = 0),
a AS (SELECT query_id, item_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sa DESC, item_id) <= 10),
b AS (SELECT query_id, item_id FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sb DESC, item_id) <= 10)
SELECT a.query_id, round(count(b.item_id) / 10.0::DOUBLE, 6) AS overlap FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.item_id = b.item_id GROUP BY a.query_id""")
def neighbour_overlap(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    halves = [v.withColumn("vector", F.slice("vector", at, 32)) for at in (1, 33)]
    a, b = (N.top_k(h.filter("id % 20 = 0"), h, 10) for h in halves)
    return N.overlap(a, b).withColumn("overlap", F.round("overlap", 6))


@query(f"""WITH v AS (SELECT label, {_UNIT} AS u FROM embeddings), d AS (SELECT label, unnest(u) AS x, unnest(range(1, 65)) AS pos FROM v),
s AS (SELECT label, pos, sum(x) AS s, count(*) AS n FROM d GROUP BY ALL)
SELECT label::BIGINT AS label, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS coherence FROM s GROUP BY label""")
def cluster_coherence(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return N.coherence(v.withColumn("vector", V.unit(F.col("vector"))), "label").withColumn("coherence", F.round("coherence", 6))


@query("""WITH d AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(x) AS m FROM d GROUP BY ALL),
f AS (SELECT d.label, vec_id, sqrt(sum((x - m) * (x - m))) AS far FROM d JOIN m ON d.label = m.label AND d.pos = m.pos GROUP BY ALL)
SELECT label::BIGINT AS label, count(*) AS n, round(quantile_cont(far, 0.95), 5) AS radius FROM f GROUP BY label""")
def centroid_radius(spark, sf_dir):
    return N.centroid_radius(_vectors(spark, sf_dir), "label").withColumn("radius", F.round("radius", 5))


@query(_ALL + """, p AS (SELECT round(sim, 4) AS sim, ql = il AS same FROM found), n AS (SELECT sim, count(*) FILTER (WHERE same) AS p, count(*) AS t FROM p GROUP BY sim),
r AS (SELECT *, coalesce(sum(t) OVER (ORDER BY sim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0::DOUBLE AS mr FROM n),
s AS (SELECT sum(mr * p) AS ranks, sum(p)::DOUBLE AS p, sum(t)::DOUBLE AS t FROM r)
SELECT p::BIGINT AS n_positive, (t - p)::BIGINT AS n_negative, round((ranks - p * (p + 1) / 2) / (p * (t - p)), 6) AS auc FROM s""")
def pair_auc(spark, sf_dir):
    v, found = _found(spark, sf_dir)
    lab = v.select("id", "label")
    pairs = found.join(lab.toDF("query_id", "a"), "query_id").join(lab.toDF("item_id", "b"), "item_id").select(F.round("sim", 4).alias("sim"), (F.col("a") == F.col("b")).alias("same"))
    return agreement.auc(pairs, "sim", "same").withColumn("auc", F.round("auc", 6))


@query(_ALL + """, votes AS (SELECT query_id, ql, il AS label, round(sum(sim), 6) AS votes FROM found GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) AS n, sum(votes) OVER (PARTITION BY query_id) AS t FROM votes),
c AS (SELECT round(votes / t, 4) AS threshold, count(*) AS n, sum((ql = label)::INT) AS hits FROM r WHERE n = 1 GROUP BY ALL)
SELECT threshold, (sum(n) OVER w)::BIGINT AS n_above, round(sum(hits) OVER w / sum(n) OVER w, 6) AS precision, round(sum(n) OVER w / sum(n) OVER (), 6) AS coverage
FROM c WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")
def precision_coverage_curve(spark, sf_dir):
    v, found = _found(spark, sf_dir)
    voted = N.vote(found, v).join(v.select(F.col("id").alias("query_id"), "label"), "query_id").select(F.round("confidence", 4).alias("confidence"), (F.col("predicted") == F.col("label")).alias("correct"))
    return calibration.curve(voted, "confidence", "correct").withColumns({c: F.round(c, 6) for c in ("precision", "coverage")})


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS manhattan_norm,
round(list_max(embedding)::DOUBLE, 5) AS largest, true AS finite FROM embeddings""")
def vector_structure(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    zero = F.array_repeat(F.lit(0.0), 64)
    return v.select(F.col("id").alias("vec_id"), F.round(V.norm(F.col("vector")), 5).alias("norm"), F.round(V.manhattan(F.col("vector"), zero), 4).alias("manhattan_norm"), F.round(F.array_max("vector"), 5).alias("largest"), V.finite(F.col("vector")).alias("finite"))
