"""Queries of models, clusters and services. Most have no SQL form; tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.functions.stable import stable_fold
from metaloam.functions.text import tokens
from metaloam.operators import batches, clusters, models, resampling
from metaloam.plans.neighbours import _vectors
from metaloam.registry import query, table

_HEX = "md5('22:' || vec_id::VARCHAR)"
_FOLD = f"list_sum(list_transform(string_split({_HEX}, ''), lambda d: instr('0123456789abcdef', d) - 1)) % 5"


def _split(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("fold", stable_fold(22, F.col("id"), 5))
    return v.filter("fold <> 0"), v.filter("fold = 0")


@query(f"""WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e, {_FOLD} AS fold FROM embeddings),
d AS (SELECT label, unnest(e) AS x, unnest(range(1, 65)) AS pos FROM v WHERE fold <> 0), c AS (SELECT pos, avg(x) AS c FROM d GROUP BY pos),
m AS (SELECT d.label, d.pos, avg(x) - any_value(c) AS m FROM d JOIN c ON d.pos = c.pos GROUP BY ALL),
p AS (SELECT label, list(m ORDER BY pos) AS m FROM m GROUP BY label), cc AS (SELECT list(c ORDER BY pos) AS c FROM c),
t AS (SELECT id, v.label, list_transform(list_zip(e, c), lambda z: z[1] - z[2]) AS x FROM v, cc WHERE fold = 0),
s AS (SELECT id, p.label, round(list_dot_product(x, m) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(x, x)), 9) AS score FROM t, p),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS n FROM s)
SELECT id, max(CASE WHEN n = 1 THEN label END)::BIGINT AS predicted, round(max(score) - min(score), 5) AS margin FROM r WHERE n <= 2 GROUP BY id""")
def prototype_transfer(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return models.prototype_predict(test, models.prototypes(train)).withColumn("margin", F.round("margin", 5))


@query()
def ridge_transfer(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    n = int(train.agg(F.max("label")).first()[0]) + 1
    return models.linear_predict(test, models.ridge(train, n)).withColumn("margin", F.round("margin", 6))


@query()
def k_means_silhouette(spark, sf_dir):
    found, k = clusters.best_k_means(_vectors(spark, sf_dir).select("id", "vector"), [5, 10, 15])
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k))


_WORDS = "regexp_extract_all(text, '[A-Za-z0-9]+')"


@query(f"""WITH t AS (SELECT doc_id AS id, lang AS cluster, unnest({_WORDS}) AS term FROM documents),
n AS (SELECT cluster, term, count(DISTINCT id) AS df_c, count(*) AS tf_c FROM t GROUP BY ALL), k AS (SELECT count(DISTINCT cluster) AS k FROM t)
SELECT cluster, term, df_c, round(df_c * ((tf_c + 1)::DOUBLE / (sum(tf_c) OVER (PARTITION BY term) + k)), 6) AS score FROM n, k""")
def cluster_phrase_scores(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cluster"), F.explode(tokens(F.col("text"))).alias("term"))
    return clusters.phrase_scores(terms).withColumn("score", F.round("score", 6))


@query(f"""WITH t AS (SELECT doc_id AS id, source AS cluster, unnest({_WORDS}) AS term FROM documents), n AS (SELECT cluster, term, count(DISTINCT id) AS df_c, count(*) AS tf_c FROM t GROUP BY ALL), k AS (SELECT count(DISTINCT cluster) AS k FROM t),
s AS (SELECT cluster, term, round(df_c * ((tf_c + 1)::DOUBLE / (sum(tf_c) OVER (PARTITION BY term) + k)), 6) AS score FROM n, k), r AS (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS i FROM s QUALIFY i <= 3),
l AS (SELECT cluster, list(term ORDER BY i) AS t FROM r GROUP BY cluster), a AS (SELECT cluster, t, t[1] AS name FROM l), b AS (SELECT cluster, t, CASE WHEN count(*) OVER (PARTITION BY name) > 1 AND len(t) > 1 THEN name || '_' || t[2] ELSE name END AS name FROM a),
c AS (SELECT cluster, t, CASE WHEN count(*) OVER (PARTITION BY name) > 1 AND len(t) > 2 THEN name || '_' || t[3] ELSE name END AS name FROM b) SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '_c' || cluster ELSE name END AS name FROM c""")
def cluster_names(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("cluster"), F.explode(tokens(F.col("text"))).alias("term"))
    return clusters.unique_names(clusters.phrase_scores(terms).withColumn("score", F.round("score", 6)))


@query(f"""WITH t AS (SELECT doc_id AS id, unnest({_WORDS}) AS term FROM documents), tf AS (SELECT id, term, 1 + ln(count(*)) AS tf FROM t GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), n AS (SELECT count(DISTINCT id) AS n FROM t),
w AS (SELECT id, term, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n)
SELECT id, count(*) AS n_terms, round(max(w) / sqrt(sum(w * w)), 5) AS top_weight FROM w GROUP BY id""")
def tf_idf_top(spark, sf_dir):
    terms = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(tokens(F.col("text"))).alias("term"))
    return models.tf_idf(terms).groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.max("weight"), 5).alias("top_weight"))


@query()
def ffd_pack(spark, sf_dir):
    return batches.pack_rows(table(spark, sf_dir, "documents"), "doc_id", "n_chars", 20_000)


@query("""SELECT doc_id, floor(doc_id / 50)::BIGINT AS task FROM documents""")
def request_tasks(spark, sf_dir):
    return batches.fixed_groups(table(spark, sf_dir, "documents"), "doc_id", 50).select("doc_id", "task")


@query("""WITH s AS (SELECT o_orderpriority AS g, sum((o_totalprice > 150000)::INT)::DOUBLE AS sa, sum((o_orderstatus = 'F')::INT)::DOUBLE AS sb, count(*) AS n FROM orders GROUP BY ALL),
i AS (SELECT *, row_number() OVER (ORDER BY g) AS i, count(*) OVER () AS k FROM s),
t AS (SELECT round, i, k FROM i, (SELECT unnest(range(1, 201)) AS round)),
d AS (SELECT round, ('0x' || md5('22:' || round || ':' || i)[1:8])::BIGINT % k + 1 AS j FROM t),
m AS (SELECT round, (sum(sa) - sum(sb)) / sum(n) AS d FROM d JOIN i ON d.j = i.i GROUP BY round)
SELECT round((SELECT (sum(sa) - sum(sb)) / sum(n) FROM s), 6) AS difference, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high FROM m""")
def group_bootstrap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") > 150000).cast("int").alias("a"), (F.col("o_orderstatus") == "F").cast("int").alias("b"))
    return resampling.group_bootstrap(o, "o_orderpriority", "a", "b").select(*(F.round(c, 6).alias(c) for c in ("difference", "low", "high")))
