"""Queries of vector tables, pairs and corrected neighbours, on embeddings, parts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.functions import vectors as X
from metaloam.operators import vector_tables as T
from metaloam.plans import neighbours as P
from metaloam.registry import query, table


def _texts(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.concat(F.lit("text "), F.col("label").cast("string")).alias("text"), F.transform("embedding", lambda x, i: F.when(i < 3, F.col("label") + i + 1).otherwise(0).cast("double")).alias("vector"))


@query("SELECT vec_id AS id, 'text ' || label AS text, round((label + 1) / sqrt(pow(label + 1, 2) + pow(label + 2, 2) + pow(label + 3, 2)), 6) AS head FROM embeddings")
def dictionary_vectors(spark, sf_dir):
    rows = _texts(spark, sf_dir).withColumnRenamed("vec_id", "id")
    facts, dictionary = T.encoded(rows, "text", "vector")
    return T.decoded(facts, dictionary, "vector").select("id", "text", F.round(F.col("vector")[0], 6).alias("head"))


@query("SELECT p_partkey, 'text ' || (p_size % 12) AS text, (p_size % 12) IN (SELECT label FROM embeddings) AS found FROM part")
def gathered_vectors(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("text "), (F.col("p_size") % 12).cast("string")).alias("text"))
    return T.gathered(wanted, _texts(spark, sf_dir), "text", "vector").select("p_partkey", "text", "found")


@query("SELECT 'd' || (n_nationkey % 5) AS domain, unnest(['wide', 'long']) AS kind, '20240103' AS date FROM nation WHERE n_nationkey < 5")
def latest_files(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 15")
    k = F.col("n_nationkey")
    day = F.concat(F.lit("2024010"), (F.lit(3) - F.floor(k / 5)).cast("string"))
    names = n.select(F.explode(F.array(*(F.concat(F.lit("d"), (k % 5).cast("string"), F.lit(f"_{x}_"), day, F.lit(".tsv.gz")) for x in ("wide", "long")), F.lit("other.txt"))).alias("name"))
    return T.latest_snapshot(names, "name", ("wide", "long")).select("domain", "kind", "date")


_PAIRS = "p AS (SELECT x.vec_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 9) AS sim, x.label = y.label AS same FROM embeddings x JOIN embeddings y ON y.vec_id = (x.vec_id + <shift>) % (SELECT count(*) FROM embeddings))"


def _pairs(spark, sf_dir, shift):
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    both = T.shifted_pairs(e, "vec_id", "vec_id", n, shift)
    return both.select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("embedding_2")), 9).alias("sim"), (F.col("label") == F.col("label_2")).alias("same"))


@query(f"WITH {_PAIRS.replace('<shift>', '7')} SELECT count(*) FILTER (WHERE same) AS n_same, count(*) FILTER (WHERE NOT same) AS n_different, round(avg(sim) FILTER (WHERE same), 6) AS same, round(avg(sim) FILTER (WHERE NOT same), 6) AS different, round(avg(sim) FILTER (WHERE same) - avg(sim) FILTER (WHERE NOT same), 6) AS gap, round((avg(sim) FILTER (WHERE same) - avg(sim) FILTER (WHERE NOT same)) / sqrt(((count(*) FILTER (WHERE same) - 1) * var_samp(sim) FILTER (WHERE same) + (count(*) FILTER (WHERE NOT same) - 1) * var_samp(sim) FILTER (WHERE NOT same)) / (count(*) - 2)), 5) AS cohens_d FROM p")
def pair_statistics(spark, sf_dir):
    out = T.pair_statistics(_pairs(spark, sf_dir, 7), "sim", "same")
    return out.withColumns({c: F.round(c, 6) for c in ("same", "different", "gap")} | {"cohens_d": F.round("cohens_d", 5)})


@query(f"WITH {_PAIRS.replace('<shift>', '10').replace('p AS', 'a AS')}, {_PAIRS.replace('<shift>', '13')} SELECT round(x.m, 6) AS aligned, round(x.s, 6) AS aligned_sd, round(y.m, 6) AS background, round(y.s, 6) AS background_sd, round(x.m - y.m, 6) AS lift FROM (SELECT avg(sim) AS m, stddev_pop(sim) AS s FROM a) x, (SELECT avg(sim) AS m, stddev_pop(sim) AS s FROM p) y")
def background_lift(spark, sf_dir):
    out = T.lift(_pairs(spark, sf_dir, 10), _pairs(spark, sf_dir, 13), "sim")
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query(P._ALL + ", m AS (SELECT item_id, avg(sim) AS mean FROM found GROUP BY 1), h AS (SELECT query_id, item_id, round(sim - mean / 2, 9) AS sim FROM found JOIN m USING (item_id)) SELECT query_id, item_id, round(sim, 6) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, item_id)::INT AS rank FROM h")
def hub_corrected(spark, sf_dir):
    found = P._found(spark, sf_dir)[1]
    local = found.groupBy("item_id").agg(F.avg("sim").alias("mean"))
    return T.hub_corrected(found, local).withColumn("sim", F.round("sim", 6))


@query(P._ALL + "SELECT query_id, round(avg(sim), 6) AS mean, arg_min(item_id, rank) AS nearest FROM found WHERE rank <= 5 GROUP BY 1")
def mean_of_nearest(spark, sf_dir):
    return T.top_mean(P._found(spark, sf_dir)[1], 5).withColumn("mean", F.round("mean", 6))


@query(P._BLOCKED + """, t AS (SELECT query_id, max(sim) AS top FROM found GROUP BY 1), pr AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS share FROM embeddings GROUP BY 1), vv AS (SELECT query_id, il AS label, round(sum(exp((sim - top) / 0.1)) * pow(any_value(share), -0.5), 9) AS w FROM found JOIN t USING (query_id) JOIN pr ON pr.label = il GROUP BY ALL)
SELECT query_id, arg_min(label, row(-w, label))::BIGINT AS predicted, round(max(w) / sum(w), 6) AS share FROM vv GROUP BY 1""")
def weighted_vote(spark, sf_dir):
    v, found = P._found(spark, sf_dir, True)
    total = v.agg(F.count(F.lit(1)).alias("all"))
    prior = v.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select("label", (F.col("n") / F.col("all")).alias("share"))  # total is one row
    return T.weighted_vote(found, v, 0.1, prior, -0.5).withColumn("share", F.round("share", 6))


@query(P._ALL + ", z AS (SELECT vec_id % 7 AS g, count(*) - 1 AS others FROM embeddings GROUP BY 1), s AS (SELECT query_id, others, avg((query_id % 7 = ig)::INT) AS share FROM found JOIN z ON z.g = query_id % 7 GROUP BY ALL) SELECT query_id, round(share, 6) AS share, round(share / (least(others, 10) / 10.0::DOUBLE), 6) AS of_reachable FROM s")
def group_at_k(spark, sf_dir):
    v, found = P._found(spark, sf_dir)
    return T.group_at_k(found, v.select("id", "grp"), 10).withColumns({c: F.round(c, 6) for c in ("share", "of_reachable")})


@query(P._BLOCKED + "SELECT count(*) AS n, round(avg((ql = il)::INT), 6) AS agree FROM found WHERE rank = 1 AND sim >= 0.2")
def agreeing_nearest(spark, sf_dir):
    v, found = P._found(spark, sf_dir, True)
    return T.agreeing_nearest(found, v, 0.2).withColumn("agree", F.round("agree", 6))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part), e AS (SELECT p_partkey, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w), t AS (SELECT p_partkey, pos, CASE WHEN length(word) % 2 = 0 THEN 'T' || length(word) ELSE word END AS t FROM e)
SELECT p_partkey, string_agg(t, ';' ORDER BY pos) AS terms FROM (SELECT p_partkey, t, min(pos) AS pos FROM t GROUP BY ALL) GROUP BY 1""")
def nearest_terms(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"))
    words = p.select(F.explode("words").alias("word")).distinct()
    size = F.char_length("word")
    found = words.select("word", size.cast("long").alias("term_id"), F.when(size % 2 == 0, 0.9).otherwise(0.4).alias("sim"))
    terms = found.select("term_id", F.concat(F.lit("T"), F.col("term_id").cast("string")).alias("term")).distinct()
    return T.nearest_terms(p, found, terms, "p_partkey", "word", 0.5).withColumn("terms", F.array_join("terms", ";"))


@query("""SELECT x.vec_id AS query_id, y.vec_id AS item_id, round(round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6), 4) AS distance FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0
QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY round(list_distance(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6), y.vec_id) <= 3""")
def nearest_of_label(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("a"))
    i = e.select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").alias("b"))
    pairs = q.join(i, "label").filter("query_id <> item_id")
    return T.k_nearest_euclidean(pairs, "query_id", "a", "b", "item_id", 3).select("query_id", "item_id", F.round("distance", 4).alias("distance"))


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS slot, o_orderstatus AS text, (o_custkey * 7919 % 1009) / 1009.0::DOUBLE AS p FROM orders), a AS (SELECT * FROM r WHERE p < (SELECT quantile_cont(p, 0.2) FROM r))
SELECT slot, text, md5(slot || chr(9) || text) AS request, count(*) AS n FROM a GROUP BY slot, text""")
def request_batch(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("slot"), F.col("o_orderstatus").alias("text"), (F.col("o_custkey") * 7919 % 1009 / 1009).alias("p"))
    return T.request_batch(rows, "p", 0.2, ["slot", "text"])[0]
