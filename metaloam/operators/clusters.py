"""Clusters: fitting, naming and scoring of their words."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_k_means(rows: DataFrame, ks: list[int], seed: int = 42) -> tuple[DataFrame, int]:
    """k-means for each k; the rows with ``cluster`` of the k with the best silhouette, and that k."""
    data = rows.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double")))).persist()
    best = None
    for k in ks:
        found = KMeans(k=k, seed=seed, predictionCol="cluster").fit(data).transform(data)
        score = ClusteringEvaluator(predictionCol="cluster").evaluate(found)
        if best is None or score > best[0]:
            best = (score, k, found)
    data.unpersist()
    return best[2].drop("features"), best[1]


def principal_components(rows: DataFrame, k: int) -> DataFrame:
    """Rows with ``reduced``: the first k principal components (their signs are arbitrary)."""
    data = rows.withColumn("features", array_to_vector(F.transform("vector", lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="features", outputCol="_pca").fit(data).transform(data).withColumn("reduced", vector_to_array("_pca")).drop("features", "_pca")


def phrase_scores(terms: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Per cluster and term: df_c * exclusivity^alpha. ``terms``: cluster, id, term; df counts ids; exclusivity is the
    cluster's share of the term's uses, with one added to each cluster's count."""
    n = terms.groupBy("cluster", "term").agg(F.countDistinct("id").alias("df_c"), F.count(F.lit(1)).alias("tf_c"))
    clusters = terms.agg(F.countDistinct("cluster").alias("k"))
    out = n.join(F.broadcast(clusters)).withColumn("all", F.sum("tf_c").over(Window.partitionBy("term")))  # clusters is one row
    return out.select("cluster", "term", "df_c", (F.col("df_c") * F.pow((F.col("tf_c") + 1) / (F.col("all") + F.col("k")), F.lit(alpha))).alias("score"))


def unique_names(scores: DataFrame, most: int = 3) -> DataFrame:
    """cluster and name: its best term, with the second and third where names collide, and its number if they still do."""
    top = scores.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), "term"))).filter(F.col("n") <= most)
    listed = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "term"))), lambda x: x["term"]).alias("t"))
    name = F.get("t", F.lit(0))
    out = listed.withColumn("name", name)
    for i in range(1, most):
        shared = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
        out = out.withColumn("_shared", shared).withColumn("name", F.when(F.col("_shared") & (F.size("t") > i), F.concat_ws("_", "name", F.get("t", F.lit(i)))).otherwise(F.col("name")))
    out = out.withColumn("_shared", F.count(F.lit(1)).over(Window.partitionBy("name")) > 1)
    return out.select("cluster", F.when(F.col("_shared"), F.concat("name", F.lit("_c"), F.col("cluster").cast("string"))).otherwise(F.col("name")).alias("name"))


def agreement_indices(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two partitions; one row.

    All comes from the counts of their cells: no pairs are made.
    """
    n = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    entropy = lambda c: F.log(F.sum(c)) - F.sum(F.col(c) * F.log(c)) / F.sum(c)
    cells = n.agg(pairs("n").alias("cell"), F.sum("n").alias("all"), entropy("n").alias("joint"))
    sides = [n.groupBy(x).agg(F.sum("n").alias("m")).agg(pairs("m").alias(f"p{x}"), entropy("m").alias(f"h{x}")) for x in "ab"]
    one = cells.join(F.broadcast(sides[0])).join(F.broadcast(sides[1]))  # one row each
    expected = F.col("pa") * F.col("pb") / (F.col("all") * (F.col("all") - 1) / 2)
    most = (F.col("pa") + F.col("pb")) / 2
    shared = F.col("ha") + F.col("hb") - F.col("joint")
    ari = F.when(most != expected, (F.col("cell") - expected) / (most - expected)).otherwise(1.0)
    return one.select(ari.alias("ari"), F.when(F.col("ha") + F.col("hb") > 0, 2 * shared / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"))


def knn_graph(found: DataFrame) -> DataFrame:
    """Undirected edges a < b of neighbours (query_id, item_id, sim), each with its greatest similarity."""
    return found.filter("query_id <> item_id").groupBy(F.least("query_id", "item_id").alias("a"), F.greatest("query_id", "item_id").alias("b")).agg(F.max("sim").alias("sim"))


def cluster_summary(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """Per cluster its size, most frequent label (ties: the lesser) and that label's share."""
    n = rows.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("m"))
    return n.groupBy(cluster).agg(F.sum("m").alias("n"), F.min_by(label, F.struct(-F.col("m"), label)).alias("label"), (F.max("m") / F.sum("m")).alias("share"))


def term_counts(terms: DataFrame, most: int = 3) -> DataFrame:
    """Per cluster its most frequent terms as ``term (n, p%)``, joined; n counts ids. ``terms``: cluster, id, term."""
    n = terms.groupBy("cluster", "term").agg(F.countDistinct("id").alias("n"))
    size = terms.groupBy("cluster").agg(F.countDistinct("id").alias("size"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "term"))
    top = n.withColumn("place", place).filter(F.col("place") <= most).join(size, "cluster")
    text = F.concat("term", F.lit(" ("), F.col("n").cast("string"), F.lit(", "), F.format_string("%.1f", 100 * F.col("n") / F.col("size")), F.lit("%)"))
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text.alias("t")))), lambda x: x["t"]), "; ").alias("terms"))


def telling_terms(terms: DataFrame, few: int, most: int) -> DataFrame:
    """Per cluster its most frequent terms among those of ``few`` clusters at most: cluster, term, n."""
    n = terms.groupBy("cluster", "term").agg(F.count(F.lit(1)).alias("n"))
    spread = n.groupBy("term").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= few)
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "term"))
    return n.join(spread.select("term"), "term", "left_semi").withColumn("place", place).filter(F.col("place") <= most).select("cluster", "term", "n")
