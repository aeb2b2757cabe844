"""Exact nearest neighbours over vector columns, and what is computed from them.

A query set is compared with all rows block by block: a block of queries of bounded size is broadcast, each partition of
candidates computes its similarities by one matrix product and keeps its k best per query, and only those are moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block: 64-d vectors of it take some 5 MB. And candidates that are compared with them at once: 80 MB.
BLOCK, CANDIDATES = 10_000, 1024


def best_columns(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Per row the columns of the k greatest values, of equal ones those of the least ids; in no order."""
    if sims.shape[1] <= k:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k].copy()
    taken = np.take_along_axis(sims, part, 1)
    last = taken.min(1, keepdims=True)
    for i in np.flatnonzero((sims == last).sum(1) > (taken == last).sum(1)):  # ties at the edge
        part[i] = np.lexsort((ids[i], -sims[i]))[:k]
    return part


def top_k(queries: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, blocked_by_group: bool = False) -> DataFrame:
    """The k most similar items (cosine) of each query: query_id, item_id, sim, rank (1 first; ties to the lesser id).

    Both have id, vector (64-bit floats) and, with ``blocked_by_group``, grp: items of the query's own group, and the query
    itself, are left out. Vectors are scaled to unit length; zero vectors have similarity 0. Similarities are rounded to
    9 digits before ranking, so equal vectors tie.
    """
    spark = items.sparkSession
    blocks = 1 + queries.count() // block
    names = ["id", "vector"] + ["grp"] * blocked_by_group
    parts = []
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select(*names).toPandas()
        if own.empty:
            continue
        matrix = np.stack([np.asarray(v, np.float64) for v in own["vector"]])
        shared = spark.sparkContext.broadcast((own["id"].to_numpy(), matrix / np.maximum(np.linalg.norm(matrix, axis=1), 1e-300)[:, None], own["grp"].to_numpy() if blocked_by_group else None))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q, groups = shared.value
            kept = None
            for rows in batches:
                for lo in range(0, len(rows), CANDIDATES):
                    part = rows.iloc[lo : lo + CANDIDATES]
                    m = np.stack([np.asarray(v, np.float64) for v in part["vector"]])
                    sims = np.round(q @ (m / np.maximum(np.linalg.norm(m, axis=1), 1e-300)[:, None]).T, 9)
                    own_ids = part["id"].to_numpy()
                    sims[ids[:, None] == own_ids[None, :]] = -np.inf
                    if groups is not None:
                        sims[groups[:, None] == part["grp"].to_numpy()[None, :]] = -np.inf
                    found = np.broadcast_to(own_ids, sims.shape)
                    if kept is not None:
                        sims, found = np.concatenate([kept[0], sims], 1), np.concatenate([kept[1], found], 1)
                    best_of = best_columns(sims, found, k)
                    kept = np.take_along_axis(sims, best_of, 1), np.take_along_axis(found, best_of, 1)
            if kept is not None:
                n = kept[0].shape[1]
                out = pd.DataFrame({"query_id": np.repeat(ids, n), "item_id": kept[1].ravel(), "sim": kept[0].ravel()})
                yield out[np.isfinite(out["sim"])]

        parts.append(items.select(*names).mapInPandas(best, "query_id long, item_id long, sim double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, item_id long, sim double, rank int")
    merged = reduce(DataFrame.unionAll, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "item_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k)


def purity(found: DataFrame, labels: DataFrame, k: int = 10) -> DataFrame:
    """Per query the share of its neighbours with its own label: query_id, label, purity. ``labels``: id, label."""
    own = labels.select(F.col("id").alias("query_id"), F.col("label").alias("label"))
    theirs = labels.select(F.col("id").alias("item_id"), F.col("label").alias("item_label"))
    return found.filter(F.col("rank") <= k).join(theirs, "item_id").join(own, "query_id").groupBy("query_id", "label").agg(F.avg((F.col("item_label") == F.col("label")).cast("double")).alias("purity"))


def vote(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Neighbours vote with their similarity: query_id, predicted, confidence (the winner's share). Ties to the least label."""
    votes = found.join(labels.select(F.col("id").alias("item_id"), "label"), "item_id").groupBy("query_id", "label").agg(F.round(F.sum("sim"), 6).alias("votes"))
    return _winner(votes)


def group_vote(found: DataFrame, labels: DataFrame) -> DataFrame:
    """One vote for each group among a query's neighbours, split evenly between them. ``labels``: id, label, grp.

    Votes are rounded to 9 digits; ties go to the label with the closest neighbour.
    """
    rows = found.join(labels.select(F.col("id").alias("item_id"), "label", "grp"), "item_id")
    share = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("query_id", "grp"))
    votes = rows.withColumn("share", share).groupBy("query_id", "label").agg(F.round(F.sum("share"), 9).alias("votes"), F.min("rank").alias("closest"))
    return _winner(votes, F.col("closest"))


def _winner(votes: DataFrame, *ties: Column) -> DataFrame:
    by = Window.partitionBy("query_id")
    order = by.orderBy(F.desc("votes"), *ties, "label")
    ranked = votes.withColumns({"n": F.row_number().over(order), "all": F.sum("votes").over(by)})
    return ranked.filter("n = 1").select("query_id", F.col("label").alias("predicted"), (F.col("votes") / F.col("all")).alias("confidence"))


def coverage(found: DataFrame, quantile: float = 0.05) -> DataFrame:
    """The nearest similarity of each query, the quantile of them as threshold, and whether a query reaches it."""
    nearest = found.filter("rank = 1").select("query_id", F.col("sim").alias("nearest_sim"))
    limit = nearest.agg(F.percentile("nearest_sim", F.lit(quantile)).alias("threshold"))
    return nearest.join(F.broadcast(limit)).withColumn("covered", F.col("nearest_sim") >= F.col("threshold"))  # limit is one row


def overlap(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """Share of neighbours that two spaces have in common, per query."""
    both = a.select("query_id", "item_id").join(b.select("query_id", "item_id"), ["query_id", "item_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return a.select("query_id").distinct().join(both, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / k).alias("overlap"))


def vector_sums(rows: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """Per group and dimension the sum, and the number of rows: by, pos, s, n. Each task sums its rows' vectors by group, so
    that only sums are exploded and moved.
    """

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, list] = {}

        def told() -> pd.DataFrame:
            out = pd.DataFrame({by: list(sums), "s": [s.tolist() for s, _ in sums.values()], "n": [n for _, n in sums.values()]})
            sums.clear()
            return out

        for part in batches:
            for key, v in zip(part[by], part[vector], strict=True):
                x = np.asarray(v, np.float64)
                if key in sums:
                    sums[key][0] += x
                    sums[key][1] += 1
                else:
                    sums[key] = [x.copy(), 1]
            if len(sums) > 10_000:
                yield told()
        if sums:
            yield told()

    kind = rows.schema[by].dataType.simpleString()
    partial = rows.filter(F.col(by).isNotNull()).select(by, vector).mapInPandas(summed, f"{by} {kind}, s array<double>, n long")
    return partial.select(by, F.posexplode("s").alias("pos", "x"), "n").groupBy(by, "pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))


def coherence(rows: DataFrame, by: str) -> DataFrame:
    """Mean cosine of all pairs of a group, from the sum of its unit vectors: (|sum|^2 - n) / (n (n - 1))."""
    sums = vector_sums(rows, by).groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n"))
    return sums.select(by, "n", F.when(F.col("n") > 1, (F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("coherence"))


def centroid_radius(rows: DataFrame, by: str, quantile: float = 0.95) -> DataFrame:
    """Per group the norm of its mean vector and a quantile of the members' distances to it."""
    means = vector_sums(rows, by).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("centre"))
    far = F.sqrt(F.aggregate(F.zip_with("vector", "centre", lambda x, c: F.pow(x.cast("double") - c, 2)), F.lit(0.0), lambda a, x: a + x))
    return rows.join(means, by).withColumn("far", far).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.percentile("far", F.lit(quantile)).alias("radius"))
