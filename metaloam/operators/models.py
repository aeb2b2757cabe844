"""Label transfer models on vector columns: prototypes, ridge regression and TF-IDF."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metaloam.operators.neighbours import vector_sums
from metaloam.operators.shared import stored


def prototypes(train: DataFrame, beta: float = 0.0) -> DataFrame:
    """Per label (label, vector) its centred mean direction and bias beta * log n; the centre is the mean of all rows."""
    sums = vector_sums(train, "label")
    centre = sums.groupBy("pos").agg((F.sum("s") / F.sum("n")).alias("c"))
    means = sums.join(F.broadcast(centre), "pos").select("label", "pos", "n", (F.col("s") / F.col("n") - F.col("c")).alias("m"), "c")  # one row per dimension
    rows = means.groupBy("label").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "m", "c"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("len"))
    return rows.select("label", F.transform("v", lambda x: x["m"] / F.greatest("len", F.lit(1e-12))).alias("direction"), F.transform("v", lambda x: x["c"]).alias("centre"), (beta * F.log("n")).alias("bias"))


#: Bytes of a model that each row is scored against at once; a larger one is joined, row by label.
MODEL_BYTES = 32 << 20


def prototype_predict(rows: DataFrame, model: DataFrame, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """Best label and its margin over the second: id, predicted, margin. Ties go to the lesser label.

    A model of bounded size (measured) is broadcast as one row and scored inside each row; beyond, labels are joined.
    """
    told = model.agg(F.sum(8 * F.size("direction") + 64)).first()[0] or 0
    centred = F.zip_with("vector", "centre", lambda x, c: x.cast("double") - c)
    if told <= model_bytes:
        one = model.agg(F.collect_list(F.struct("label", "direction", "bias")).alias("_model"), F.first("centre").alias("centre"))
        scored = rows.select("id", "vector").join(F.broadcast(one)).withColumn("_x", centred)  # one row
        size = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, x: s + x * x))

        def score(m):
            return F.round(F.aggregate(F.zip_with("_x", m["direction"], lambda x, d: x * d), F.lit(0.0), lambda s, x: s + x) / F.greatest("_size", F.lit(1e-12)) + m["bias"], 9)

        best = F.slice(F.array_sort(F.transform("_model", lambda m: F.struct((-score(m)).alias("s"), m["label"].alias("label")))), 1, 2)
        top = scored.withColumn("_size", size).select("id", best.alias("b"))
        return top.select("id", F.col("b")[0]["label"].alias("predicted"), (F.element_at("b", -1)["s"] - F.col("b")[0]["s"]).alias("margin"))
    scored = rows.select("id", "vector").crossJoin(model).withColumn("_x", centred)  # labels are a stated set against all rows
    size = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, x: s + x * x))
    score = F.round(F.aggregate(F.zip_with("_x", "direction", lambda x, d: x * d), F.lit(0.0), lambda s, x: s + x) / F.greatest(size, F.lit(1e-12)) + F.col("bias"), 9)
    ranked = scored.select("id", "label", score.alias("score")).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "label"))).filter("n <= 2")
    return ranked.groupBy("id").agg(F.max(F.when(F.col("n") == 1, F.col("label"))).alias("predicted"), (F.max("score") - F.min("score")).alias("margin"))


def normal_equations(train: DataFrame, n_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'Y with a leading 1 in X; partitions send one matrix each, summed in the cluster. label: 0 to n_labels - 1."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = None
        for rows in batches:
            if rows.empty:
                continue
            x = np.stack([np.asarray(v, np.float64) for v in rows["vector"]])
            x = np.concatenate([np.ones((len(x), 1)), x], 1)
            y = -np.ones((len(x), n_labels))
            y[np.arange(len(x)), rows["label"].to_numpy(np.int64)] = 1
            own = np.concatenate([x.T @ x, x.T @ y], 1)
            gram = own if gram is None else gram + own
        if gram is not None:
            yield pd.DataFrame({"row": np.repeat(np.arange(gram.shape[0]), gram.shape[1]), "col": np.tile(np.arange(gram.shape[1]), gram.shape[0]), "v": gram.ravel()})

    cells = train.select("vector", "label").mapInPandas(partial, "row int, col int, v double").groupBy("row", "col").agg(F.sum("v").alias("v")).toPandas()
    d = int(cells["row"].max()) + 1
    full = np.zeros((d, d + n_labels))
    full[cells["row"], cells["col"]] = cells["v"]
    return full[:, :d], full[:, d:]


def ridge(train: DataFrame, n_labels: int, penalty: float = 1.0) -> np.ndarray:
    """One-against-rest ridge weights with an intercept that isn't penalised: (1 + d) x labels."""
    gram, target = normal_equations(train, n_labels)
    keep = np.eye(len(gram)) * penalty
    keep[0, 0] = 0
    return np.linalg.solve(gram + keep, target)


def linear_predict(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """id, predicted (the label with the highest score) and margin."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if part.empty:
                continue
            x = np.stack([np.asarray(v, np.float64) for v in part["vector"]])
            s = shared.value[0] + x @ shared.value[1:]
            top = np.sort(s, 1)
            yield pd.DataFrame({"id": part["id"], "predicted": s.argmax(1), "margin": top[:, -1] - top[:, -2]})

    return rows.select("id", "vector").mapInPandas(predict, "id long, predicted long, margin double")


#: Terms whose document counts are broadcast at most, some 60 bytes each.
BROADCAST_TERMS = 500_000


def tf_idf(terms: DataFrame, least_df: int = 2) -> DataFrame:
    """id, term, weight: (1 + ln tf) (ln((1 + n) / (1 + df)) + 1), unit length per id. ``terms``: id, term, one row per use.

    Uses are folded to (id, term, tf) once and stored; document counts come from that, and are broadcast up to a counted size.
    """
    tf = stored(terms.groupBy("id", "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf")), "term-counts")
    df = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least_df), "document-counts")
    n = tf.select("id").distinct().agg(F.count(F.lit(1)).alias("n"))
    known = F.broadcast(df) if df.count() <= BROADCAST_TERMS else df
    w = tf.join(known, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    return w.select("id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))).alias("weight"))
