"""Packing of token ids into sequences of a fixed length, by non-negative least squares on the histogram of lengths.

Documents are cut at every ``window`` ids; what is left over is one piece. Lengths are rounded up to slot sizes (every
length up to 64, every fourth up to a quarter of the window, every eighth beyond), so the histogram has a few hundred
entries whatever the corpus. Shallow combinations of two and three slots that fill a window are enumerated, their repeat
counts solved for by non-negative least squares against the histogram, and rounded down; what remains is packed greedily,
largest slot first. The plan is made on the driver from the histogram alone.

Pieces get their places without any large group: each slot's pieces are numbered by prefix sums over hash buckets, and a
piece's number looks up its sequence in the plan (broadcast; its size is bounded by the number of combinations).

Defined results: a null or empty text is a document of the end token alone; texts of any length are cut whole. Repeated
rows are packed each; pieces of one slot (ties) are numbered by ``_piece``. Extra columns of documents are not used, those
of pieces pass through, whatever their names. An empty table gives no pieces. The least squares end early after ``rounds``
columns; what they leave is packed greedily like any remainder, so no piece is lost, and ``plan`` stays whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaloam.llm.common import bounded_batches, stored, table
from metaloam.llm.tokens import encoder

WINDOW = 2048
#: Pieces that one bucket numbers, in the mean.
BUCKET_ROWS = 20_000


def slot_sizes(window: int = WINDOW) -> np.ndarray:
    return np.unique(np.concatenate([np.arange(1, 65), np.arange(64, window // 4 + 1, 4), np.arange(window // 4, window + 1, 8), [window]]).clip(max=window))


def combinations(sizes: np.ndarray, window: int = WINDOW) -> list[tuple[int, ...]]:
    """Slots of the window itself, and of two and three sizes that leave no room for one more size step."""
    out = [(int(window),)]
    fitting = lambda room: int(sizes[np.searchsorted(sizes, room, "right") - 1])
    for a in sizes[sizes >= window // 3][::-1]:
        room = int(window - a)
        if room <= 0:
            continue
        for b in sizes[(sizes <= min(a, room)) & (sizes >= room // 2)][::-1]:
            rest = room - int(b)
            if rest == 0 or fitting(rest) * 8 < window // 64:
                out.append((int(a), int(b)))
            elif fitting(rest) <= b:
                out.append((int(a), int(b), fitting(rest)))
    return list(dict.fromkeys(out))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """min |ax - b| with x >= 0 by an active set; the products of active columns are kept from round to round."""
    n = a.shape[1]
    x, target = np.zeros(n), a.T @ b
    on: list[int] = []
    gram = np.zeros((0, 0))
    tolerance = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(rounds):
        slope = a.T @ (b - a[:, on] @ x[on])
        slope[on] = -np.inf
        j = int(slope.argmax())
        if slope[j] <= tolerance:
            break
        cross = a[:, on].T @ a[:, j]
        gram = np.block([[gram, cross[:, None]], [cross[None, :], np.array([[a[:, j] @ a[:, j]]])]])
        on.append(j)
        while True:
            solved = np.linalg.solve(gram + 1e-9 * np.eye(len(on)), target[on])
            if (solved > 0).all():
                x[on] = solved
                break
            now, bad = x[on], solved <= 0
            step = (now[bad] / np.maximum(now[bad] - solved[bad], 1e-12)).min()
            now = now + step * (solved - now)
            gone = bad & (now <= 1e-9)
            if not gone.any():
                gone[np.flatnonzero(bad)[0]] = True
            x[on] = np.where(gone, 0, now)
            gram = gram[np.ix_(~gone, ~gone)]
            on = [k for k, g in zip(on, gone, strict=True) if not g]
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of slots and how often each is used; every counted piece has exactly one place."""
    left = Counter({int(k): int(v) for k, v in histogram.items() if v > 0})
    sizes = slot_sizes(window)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...], times: int) -> None:
        uses = Counter(parts)
        times = min([times, *(left[s] // m for s, m in uses.items())])
        if times > 0:
            out.append((parts, times))
            left.subtract({s: m * times for s, m in uses.items()})

    take((window,), left[window])
    own = [c for c in combinations(sizes, window) if all(left[s] for s in c)]
    if own:
        row = {int(s): i for i, s in enumerate(sizes)}
        a, b = np.zeros((len(sizes), len(own))), np.array([left[int(s)] for s in sizes], np.float64)
        for j, c in enumerate(own):
            for s in c:
                a[row[s], j] += 1
        times = nnls(a, b)
        for j in np.argsort(-times, kind="stable"):
            take(own[j], int(times[j]))
    while +left:
        room, parts, taken = window, [], Counter()
        for s in sorted((+left), reverse=True):
            m = min(left[s], room // s)
            parts += [s] * m
            room -= m * s
            taken[s] += m
        take(tuple(parts), min(left[s] // m for s, m in taken.items() if m))
    return out


def cut(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit). Every text is encoded once."""
    bounded_batches(docs.sparkSession)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, rows = encoder(tokenizer), np.array([end_id], np.uint32), []
        names = ["doc_id", "start", "length", "doc_tokens", "ids"]

        def made() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

        for batch in batches:
            for doc, own in zip(batch["doc_id"], encode.encode_batch(list(batch["text"])), strict=True):
                ids = np.concatenate([own, end]).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((None if pd.isna(doc) else int(doc), at, len(part), len(ids), part.tobytes()))
                    if len(rows) >= 2000:
                        yield made()
                        rows = []
            if rows:
                yield made()
                rows = []

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pieces, "doc_id long, start long, length long, doc_tokens long, ids binary")


def slot_of(length, window: int = WINDOW):
    """The least slot size that holds a length."""
    return F.when(length <= 64, length).when(length <= window // 4, F.ceil(length / 4) * 4).otherwise(F.least(F.ceil(length / 8) * 8, F.lit(window))).cast("int")


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (with _piece, a unique number, and length) with sequence_id and offset. Reads them twice."""
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c != "_piece"]
    own = pieces.select(F.struct(*names).alias("_own"), "_piece", F.col("length").alias("_length"))
    slotted = own.withColumn("_slot", slot_of(F.col("_length"), window))
    histogram = {r["_slot"]: r["n"] for r in slotted.groupBy("_slot").agg(F.count(F.lit(1)).alias("n")).collect()}
    buckets = 1 + sum(histogram.values()) // BUCKET_ROWS
    intervals: dict[int, list[tuple[int, int, int]]] = {}
    used, sequence = Counter(), 0
    for parts, times in plan(histogram, window):
        for place, s in enumerate(parts):
            intervals.setdefault(s, []).append((used[s], sequence, place))
            used[s] += times
        sequence += times
    shared = spark.sparkContext.broadcast({s: np.array(x, np.int64).T for s, x in intervals.items()})

    def placed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for slots, numbers in batches:
            slot, number = slots.to_numpy(), numbers.to_numpy(np.int64)
            to, place = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
            for s in np.unique(slot):
                own = slot == s
                begins, sequences, places = shared.value[int(s)]
                at = np.searchsorted(begins, number[own], "right") - 1
                to[own] = sequences[at] + number[own] - begins[at]
                place[own] = places[at]
            yield pd.DataFrame({"sequence": to, "place": place})

    salted = slotted.withColumn("_bucket", F.pmod(F.xxhash64("_piece"), F.lit(buckets)).cast("int"))
    sums = salted.groupBy("_slot", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_slot", "_bucket", (F.sum("_n").over(Window.partitionBy("_slot").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_slot", "_bucket").orderBy("_piece"))
    numbered = salted.withColumn("_within", within).join(before, ["_slot", "_bucket"]).withColumn("_number", F.col("_before") + F.col("_within") - 1)
    found = numbered.withColumn("_to", F.pandas_udf(placed, "sequence long, place long")("_slot", "_number"))
    found = found.select("_own", "_length", F.col("_to.sequence").alias("_sequence"), F.col("_to.place").alias("_place"))
    filled = F.sum("_length").over(Window.partitionBy("_sequence").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    placed = {"sequence_id": F.col("_sequence"), "offset": F.coalesce(filled, F.lit(0))}
    return found.select(*(F.col("_own")[c].alias(c) for c in names if c not in placed), *(x.alias(c) for c, x in placed.items()))


def sequences(packed: DataFrame, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Real sequences from packed pieces with ids: sequence_id and ids (32-bit), padded to the window unless a power of two."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n"))

    def padded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for p, n in zip(rows["p"], rows["n"], strict=True):
                ids = b"".join(x["ids"] for x in p)
                out.append(ids if n & (n - 1) == 0 else ids + np.full(window - n, pad_id, "<u4").tobytes())
            yield pd.DataFrame({"sequence_id": rows["sequence_id"], "ids": out})

    return joined.mapInPandas(padded, "sequence_id long, ids binary")


def digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract rows: the packed pieces with the crc32 of their ids."""
    import public_tokenizers

    pieces = cut(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumn("_piece", F.monotonically_increasing_id())
    kept = stored(pieces, "pieces")
    return pack(kept.select("_piece", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
