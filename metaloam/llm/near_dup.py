"""Near-duplicate detection: ProbMinHash, banding, verification, and classes of linked documents.

Texts are split into words (A-Z lower-cased, ASCII signs part words) and weighted five-word shingles; a shingle's weight is
how often the text has it. ProbMinHash draws the arrivals of a Poisson process for each shingle, at the rate of its weight,
each landing in a random component; a component keeps the shingle that came first. A shingle's process ends as soon as its
next arrival is later than every component's first one. Two signatures agree in a component with the probability Jaccard
similarity of the weighted sets. A text that has a shingle more than once is sketched again with all weights equal, where
that similarity is the Jaccard similarity of the sets: else a copy with a repeated line would be missed. Texts are linked
where either similarity is at least 0.8. Bands of components are the keys of candidate groups.

Exact copies are folded into one node first. A candidate group is cut into blocks of bounded size. In a block, the common
shingles of all its members come from one product of matrices, and a task gives one link for each member that belongs to
another's class, never the pairs. Classes are the connected components of the links. Groups of several blocks that still
hold several classes are then decided exactly: members outside the group's largest class, block by block, against all
others. So every candidate pair of different classes is verified, whatever a group's size, and rows grow with the members
of groups; where a group of n members keeps k of them outside its largest class, k / BLOCK times n rows are dealt.

Defined results: a text with fewer than five words but not none is one shingle; texts without words are only copies of
equal texts; null texts are in no class but their own; texts of any length are taken whole. Rows with the same doc_id are
one document: all get one class. A row with a null doc_id takes part under a stand-in id of 2**62 or more, from its text.
Of ties (rows of one doc_id) ``keep_one`` keeps the least text. An empty table gives none. Extra columns are kept by
``keep_one``, whatever their names, and otherwise ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloam.llm.common import WordIds, bounded_batches, discard, stored, table
from metaloam.operators.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
COMPONENTS = BANDS * ROWS
#: Members of a block of a candidate group and shingles of all its members, in the mean: what a task holds at once.
BLOCK, BLOCK_SHINGLES = 512, 4_000_000
#: Entries of a matrix of members and shingles that is multiplied at once.
_CHUNK = 4_000_000
#: Nodes whose texts are needed for verification and whose ids are broadcast for that, at most; some 50 bytes each.
BROADCAST_NODES = 500_000

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_hashes = WordIds(lambda w: zlib.crc32(w) << 32 | zlib.crc32(w, 0x5BD1E995))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a whole text, in order, with repeats."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = _mix(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, len(words))):
        out = _mix(out * _GOLDEN + h[j : j + n])
    return out


def signature(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """ProbMinHash: for each component the element of the earliest arrival."""
    first, winner = np.full(COMPONENTS, np.inf), np.zeros(COMPONENTS, np.uint64)
    seed, weight, time, drawn = elements, weights.astype(np.float64), np.zeros(len(elements)), 0
    while len(seed):
        n = int(min(2048, max(1, 6 * COMPONENTS // len(seed))))
        count = (np.arange(drawn, drawn + n, dtype=np.uint64) + np.uint64(1)) * _GOLDEN
        bits = _mix(seed[:, None] ^ _mix(count)[None, :])
        times = time[:, None] + np.cumsum(-np.log1p((bits >> np.uint64(11)) / -float(1 << 53)), axis=1) / weight[:, None]
        place = (_mix(bits + _GOLDEN) % np.uint64(COMPONENTS)).astype(np.int64)
        flat, at = times.ravel(), place.ravel()
        early = np.flatnonzero(flat < first[at])
        early = early[np.lexsort((seed[early // n], flat[early]))]
        ks, lead = np.unique(at[early], return_index=True)
        first[ks], winner[ks] = flat[early[lead]], seed[early[lead] // n]
        on = times[:, -1] < first.max()
        seed, weight, time, drawn = seed[on], weight[on], times[on, -1], drawn + n
    return winner


def sketch(text: str | None) -> list[int]:
    """A key for each band; more for a text with repeated shingles; none for a text without words."""
    all_of = shingles(text)
    if not len(all_of):
        return []
    elements, counts = np.unique(all_of, return_counts=True)
    winners = [signature(elements, counts)]
    if counts.max() > 1:
        winners.append(signature(elements, np.ones(len(elements))))
    out = []
    for won in winners:
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN
        for j in range(ROWS):
            keys = _mix(keys * _GOLDEN + _mix(won).reshape(BANDS, ROWS)[:, j])
        out.append(keys.view(np.int64))
    return np.unique(np.concatenate(out)).tolist()


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of the elements ``a`` with weights ``x`` and ``b`` with ``y``: the sum over common elements i of
    1 / (sum over all j of max(x_j / x_i, y_j / y_i)). With the common ones in order of x / y, the greater term is the first
    one from i on and the second one before.
    """
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(at):
        return 0.0
    x, y, all_x, all_y = x[at].astype(np.float64), y[to].astype(np.float64), float(x.sum()), float(y.sum())
    only_x, only_y = all_x - x.sum(), all_y - y.sum()
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    from_x, before_y = np.cumsum(x[::-1])[::-1], np.cumsum(y) - y
    return float((1 / ((only_x + from_x) / x + (only_y + before_y) / y)).sum())


def products(elements: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """Of each two members the sum over common elements of the products of their values; the diagonal is not meant."""
    m = len(elements)
    out = np.zeros((m, m), np.float64)
    flat, value = np.concatenate(elements), np.concatenate(values)
    member = np.repeat(np.arange(m), [len(e) for e in elements])
    order = np.argsort(flat, kind="stable")
    flat, value, member = flat[order], value[order], member[order]
    begin = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begin, len(flat)))
    column = np.repeat(np.arange(len(sizes)), sizes)
    # elements of few members: pairs of their entries, by the distance of the entries
    often = max(8, m // 8)
    few = (sizes[column] > 1) & (sizes[column] <= often)
    c, v, i = column[few], value[few], member[few]
    for d in range(1, min(often, len(c))):
        same = np.flatnonzero(c[d:] == c[:-d])
        if not len(same):
            break
        out += np.bincount(i[same] * m + i[same + d], v[same] * v[same + d], m * m).reshape(m, m)
    out += out.T
    # elements of many members: columns of a matrix
    many = np.flatnonzero(sizes > often)
    rank = np.full(len(sizes), -1)
    rank[many] = np.arange(len(many))
    own = rank[column] >= 0
    place, v, i = rank[column[own]], value[own], member[own]
    step = max(1, _CHUNK // m)
    for lo in range(0, len(many), step):
        part = slice(*np.searchsorted(place, (lo, lo + step)))
        matrix = np.zeros((m, min(step, len(many) - lo)), np.float32)
        matrix[i[part], place[part] - lo] = v[part]
        out += matrix @ matrix.T
    return out


def verified_classes(elements: list[np.ndarray], counts: list[np.ndarray | None], labels: np.ndarray) -> np.ndarray:
    """For each member the place of one that stands for its class: linked by verified pairs, or of one label before.

    ``counts`` are the weights, None where all are 1. Exact for all pairs of members.
    """
    m = len(elements)
    sizes = np.array([len(e) for e in elements], np.float64)
    common = np.rint(products(elements, [np.ones(len(e)) for e in elements]))
    linked = (common / np.maximum(1, sizes[:, None] + sizes[None, :] - common) >= SIMILARITY) | (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, True)

    def spread(own: np.ndarray) -> np.ndarray:
        while True:
            to = np.where(linked, own[None, :], m).min(1)
            to = to[to]
            if (to == own).all():
                return own
            own = to

    own = spread(np.arange(m))
    weighted = np.array([c is not None for c in counts])
    if not weighted.any() or own.max() == 0:
        return own
    weights = [np.ones(len(e)) if c is None else c.astype(np.float64) for e, c in zip(elements, counts, strict=True)]
    # probability Jaccard is at most the sum of the lesser shares, and that at most the sum of roots of their products
    bound = products(elements, [np.sqrt(w / w.sum()) for w in weights])
    left, right = np.nonzero(np.triu((bound >= SIMILARITY - 1e-3) & (weighted[:, None] | weighted[None, :]) & (own[:, None] != own[None, :]), 1))
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        if own[i] != own[j] and probability_jaccard(elements[i], weights[i], elements[j], weights[j]) >= SIMILARITY:
            lo, hi = sorted((own[i], own[j]))
            own[own == hi] = lo
    return own


def _keyed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([sketch(x) for x in texts])


def _weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for x in texts:
            elements, counts = np.unique(shingles(x), return_counts=True)
            rows.append((elements.tobytes(), counts.astype("<i4").tobytes() if counts.max(initial=1) > 1 else None, len(elements)))
        yield pd.DataFrame(rows, columns=["elements", "counts", "n"])


_WEIGHED = T.StructType([T.StructField("elements", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("n", T.LongType())])


#: Members of blocks as tasks read them.
_PLACED = ("key", "block", "other", "node", "_print", "label", "elements", "counts")


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a block stand together. Per block a link for each member to the one that stands for its class."""
    each = (r for b in batches for r in zip(*(b[c] for c in _PLACED), strict=True))
    for _, group in itertools.groupby(each, key=lambda r: r[:3]):
        part = list({r[3:5]: r for r in group}.values())
        labels = np.array([r[5] for r in part], np.int64)
        if labels.min() == labels.max():
            continue
        elements = [np.frombuffer(r[6], np.uint64) for r in part]
        counts = [None if r[7] is None else np.frombuffer(r[7], np.int32) for r in part]
        stands = verified_classes(elements, counts, labels)
        new = labels[stands] != labels
        if new.any():
            yield pd.DataFrame({"a": labels[stands][new], "b": labels[new]}).drop_duplicates()


def identity(docs: DataFrame) -> Column:
    """The doc_id, or for a null one a stand-in from the text that is greater than ids in use."""
    stand_in = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(1 << 62))
    return F.coalesce(docs["doc_id"].cast("long"), stand_in)


def _distinct_groups(keyed: DataFrame) -> DataFrame:
    """Groups (key, node, _print, n members) of two members at least, those of equal members once."""
    prints = [F.bit_xor(F.xxhash64(F.lit(i), "_print")) for i in range(2)]
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.struct(F.min("node"), F.max("node"), *prints).alias("print"))
    return keyed.join(sizes.filter("n > 1").groupBy("n", "print").agg(F.min("key").alias("key")).select("key", "n"), "key")


def _links(members: DataFrame, weighed: DataFrame) -> DataFrame:
    """Links (a, b) of labels in blocks: ``members`` has node, _print, label and key, block, other, which name a block."""
    placed = members.join(weighed.select("node", "_print", "elements", "counts"), ["node", "_print"]).select(*_PLACED)
    placed = placed.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other")
    return placed.mapInPandas(_block_links, "a long, b long")


def _rest(groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of pairs that are still to be decided in groups of several blocks: members outside the largest class of a
    group, cut into blocks, each against every block of all members.
    """
    now = groups.filter("blocks > 1").join(labels, "node", "left").select("key", "node", "_print", "blocks", F.coalesce("label", "node").alias("label"))
    sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most")).filter("most < all")
    mixed = now.join(largest.select("key", "main", (F.col("all") - F.col("most")).alias("k"), "all"), "key")
    # as many members to a block as before
    mixed = mixed.withColumn("asks", F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col("k") / F.col("all"))).cast("long"))
    blocks = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    asks = F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)
    own, asking = F.pmod(F.xxhash64("_print"), "blocks"), F.pmod(F.xxhash64(F.lit("ask"), "_print"), "asks")
    asked = mixed.select("key", "node", "_print", "label", own.alias("block"), F.explode(asks).alias("other"))
    ask = mixed.filter("label <> main").select("key", "node", "_print", "label", F.explode(blocks).alias("block"), asking.alias("other"))
    return asked.unionByName(ask).distinct()


def classes(docs: DataFrame, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row of ``docs``: doc_id and class_id (the least doc_id of its class)."""
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", identity(docs).alias("_id"), F.md5(F.col("text").cast("binary")).alias("_print"))
    made = stored(rows.select("doc_id", "_id", "_print", F.pandas_udf(_keyed, "array<bigint>")("text").alias("keys")), "sketches")
    # one node for each distinct text, named by its least id; partial aggregation folds copies before they are moved
    nodes = stored(made.filter(F.col("_print").isNotNull()).groupBy("_print").agg(F.min("_id").alias("node"), F.first("keys").alias("keys")), "nodes")
    member = stored(made.select("doc_id", "_id", "_print").join(nodes.select("_print", "node"), "_print", "left").select("doc_id", "_id", F.coalesce("node", "_id").alias("node")), "members")
    # rows of one doc_id with several texts tie their nodes together
    several = member.groupBy("_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("_id", "a")
    linked = stored(member.join(several, "_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct(), "linked")

    # texts of one doc_id may share a node's name: a member of a group is a node and a text
    groups = stored(_distinct_groups(nodes.select("node", "_print", F.explode("keys").alias("key"))), "groups")
    needed = stored(groups.select(F.col("node").alias("_id"), "_print").distinct(), "needed")
    few = needed.count() <= BROADCAST_NODES
    texts = rows.select("_id", "_print", "text").join(F.broadcast(needed) if few else needed, ["_id", "_print"], "left_semi")
    each = texts.select(F.col("_id").alias("node"), "_print", F.pandas_udf(_weighed, _WEIGHED)("text").alias("w")).select("node", "_print", "w.*")
    weighed = stored(each.groupBy("node", "_print").agg(*(F.first(c).alias(c) for c in ("elements", "counts", "n"))), "weighed")

    large = groups.join(weighed.select("node", "_print", F.col("n").alias("own")), ["node", "_print"]).groupBy("key").agg(F.sum("own").alias("all"), F.max("n").alias("n"))
    cuts = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all") / block_shingles)).cast("long")
    sized = stored(groups.join(large.select("key", cuts.alias("blocks")), "key").select("key", "node", "_print", "blocks"), "groups")
    first = sized.select("key", "node", "_print", F.col("node").alias("label"), F.pmod(F.xxhash64("_print"), "blocks").alias("block"), F.lit(0).cast("long").alias("other"))
    found = stored(_links(first, weighed).union(linked), "linked")
    labels = components(found).withColumnRenamed("component", "label")
    rest = stored(_rest(sized, labels), "rest")
    if not rest.isEmpty():
        more = stored(_links(rest, weighed), "linked")
        farther = components(more).toDF("label", "to")
        # a node without a link so far is its own label
        known = labels.unionByName(farther.select(F.col("label").alias("node"), "label").join(labels.select("node"), "node", "left_anti"))
        labels = stored(known.join(farther, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        discard(more)
    discard(made, nodes, linked, groups, needed, weighed, sized, found, rest)
    return member.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id, and of its rows the one with the least text."""
    leads = classes(docs).select(F.col("class_id").alias("_lead")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"), identity(docs).alias("_lead"))
    first = F.row_number().over(Window.partitionBy("_lead").orderBy("_text"))
    return rows.join(leads, "_lead", "left_semi").withColumn("_n", first).filter("_n = 1").select("_row.*")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
