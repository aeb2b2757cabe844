"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased (A-Z) and split into words of letters, digits and all non-ASCII characters. A window is ``n``
consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Windows of the documents
are hashed from their words' hashes, looked up in a broadcast hash set of the benchmark's windows, and hits are verified against the
words themselves before the spans are merged.

The set's bytes are measured first. Up to ``broadcast_bytes`` it is broadcast whole; a larger one is cut into blocks of
that size, and the documents are scanned once for each: a scan costs less than a shuffle of every word's position, and
blocks don't grow with the corpus. Only hits, and one narrow row a document, are shuffled.

Defined results: null and empty texts have no words and no hits; items without words have no window; repeated documents
each get a row; repeated items (ties) count by their distinct ids, of any type; an empty benchmark leaves every document
clean. Texts of any length are taken whole. Extra columns are kept by ``remove``, whatever their names, and otherwise
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaloam.llm.common import ascii_lower, stored, table

N = 13
#: Bytes of windows that are broadcast at once, as rows; the driver and each executor hold about twice that.
BROADCAST_BYTES = 48 << 20
#: Fixed value of the contract, on texts whose A-Z aren't lower-cased yet.
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The lower-cased words of a text; an empty array for none."""
    spaced = F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{_OTHER}+")
    return F.filter(spaced, lambda w: w != "")


def benchmark_windows(items: DataFrame, n: int = N) -> DataFrame:
    """Distinct windows: size, words and the ids of the items that have them."""
    own = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    made = own.select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))).alias("words"))
    return made.groupBy("size", "words").agg(F.collect_set("item_id").alias("items"))


def _window_hash(hashes: Column, begin: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(hashes, begin + j) for j in range(size)))


def hits(docs: DataFrame, items: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs`` (which has the columns _row and text): _row, n_words, spans (begin and end, merged, from 0), items.

    Rows of one _row must have one text. A word is hashed once. Its array of hashes is exploded with positions, and each
    window's hash comes from the array in generated code, so words and hashes are copied for hits alone.
    """
    kind = items.schema["item_id"].dataType
    windows = stored(benchmark_windows(items, n), "windows")
    row_bytes = 64 + F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + 16 + F.octet_length(w)) + 8 * F.size("items") + F.aggregate("items", F.lit(0).cast("long"), lambda acc, i: acc + F.octet_length(i.cast("string")))
    told = windows.groupBy("size").agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("bytes")).collect()  # n rows at most
    sizes = sorted(r["size"] for r in told)
    blocks = max(1, min(sum(r["n"] for r in told), -(-sum(r["bytes"] for r in told) // broadcast_bytes)))
    word_hashes = F.transform("w", lambda x: F.xxhash64(x))
    known = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(0).alias("size"), F.array().cast("array<string>").alias("known_words"), F.array().cast(T.ArrayType(kind)).alias("items"))
    for size in sizes:
        own = windows.filter(F.col("size") == size).select("size", F.col("words").alias("w"), "items").withColumn("hs", word_hashes)
        known = known.unionByName(own.select(_window_hash(F.col("hs"), F.lit(0), size).alias("h"), "size", F.col("w").alias("known_words"), "items"))
    own = docs.select("_row", words(F.col("text")).alias("w")).withColumn("hs", word_hashes)
    # position 0 has key 0, which each document meets once, in the first block: so documents without hits come along.
    # outer: else the optimiser computes the hashes once more, for a filter
    own = own.withColumn("from", F.concat(F.array(F.lit(0).cast("long")), "hs")).select("_row", "w", "hs", F.posexplode_outer("from").alias("pos", "_"))
    begin = F.col("pos") - 1
    keys = [F.when(F.col("pos") == 0, F.lit(0) if i == 0 else None).when(begin + size <= F.size("hs"), _window_hash(F.col("hs"), begin, size)) for i, size in enumerate(sizes)] or [F.when(F.col("pos") == 0, F.lit(0))]
    key = keys[0] if len(keys) == 1 else F.explode_outer(F.array(*keys))
    looked = own.select("_row", "w", begin.alias("at"), key.cast("long").alias("h") if len(keys) == 1 else key.alias("h"))
    # a hash is taken for a hit only where the words are the same
    same = F.when(F.col("size") == 0, F.col("at") == -1).otherwise((F.col("at") >= 0) & (F.slice("w", F.greatest("at", F.lit(0)) + 1, F.col("size")) == F.col("known_words")))
    span = F.struct(F.col("at").cast("long").alias("begin"), (F.col("at") + F.col("size")).cast("long").alias("end"))

    def met_in(block: int) -> DataFrame:
        part = known if blocks == 1 else known.filter(F.pmod(F.col("h"), F.lit(blocks)) == block)
        met = looked.join(F.broadcast(part), "h").filter(same)
        return met.select("_row", F.size("w").cast("long").alias("n_words"), F.when(F.col("size") > 0, span).alias("span"), F.when(F.col("size") > 0, F.col("items")).alias("items"))

    met = met_in(0)
    for block in range(1, blocks):
        met = met.unionByName(met_in(block))
    grouped = met.groupBy("_row").agg(F.first("n_words").alias("n_words"), F.sort_array(F.collect_set("span")).alias("raw"), F.flatten(F.collect_set("items")).alias("items"))

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last.isNotNull() & (s["begin"] <= last["end"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return grouped.select("_row", "n_words", F.aggregate("raw", none, merge).alias("spans"), F.array_distinct("items").alias("items"))


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])


def contaminated(hit: Column, n_words: Column) -> Column:
    """At least one word in twenty is hit."""
    return (hit > 0) & (20 * hit >= n_words)


def remove(docs: DataFrame, items: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, and without the hit spans in all others; same columns.

    A span goes with the characters between its words and after each of them. Hits are found and joined by a digest of the
    text, so nothing depends on the order of rows, and copies share them. They are broadcast up to ``broadcast_bytes``, so no
    text is moved; beyond, the join is shuffled.
    """
    digest = F.md5(F.col("text").cast("binary"))
    found = hits(docs.select(digest.alias("_row"), "text"), items, n, broadcast_bytes).withColumn("_hit", n_hit(F.col("spans"))).filter("_hit > 0 AND _row IS NOT NULL")
    found = stored(found.select(F.col("_row").alias("_key"), "_hit", "n_words", "spans"), "hits")
    rows = docs.select(F.struct(*docs.columns).alias("_all"), digest.alias("_key"))
    moved = found.agg(F.sum(100 + 16 * F.size("spans"))).first()[0] or 0
    joined = rows.join(F.broadcast(found) if moved <= broadcast_bytes else found, "_key", "left")
    kept = joined.filter(F.col("_hit").isNull() | ~contaminated(F.col("_hit"), F.col("n_words")))
    pieces = F.regexp_extract_all(F.col("_all.text"), F.lit(f"({_WORD}+{_OTHER}*)"), F.lit(1))
    head = F.regexp_extract(F.col("_all.text"), f"^({_OTHER}*)", 1)
    left = F.filter(F.transform(pieces, lambda p, i: F.when(~F.exists("spans", lambda s: (s["begin"] <= i) & (i < s["end"])), p)), lambda p: p.isNotNull())
    text = F.when(F.col("_hit").isNull(), F.col("_all.text")).otherwise(F.concat(head, F.array_join(left, "")))
    return kept.select(*(text.alias(c) if c == "text" else F.col("_all")[c].alias(c) for c in docs.columns))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.struct("doc_id", F.monotonically_increasing_id().alias("n")).alias("_row"), "text")
    out = hits(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).withColumn("n_hit", n_hit(F.col("spans")))
    ids = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), items AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), known AS (
    SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
        SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM (SELECT item_id, w, least(13, len(w)) AS size FROM items WHERE len(w) > 0))
), looked AS (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT DISTINCT size FROM known) WHERE len(w) >= size)
), met AS (
    SELECT doc_id, looked.size, i, item_id FROM looked JOIN known USING (size, win)
), per_hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM met) GROUP BY doc_id
), per_item AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN per_hit USING (doc_id) LEFT JOIN per_item USING (doc_id)"""
