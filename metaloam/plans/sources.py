"""Queries that write files of the formats and read them back, and of text functions and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.functions import text as X
from metaloam.functions import vectors as V
from metaloam.operators import clusters as C
from metaloam.operators import ordering as O  # noqa: E741
from metaloam.operators import tables as T
from metaloam.operators.shared import shared_folder
from metaloam.plans import neighbours as P
from metaloam.registry import query, table
from metaloam.sources import records as S
from metaloam.sources import sinks


def _file(df, line) -> str:
    """The lines as text files in the shared folder."""
    to = shared_folder(df.sparkSession, "files")
    df.select(line.alias("value")).write.text(to)
    return to


@query("""SELECT 'S' || o_orderkey AS sample_id, unnest([0, 1, 2, 3]) AS pos, unnest(['status', 'price', 'note', 'a']) AS key, unnest([o_orderstatus, o_custkey::VARCHAR, NULL, 'b=c']) AS value FROM orders WHERE o_orderkey % 5 <> 0""")
def record_files(spark, sf_dir):
    k = F.col("o_orderkey")
    record = F.concat(F.lit(">"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("S"), k.cast("string"))), F.lit("\nstatus="), "o_orderstatus", F.lit("\nprice = "), F.col("o_custkey").cast("string"), F.lit("\nnote\na=b=c\n"))
    return S.read_records(spark, _file(table(spark, sf_dir, "orders"), record))


@query("""SELECT 'S' || o_orderkey AS sample_id, 'type=' || o_orderstatus || '; env=' || (o_custkey % 4) AS text FROM orders""")
def record_file_texts(spark, sf_dir):
    k = F.col("o_orderkey")
    env = (F.col("o_custkey") % 4).cast("string")
    record = F.concat(F.lit(">S"), k.cast("string"), F.lit("\nsample_Type="), "o_orderstatus", F.lit("\nrun_id=9\nenv="), env, F.lit("\ndepth=NA\nenv="), env, F.lit("\n"))
    return S.record_text(S.read_records(spark, _file(table(spark, sf_dir, "orders"), record)))


@query("SELECT 's' || p_partkey AS sample_id, p_name AS text FROM part WHERE p_partkey % 4 = 0")
def pair_files(spark, sf_dir):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, F.concat(F.lit("\t "), "p_name", F.lit(" "))).when(k % 4 == 1, "\tNA").when(k % 4 == 2, "\ta\tb").otherwise("")
    return S.read_pairs(spark, _file(table(spark, sf_dir, "part"), F.concat(F.lit("s"), k.cast("string"), tail)))


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_name END AS n_name FROM nation")
def string_tables(spark, sf_dir):
    to = shared_folder(spark, "tables")
    table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("n_name")).coalesce(1).write.csv(to, sep="\t", header=True)
    return S.read_strings(spark, to)


@query("""SELECT 'env' AS ontology, 'ENV:' || n_nationkey AS term_id, n_name AS label, 'same;' || n_regionkey AS synonyms, CASE WHEN n_nationkey % 2 = 0 THEN 'area ' || n_nationkey END AS definition, 'ENV:r' || n_regionkey AS parents, n_nationkey % 7 = 0 AS obsolete FROM nation""")
def term_files(spark, sf_dir):
    k, r = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    stanza = F.concat(F.lit("[Term]\nid: ENV:"), k.cast("string"), F.lit("\nname: "), "n_name", F.when(k % 2 == 0, F.concat(F.lit('\ndef: "area '), k.cast("string"), F.lit('" [x]'))).otherwise(""), F.lit('\nsynonym: "same" EXACT []\nsynonym: "'), r, F.lit('" RELATED []\nis_a: ENV:r'), r, F.lit(" ! region\n"), F.when(k % 7 == 0, "is_obsolete: true\n").otherwise(""))
    terms = S.read_terms(spark, _file(table(spark, sf_dir, "nation"), stanza), "ENV")
    return terms.withColumns({c: F.array_join(c, ";") for c in ("synonyms", "parents")})


@query("SELECT 'v' || vec_id AS sample_id, len(embedding)::INT AS size, round(embedding[1]::DOUBLE, 5) AS head, 'sub ' || label AS sub_biome FROM embeddings")
def vector_maps(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").coalesce(1)
    entry = F.concat(F.lit('"v'), F.col("vec_id").cast("string"), F.lit('": '), F.to_json(F.struct(F.col("embedding"), F.concat(F.lit("sub "), F.col("label").cast("string")).alias("sub-biome"))), F.lit(","))
    found = S.read_json_vectors(spark, _file(e, entry))
    return found.select("sample_id", F.size("embedding").alias("size"), F.round(F.col("embedding")[0].cast("double"), 5).alias("head"), "sub_biome")


@query("SELECT 'e' || event_id AS sample_id, event_type AS kind, (user_id::VARCHAR) AS who FROM events WHERE event_id % 10 <> 0")
def meta_files(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.lit("no meta here")).otherwise(F.concat(F.lit("sample e"), F.col("event_id").cast("string"), F.lit(" , meta "), F.to_json(F.struct("event_type", F.col("user_id").cast("string").alias("who")))))
    return S.read_meta_lines(spark, _file(e, line)).select("sample_id", F.col("meta")["event_type"].alias("kind"), F.col("meta")["who"].alias("who"))


@query("SELECT 'c' || c_custkey AS sample, c_mktsegment AS predicted, true AS good FROM customer WHERE c_custkey % 6 <> 0 UNION ALL SELECT 'c' || c_custkey, NULL, false FROM customer WHERE c_custkey % 6 = 0")
def labelled_files(spark, sf_dir):
    k = F.col("c_custkey")
    line = F.concat(F.lit("c"), k.cast("string"), F.when(k % 6 != 0, F.concat(F.lit(","), "c_mktsegment", F.lit(",more"))).otherwise(""))
    good, bad = S.read_labelled(spark, _file(table(spark, sf_dir, "customer"), line))
    return good.withColumn("good", F.lit(True)).unionByName(bad.select(F.col("value").alias("sample"), F.lit(None).cast("string").alias("predicted"), F.lit(False).alias("good")))


@query("""SELECT 'o' || o_custkey AS sample_id, min(o_custkey % 7)::VARCHAR AS cluster_id FROM orders GROUP BY o_custkey HAVING count(DISTINCT CASE WHEN o_custkey % 11 = 0 THEN o_orderkey ELSE 0 END) = 1""")
def cluster_files(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    to = shared_folder(spark, "clusters")
    own = F.when(F.col("o_custkey") % 11 == 0, F.col("o_orderkey") + 100).otherwise(F.col("o_custkey") % 7)
    rows = o.select(F.concat(F.lit("run"), F.col("o_orderkey").cast("string"), F.lit(".o"), F.col("o_custkey").cast("string")).alias("sid"), own.cast("string").alias("cluster"))
    rows.write.csv(to, sep="\t", header=True)
    return S.read_clusters(spark, to).withColumn("cluster_id", F.when(F.col("cluster_id").cast("int") >= 100, (F.regexp_extract("sample_id", r"(\d+)", 1).cast("int") % 7).cast("string")).otherwise(F.col("cluster_id")))


@query("SELECT c_custkey::VARCHAR AS k, c_name, true AS found FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT (c_custkey + 1000000)::VARCHAR, NULL, false FROM customer WHERE c_custkey % 9 = 1")
def keyed_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"), "c_name")
    to = shared_folder(spark, "lookup")
    sinks.by_suffix(c, "k", to, 1)
    n = F.col("k").cast("long")
    wanted = c.filter(n % 9 == 0).select("k").union(c.filter(n % 9 == 1).select((n + 1_000_000).cast("string")))
    found, missing = sinks.lookup(spark, to, wanted, "k", 1)
    return found.select("k", "c_name", F.lit(True).alias("found")).unionByName(missing.select("k", F.lit(None).cast("string").alias("c_name"), F.lit(False).alias("found")))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'first' ELSE 'second' END AS made FROM part")
def appended_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    to = shared_folder(spark, "append")
    sinks.append_missing(p.filter("k % 2 = 0"), "k", to, lambda d: d.withColumn("made", F.lit("first")))
    return sinks.append_missing(p.union(p), "k", to, lambda d: d.withColumn("made", F.lit("second")))


@query(r"""SELECT p_partkey, replace(lower(p_name), ' ', '_') AS slug, replace(replace(p_name, ' ', '-'), '#', '-') || '-' || substr(p_brand, 7) AS safe, array_to_string(string_split(lower(p_name), ' '), '|') AS words, 'ENVO:' || p_size AS code, 'ENVO' AS prefix, p_name AS label,
p_type || '; ' || p_brand AS term, p_brand AS last, lower(p_type) AS low, p_size * 60 + 5 AS seconds FROM part""")
def text_helpers(spark, sf_dir):
    n, size = F.col("p_name"), F.col("p_size").cast("string")
    label, code, prefix = X.annotated(F.concat(n, F.lit(" [envo:"), size, F.lit("]")))
    pairs = X.key_values(F.concat(F.lit("a="), "p_type", F.lit("; a = "), "p_brand", F.lit(";bare")))
    from metaloam.functions import measure as M

    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.slugify(F.concat(F.lit(" "), n, F.lit("!"))).alias("slug"),
        X.sanitise(F.concat(n, F.lit("#"), F.substring("p_brand", 7, 9))).alias("safe"),
        F.array_join(X.brace_keywords(F.concat(F.lit("{"), F.replace(n, F.lit(" "), F.lit(" , ")), F.lit("}"))), "|").alias("words"),
        code.alias("code"),
        prefix.alias("prefix"),
        label.alias("label"),
        X.term_text(F.col("p_type"), X.split_values(F.concat("p_brand", F.lit("|| ")))).alias("term"),
        F.try_element_at(pairs, F.lit("a")).alias("last"),
        X.normalise_key(F.concat(F.lit("Sample_"), "p_type", F.lit(" (x)"))).alias("low"),
        M.clock_seconds(F.concat(size, F.lit("' 5''"))).cast("int").alias("seconds"),
    )


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a[i] - b[i], 2)))), 4) AS euclidean, round(list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 4) AS manhattan, round((a[1] + b[1]) / 2, 5) AS middle,
round(exp(a[1] - greatest(a[1], a[2])) / (exp(a[1] - greatest(a[1], a[2])) + exp(a[2] - greatest(a[1], a[2]))), 5) AS share FROM (SELECT x.vec_id, x.embedding::DOUBLE[] AS a, y.embedding::DOUBLE[] AS b FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1)""")
def vector_distances(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    a, b = F.col("a"), F.col("b")
    return both.select("vec_id", F.round(V.euclidean(a, b), 4).alias("euclidean"), F.round(V.manhattan(a, b), 4).alias("manhattan"), F.round(V.average(a, b)[0], 5).alias("middle"), F.round(V.softmax(F.slice(a, 1, 2))[0], 5).alias("share"))


@query("""SELECT o_orderkey, CASE WHEN i <= ceil(n / 3) THEN 'beginning' WHEN i <= ceil(2 * n / 3) THEN 'middle' ELSE 'end' END AS position, r FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey)::DOUBLE AS n,
rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / 2.0::DOUBLE AS r FROM orders)""")
def positions_and_ranks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return O.thirds(o, ["o_custkey"], "o_orderkey").withColumn("r", O.average_ranks(o, ["o_custkey"], "o_orderpriority")).select("o_orderkey", "position", "r")


@query("SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderstatus) AS s FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY 1")
def last_table_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("s")).distinct()
    return T.latest_per_key([o.filter(F.col("s") == x) for x in "FOP"], "k")


@query("SELECT c_custkey, 'made ' || c_nationkey AS made FROM customer")
def computed_once(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return T.distinct_apply(c, "c_nationkey", lambda d: d.withColumn("made", F.concat(F.lit("made "), F.col("c_nationkey").cast("string")))).select("c_custkey", "made")


@query("""WITH n AS (SELECT p_brand AS a, p_type AS b, count(*)::DOUBLE AS n FROM part GROUP BY ALL), t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS c, -sum(n / (SELECT sum(n) FROM n) * ln(n / (SELECT sum(n) FROM n))) AS h FROM n),
x AS (SELECT sum(m * (m - 1) / 2) AS p, -sum(m / (SELECT sum(n) FROM n) * ln(m / (SELECT sum(n) FROM n))) AS h FROM (SELECT sum(n) AS m FROM n GROUP BY a)), y AS (SELECT sum(m * (m - 1) / 2) AS p, -sum(m / (SELECT sum(n) FROM n) * ln(m / (SELECT sum(n) FROM n))) AS h FROM (SELECT sum(n) AS m FROM n GROUP BY b))
SELECT round((t.c - x.p * y.p / (t.n * (t.n - 1) / 2)) / ((x.p + y.p) / 2 - x.p * y.p / (t.n * (t.n - 1) / 2)), 6) AS ari, round(2 * (x.h + y.h - t.h) / (x.h + y.h), 6) AS nmi FROM t, x, y""")
def partition_indices(spark, sf_dir):
    out = C.agreement_indices(table(spark, sf_dir, "part"), "p_brand", "p_type")
    return out.withColumns({c: F.round(c, 6) for c in out.columns})


@query(P._ALL + ", e AS (SELECT least(query_id, item_id) AS a, greatest(query_id, item_id) AS b, max(sim) AS sim FROM found GROUP BY ALL) SELECT a, b, round(sim, 6) AS sim FROM e")
def neighbour_graph(spark, sf_dir):
    return C.knn_graph(P._found(spark, sf_dir)[1]).withColumn("sim", F.round("sim", 6))


@query("WITH n AS (SELECT p_brand, p_type, count(*) AS m FROM part GROUP BY ALL) SELECT p_brand, sum(m)::BIGINT AS n, arg_min(p_type, row(-m, p_type)) AS label, round(max(m) / sum(m)::DOUBLE, 6) AS share FROM n GROUP BY 1")
def cluster_summary(spark, sf_dir):
    return C.cluster_summary(table(spark, sf_dir, "part"), "p_brand", "p_type").withColumn("share", F.round("share", 6))


_TERMS = "t AS (SELECT p_type AS cluster, p_partkey AS id, unnest(string_split(p_name, ' ')) AS term FROM part)"


def _terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("cluster"), F.col("p_partkey").alias("id"), F.explode(F.split("p_name", " ")).alias("term"))


@query(f"WITH {_TERMS}, n AS (SELECT cluster, term, count(DISTINCT id) AS n FROM t GROUP BY ALL), s AS (SELECT cluster, count(DISTINCT id) AS size FROM t GROUP BY 1), k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) <= 3) SELECT cluster, string_agg(term || ' (' || n || ', ' || printf('%.1f', 100 * n / size::DOUBLE) || '%)', '; ' ORDER BY n DESC, term) AS terms FROM k JOIN s USING (cluster) GROUP BY cluster")
def cluster_terms(spark, sf_dir):
    return C.term_counts(_terms(spark, sf_dir))


@query(f"WITH {_TERMS}, n AS (SELECT cluster, term, count(*) AS n FROM t GROUP BY ALL), f AS (SELECT term FROM n GROUP BY term HAVING count(*) <= 6) SELECT cluster, term, n FROM n WHERE term IN (SELECT term FROM f) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) <= 4")
def telling_terms(spark, sf_dir):
    return C.telling_terms(_terms(spark, sf_dir), 6, 4)
