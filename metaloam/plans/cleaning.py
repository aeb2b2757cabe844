"""Queries of cleaning, labels, audits and identifiers, on documents, orders, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.functions import measure as M
from metaloam.functions import parse as P
from metaloam.functions import text as X
from metaloam.operators import cleaning as C
from metaloam.registry import query, table

_WORDS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


@query("""SELECT p_partkey, CASE WHEN a = b THEN 'same' WHEN list_sort(a) = list_sort(b) THEN 'reordered' WHEN list_sort(list_distinct(a)) = list_sort(list_distinct(b)) THEN 'same_set'
WHEN CASE WHEN greatest(length(x), length(y)) > 0 THEN 1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE ELSE 1 END >= 0.8 THEN 'near_spelling'
WHEN len(list_intersect(a, b)) > 0 THEN 'shares_a_word' ELSE 'different' END AS kind
FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS a, regexp_extract_all(lower(q), '[a-z0-9]+') AS b, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') AS x, array_to_string(regexp_extract_all(lower(q), '[a-z0-9]+'), ' ') AS y
FROM (SELECT p_partkey, p_name, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN array_to_string(list_reverse(string_split(p_name, ' ')), '-') WHEN 2 THEN p_name || ' ' || p_name WHEN 3 THEN p_name || 's' ELSE p_brand || ' ' || p_type END AS q FROM part))""")
def variant_kinds(spark, sf_dir):
    n = F.col("p_name")
    k = F.col("p_partkey") % 5
    other = F.when(k == 0, F.upper(n)).when(k == 1, F.array_join(F.reverse(F.split(n, " ")), "-")).when(k == 2, F.concat(n, F.lit(" "), n)).when(k == 3, F.concat(n, F.lit("s"))).otherwise(F.concat("p_brand", F.lit(" "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.variant_kind(n, other).alias("kind"))


@query(r"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)*'), lambda t: length(t) > 1 AND t NOT IN ('the', 'of')))::INT AS n_terms,
length(trim(regexp_replace(lower(text), '[^a-z0-9_\s]', '', 'g')))::INT AS n_plain, length(regexp_replace(text, '[0-9]', '', 'g'))::INT AS n_alpha,
length(array_to_string(list_filter(string_split(text, ' '), lambda t: NOT regexp_matches(t, '[0-9]')), ' '))::INT AS n_undigited,
trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+|www\.\S+', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[^A-Za-z0-9\s]', ' ', 'g')), '\s+', ' ', 'g'))[1:40] AS head
FROM documents WHERE text IS NOT NULL""")
def text_forms(spark, sf_dir):
    t = F.col("text")
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.size(X.hyphenated_tokens(t, ("the", "of"))).alias("n_terms"), F.char_length(X.without_punctuation(t)).alias("n_plain"), F.char_length(X.without_digits(t)).alias("n_alpha"), F.char_length(X.without_digit_tokens(t)).alias("n_undigited"), F.substring(X.without_markup(t), 1, 40).alias("head"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t WHERE len(w) > 1)
SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 5""")
def bigram_counts(spark, sf_dir):
    # a column of its own: inside the expression of the n-grams the text would be split once for each of them
    words = table(spark, sf_dir, "documents").select(X.tokens(F.col("text")).alias("w"))
    grams = words.select(F.explode(X.token_ngrams(F.col("w"), 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("""SELECT p_type, kind, count(*) AS n FROM (SELECT p_type, CASE WHEN contains(' ' || array_to_string(b, ' ') || ' ', ' ' || array_to_string(a, ' ') || ' ') THEN 'full' WHEN len(list_intersect(a, b)) > 0 THEN 'any' ELSE 'none' END AS kind
FROM (SELECT p_type, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS a, regexp_extract_all(lower(CASE p_partkey % 3 WHEN 0 THEN 'a ' || p_name || ', new' WHEN 1 THEN string_split(p_name, ' ')[1] || ' only' ELSE p_brand END), '[a-z0-9]+') AS b FROM part)) GROUP BY ALL""")
def phrase_matches(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("a "), n, F.lit(", new"))).when(k == 1, F.concat(F.split(n, " ")[0], F.lit(" only"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").groupBy("p_type", X.phrase_match(n, text).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_NOTE = "'see doi:10.1000/' || o_orderkey || '. (PMID: ' || o_custkey || ', PMC' || o_orderkey || ') BioProject: ' || o_custkey || ' and PRJNA' || o_orderkey"


def _note():
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    return F.concat(F.lit("see doi:10.1000/"), o, F.lit(". (PMID: "), c, F.lit(", PMC"), o, F.lit(") BioProject: "), c, F.lit(" and PRJNA"), o)


@query("SELECT o_orderkey, 'doi:10.1000/' || o_orderkey AS doi, o_custkey::VARCHAR AS pmid, o_orderkey::VARCHAR AS pmcid, CASE WHEN o_orderkey = o_custkey THEN 'PRJNA' || o_orderkey ELSE 'PRJNA' || o_orderkey || ';PRJNA' || o_custkey END AS projects FROM orders")
def identifiers(spark, sf_dir):
    n = _note()
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(X.dois(n), ";").alias("doi"), F.array_join(X.literature_ids(n, "pmid"), ";").alias("pmid"), F.array_join(X.literature_ids(n, "pmcid"), ";").alias("pmcid"), F.array_join(X.project_ids(n), ";").alias("projects"))


@query("""SELECT c_custkey, 'i will not say it is ' || c_custkey || ' or we can not' AS said, contains(c_mktsegment, 'U') AS has_u, lower(trim(coalesce(c_name, ''))) AS name, c_custkey % 10 = 3 AS has_three,
array_to_string(list_transform(string_split('red and blue ' || c_name, ' '), lambda t: CASE t WHEN 'red' THEN 'blue' WHEN 'blue' THEN 'red' ELSE t END), ' ') AS swapped FROM customer""")
def small_text_rules(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    pairs = (("red", "blue"),)
    text = F.concat(F.lit("red and blue "), "c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        X.expanded(X.plain_quotes(F.concat(F.lit("I won’t say it's "), k, F.lit(" or we can't")))).alias("said"),
        F.contains("c_mktsegment", F.lit("U")).alias("has_u"),
        X.folded(F.col("c_name")).alias("name"),
        X.has_number(F.lit("3"), F.concat(F.lit("13, 3.5 and "), (F.col("c_custkey") % 10).cast("string"))).alias("has_three"),
        X.swapped_words(text, pairs).alias("swapped"),
    )


@query("""WITH t AS (SELECT p_partkey, p_name AS l, p_brand || '; ' || p_type AS s, CASE WHEN p_partkey % 2 = 0 THEN 'size ' || p_size ELSE '' END AS d, p_type AS p FROM part)
SELECT p_partkey, kind, value FROM (SELECT p_partkey, unnest(['label', 'label_synonyms', 'label_definition', 'label_parents', 'label_synonyms_definition', 'all']) AS kind,
unnest([l, concat_ws(' | ', l, s), concat_ws(' | ', l, nullif(d, '')), concat_ws(' | ', l, p), concat_ws(' | ', l, s, nullif(d, '')), concat_ws(' | ', l, s, nullif(d, ''), p)]) AS value FROM t)""")
def term_text_variants(spark, sf_dir):
    d = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("size "), "p_size")).otherwise("")
    texts = X.term_texts(F.col("p_name"), F.array("p_brand", "p_type"), d, F.array("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(texts).alias("kind", "value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'id' || o_orderkey END AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS second FROM orders""")
def line_parts(spark, sf_dir):
    line = F.when(F.col("o_orderkey") % 4 == 0, F.lit("a___b")).otherwise(F.concat(F.lit("> x  id"), "o_orderkey", F.lit("___ "), "o_orderstatus", F.lit(" ___c___d___e")))
    parts = X.part_fields(line)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("second"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'N/A' ELSE event_type END AS kind, user_id::VARCHAR AS who, CASE WHEN event_id % 2 = 0 THEN user_id END AS strict_user, [('GO:' || user_id, 0.25::DOUBLE), (event_type, 0.5::DOUBLE)][1][1] AS first_term, 0.75::DOUBLE AS total,
1000 * (event_id % 900 + 1) + 234 AS big, (event_id % 7)::INT AS seed FROM events""")
def loose_answers(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    said = F.concat(F.lit("answer: {'user': '"), u, F.lit("', \"type\": "), F.when(e % 3 == 0, F.lit("''")).otherwise(F.col("event_type")), F.lit("} end"))
    loose = P.loose_fields(said, ("who", "kind"))
    strict = P.json_fields(F.when(e % 2 == 0, F.concat(F.lit('{"usr": '), u, F.lit(', "t": 1}'))).otherwise('{"t": 1}'), {"user": ("user", "usr"), "t": ("t",)})
    found = P.candidates(F.concat(F.lit("GO:"), u, F.lit(":0.25;"), "event_type", F.lit(":0.5;bad")))
    return table(spark, sf_dir, "events").select(
        "event_id",
        loose["kind"].alias("kind"),
        loose["who"].alias("who"),
        strict["user"].cast("bigint").alias("strict_user"),
        found[0]["term"].alias("first_term"),
        (found[0]["p"] + found[1]["p"]).alias("total"),
        P.grouped_integer(F.concat(F.lit("about "), (e % 900 + 1).cast("string"), F.lit(",234 rows"))).alias("big"),
        P.seed_of(F.concat(F.lit("run_seed-"), (e % 7).cast("string"), F.lit(".tsv"))).alias("seed"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN '(0,100000]' WHEN o_totalprice > 100000 AND o_totalprice <= 300000 THEN '(100000,300000]' ELSE 'else' END AS bin,
round((o_totalprice - lo) / (hi - lo), 9) AS scaled, round(2 + (o_totalprice - lo) / (hi - lo) * 3, 9) AS opacity, quarter FROM
(SELECT *, min(o_totalprice) OVER () AS lo, max(o_totalprice) OVER () AS hi, CASE WHEN o_orderkey <= q1 THEN 1 WHEN o_orderkey <= q2 THEN 2 WHEN o_orderkey <= q3 THEN 3 ELSE 4 END AS quarter FROM orders, (SELECT quantile_cont(o_orderkey, 0.25) AS q1, quantile_cont(o_orderkey, 0.5) AS q2, quantile_cont(o_orderkey, 0.75) AS q3 FROM orders))""")
def scaled_values(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ends = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), *(F.percentile("o_orderkey", F.lit(i / 4)).alias(f"q{i}") for i in (1, 2, 3)))
    x, k = F.col("o_totalprice"), F.col("o_orderkey")
    quarter = F.when(k <= F.col("q1"), 1).when(k <= F.col("q2"), 2).when(k <= F.col("q3"), 3).otherwise(4)
    return o.join(F.broadcast(ends)).select("o_orderkey", P.right_closed_bin(x, (0, 100000, 300000)).alias("bin"), F.round(P.min_max(x, F.col("lo"), F.col("hi")), 9).alias("scaled"), F.round(P.rescaled(x, F.col("lo"), F.col("hi"), 2.0, 5.0), 9).alias("opacity"), quarter.alias("quarter"))  # ends is one row


@query("""SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'inches' WHEN 1 THEN 'mm' WHEN 2 THEN 'mbsl' WHEN 3 THEN 'mbsf' WHEN 4 THEN 'bgs' WHEN 5 THEN 'cm' WHEN 6 THEN 'feet' ELSE 'meters' END AS unit,
round(s_suppkey * CASE s_suppkey % 8 WHEN 0 THEN 0.0254 WHEN 1 THEN 0.001 WHEN 5 THEN 0.01 WHEN 6 THEN 0.3048 ELSE 1 END::DOUBLE, 6) AS metres,
CASE WHEN s_suppkey % 2 = 0 THEN 'marine' WHEN s_suppkey % 3 = 0 THEN 'generic' END AS key_group,
round((s_nationkey + 0.5) * CASE WHEN s_suppkey % 4 IN (1, 2) THEN -1 ELSE 1 END::DOUBLE, 6) AS latitude FROM supplier""")
def depth_and_place(spark, sf_dir):
    k = F.col("s_suppkey")
    text, n = k.cast("string"), F.col("s_nationkey").cast("string")
    said = F.lit(None).cast("string")
    for i, x in enumerate(("in", " mm", " mbsl", "mbsf", " m bgs", "cm", "ft", "m")):
        said = F.when(k % 8 == i, F.concat(text, F.lit(x))).otherwise(said)
    where = F.when(k % 4 == 0, F.concat(n, F.lit(" degrees 30 N"))).when(k % 4 == 1, F.concat(n, F.lit(",5 South latitude, mesured"))).when(k % 4 == 2, F.concat(F.lit("-"), n, F.lit(".5"))).otherwise(F.concat(n, F.lit("°30'00\"E, west-side")))
    where = F.when(k % 4 == 3, F.concat(n, F.lit("°30'00\"E of the Westerwald"))).otherwise(where)
    key = F.when(k % 2 == 0, "sea_depth").when(k % 3 == 0, "depth").otherwise("colour")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", said.alias("said"), where.alias("where"), M.key_group(key, {"marine": ("sea_depth",), "generic": ("depth", "height")}).alias("key_group"))
    unit = M.depth_class(F.col("said"))
    return rows.select("s_suppkey", unit.alias("unit"), F.round(M.depth_to_metres(F.col("said"), unit), 6).alias("metres"), "key_group", F.round(M.dms_to_decimal(F.col("where")), 6).alias("latitude"))


@query("""SELECT DISTINCT (c_custkey % 200 - 100)::DOUBLE AS lat, (c_nationkey * 15 - 180)::DOUBLE AS lon FROM customer WHERE c_custkey % 200 - 100 BETWEEN -90 AND 90 AND c_nationkey * 15 - 180 BETWEEN -180 AND 180 AND c_custkey % 9 <> 0""")
def valid_places(spark, sf_dir):
    c = F.col("c_custkey")
    lat = F.when(c % 9 == 0, "none").otherwise((c % 200 - 100).cast("string")).try_cast("double")
    rows = table(spark, sf_dir, "customer").select(lat.alias("lat"), (F.col("c_nationkey") * 15 - 180).cast("double").alias("lon"))
    return rows.filter(F.col("lat").isNotNull() & M.valid_coordinate(F.col("lat"), F.col("lon"))).distinct()


_STATUS = """l AS (SELECT p_partkey, p_partkey % 7 AS k, p_size, CASE p_partkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'Blank' WHEN 2 THEN p_name WHEN 3 THEN 'soil [envo:' || p_size || ']' WHEN 4 THEN 'x [GO:12]' ELSE 'ENVO_' || p_size END AS value FROM part),
t AS (SELECT DISTINCT 'ENVO_' || p_size AS term, p_size % 5 = 0 AS obsolete FROM part WHERE p_size % 4 <> 0),
s AS (SELECT p_partkey, CASE WHEN k IN (0, 1, 2) THEN '' WHEN k = 4 THEN 'GO_12' ELSE 'ENVO_' || p_size END AS term, CASE WHEN k = 0 THEN 'empty' WHEN k = 1 THEN 'control_value' WHEN k = 2 THEN 'no_code' WHEN k = 4 THEN 'other_ontology' WHEN p_size % 4 = 0 THEN 'not_in_index' WHEN p_size % 5 = 0 THEN 'obsolete' ELSE 'ok' END AS status FROM l)"""


def _labels(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    value = F.when(k == 0, F.lit(" ")).when(k == 1, "Blank").when(k == 2, F.col("p_name")).when(k == 3, F.concat(F.lit("soil [envo:"), size, F.lit("]"))).when(k == 4, "x [GO:12]").otherwise(F.concat(F.lit("ENVO_"), size))
    terms = p.filter("p_size % 4 <> 0").select(F.concat(F.lit("ENVO_"), size).alias("term"), (F.col("p_size") % 5 == 0).alias("obsolete")).distinct()
    return C.label_status(p.select("p_partkey", value.alias("value")), "value", terms, ("ENVO",), ("blank", "mock"))


@query(f"WITH {_STATUS} SELECT p_partkey, term, status FROM s")
def label_statuses(spark, sf_dir):
    return _labels(spark, sf_dir).select("p_partkey", "term", "status")


@query(f"""WITH {_STATUS}, m AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS slot FROM s)
SELECT p_partkey, CASE WHEN slot = 'a' AND term = 'ENVO_3' THEN 'ENVO_7' WHEN term = 'ENVO_3' THEN 'ENVO_1' WHEN term = 'ENVO_6' THEN '' WHEN status = 'ok' THEN term ELSE '' END AS clean FROM m""")
def mapped_labels(spark, sf_dir):
    rows = _labels(spark, sf_dir).withColumn("slot", F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b"))
    mapping = spark.createDataFrame([("a", "ENVO_3", "ENVO_7"), ("*", " ENVO_3", "ENVO_1"), ("*", "ENVO_6", "")], "slot string, from_id string, to_id string")
    return C.mapped_label(rows, "slot", "term", "status", mapping).select("p_partkey", "clean")


@query("""SELECT p_partkey, concat_ws(';', CASE WHEN regexp_matches(t, '(?i)\\bring\\b') THEN 'ring' END, CASE WHEN regexp_matches(t, '(?i)brand 1') THEN 'brand' END) AS hits FROM (SELECT p_partkey, regexp_replace(replace(p_name, ' ', '_') || '.' || replace(p_brand, '#', '.'), '[_.]+', ' ', 'g') AS t FROM part)""".replace("\\\\", "\\"))
def audit_names(spark, sf_dir):
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.replace("p_brand", F.lit("#"), F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(C.audit_hits(text, {"ring": r"(?i)\bring\b", "brand": "(?i)brand 1"}), ";").alias("hits"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'sub-biome: sterile control' WHEN 1 THEN 'keyword: pcr blank' WHEN 2 THEN 'keyword + lab context: negative control' ELSE '' END AS evidence FROM orders""")
def control_marks(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    sub = F.when(k == 0, "sterile control").when(k == 2, "laboratory bench").otherwise("forest soil")
    words = F.when(k == 1, F.array(F.lit("soil"), F.lit("pcr blank"))).when(k.isin(2, 3), F.array(F.lit("negative control"))).otherwise(F.array(F.lit("oak")))
    found = C.control_evidence(sub, words, r"(?i)^(laboratory|sterile)[ -](control|blank)\b", r"(?i)^pcr[ -]blanks?$", r"(?i)^(negative|positive)[ -]controls?$", r"(?i)^(laboratory|sterile)\b", r"(?i)^lab$")
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("evidence"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN 'keep' WHEN o_custkey % 10 = 3 AND o_orderstatus = 'F' THEN 'control' WHEN o_custkey % 10 = 3 THEN 'drop' END AS decision FROM orders""")
def override_rules(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 10).cast("string").alias("study"), F.col("o_orderkey").cast("string").alias("sample"), F.col("o_orderstatus").alias("text"))
    rules = o.filter("o_orderkey % 1000 = 7").select(F.lit(9).alias("rule_order"), F.lit("sample").alias("scope"), F.col("sample").alias("id"), F.lit(None).cast("string").alias("pattern"), F.lit(" Keep").alias("decision"))
    rules = rules.unionByName(spark.createDataFrame([(1, "study", "3", "", "drop"), (2, "study", "3", "^F$", "control"), (3, "study", "4", "", " ")], "rule_order int, scope string, id string, pattern string, decision string"))
    return C.overridden(o, C.checked_overrides(rules), "study", "sample", "text").select("o_orderkey", "decision")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS carried, p_partkey % 2 = 0 AS leaky FROM part""")
def carried_values(spark, sf_dir):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    value = F.when(k < 2, F.concat(size, F.lit(" m"))).otherwise("deep lakes")
    words = F.when(k == 0, F.concat(F.lit("depth "), size)).when(k == 1, F.concat(F.lit("depth 9"), size)).otherwise("a lake")
    told = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("see ENVO:"), size)).otherwise("nothing")
    return table(spark, sf_dir, "part").select("p_partkey", C.carries(value, words).alias("carried"), C.leaks(told, F.concat(F.lit("ENVO_"), size), F.col("p_name")).alias("leaky"))


@query("""SELECT l_orderkey, list(l_shipmode ORDER BY r, l_shipmode)[1:2] AS picked FROM (SELECT l_orderkey, (l_suppkey % 5)::VARCHAR AS l_shipmode, min(CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END) AS r FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY ALL) GROUP BY l_orderkey""")
def priority_values(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_suppkey") % 5).cast("string").alias("v"))
    return C.first_values(rows, "l_orderkey", "l_returnflag", "v", ("R", "A"), 2)


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def equal_conditions(spark, sf_dir):
    return C.matching(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3}).select("c_custkey")


@query("""SELECT unnest(['n_nationkey', 'n_name', 'flag']) AS "column" """)
def changing_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 1")
    return C.differing_columns(n.withColumns({"same": F.lit("x"), "flag": F.when(F.col("n_nationkey") % 2 == 0, "y")}))


@query("""SELECT token, count(*) AS n FROM (SELECT DISTINCT c_name, unnest(list_distinct(regexp_extract_all(c_name || '_' || c_mktsegment, '[A-Za-z0-9]+'))) AS token FROM customer) GROUP BY token HAVING count(*) < (SELECT count(DISTINCT c_name) FROM customer)""")
def telling_name_parts(spark, sf_dir):
    return C.telling_tokens(table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit("_"), "c_mktsegment").alias("file")), "file")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR END AS run, CASE WHEN s_suppkey % 2 = 0 THEN 's' || s_suppkey END AS sample FROM supplier""")
def file_name_fields(spark, sf_dir):
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("run"), "s_nationkey", F.lit("__s"), "s_suppkey", F.lit(".tsv"))).otherwise("other.txt")
    found = P.named_parts(name, r"^run(\d+)__(s\d+)\.tsv$", ("run", "sample"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.try_element_at(found, F.lit("run")).alias("run"), F.try_element_at(found, F.lit("sample")).alias("sample"))


_LINES = """l AS (SELECT o_orderkey AS sample, unnest([1, 2, 3, 4, 5]) AS pos, unnest(['sample_Type=' || o_orderstatus, 'run_id=9', 'env=ENVO:' || (o_custkey % 4), 'note', 'depth=' || CASE WHEN o_custkey % 3 = 0 THEN 'NA' ELSE o_custkey::VARCHAR END]) AS line FROM orders)"""


def _lines(spark, sf_dir):
    c = F.col("o_custkey")
    parts = F.array(F.concat(F.lit("sample_Type="), "o_orderstatus"), F.lit("run_id=9"), F.concat(F.lit("env=ENVO:"), (c % 4).cast("string")), F.lit("note"), F.concat(F.lit("depth="), F.when(c % 3 == 0, "NA").otherwise(c.cast("string"))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), F.posexplode(parts).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


@query(f"""WITH {_LINES} SELECT sample, pos, CASE WHEN line = 'env=ENVO:1' THEN 'env="soil"' ELSE line END AS line FROM l WHERE line NOT LIKE 'run%' AND line <> 'depth=NA'""")
def cleaned_lines(spark, sf_dir):
    return C.clean_lines(_lines(spark, sf_dir), "line", spark.createDataFrame([("ENVO:1", "soil")], "code string, label string"))


@query(f"""WITH {_LINES} SELECT sample, string_agg(CASE pos WHEN 1 THEN 'type: ' || split_part(line, '=', 2) ELSE replace(line, '=', ': ') END, '; ' ORDER BY pos) AS text FROM l WHERE pos IN (1, 3, 5) AND line <> 'depth=NA' GROUP BY sample""")
def record_texts(spark, sf_dir):
    return C.record_text(_lines(spark, sf_dir), "sample", "pos", "line", ("run_id",))


@query("SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0")
def finite_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x, i: F.when(i == 2, float("nan")).otherwise(x.cast("double")))).otherwise(F.col("embedding").cast("array<double>")))
    return C.finite_rows(e, "v").select("vec_id")


@query("""WITH h AS (SELECT p_brand AS study, p_type, regexp_matches(p_name, 'ring') AS ring, regexp_matches(p_name, 'red') AS red FROM part), e AS (SELECT study, p_type, 'ring' AS hit FROM h WHERE ring UNION ALL SELECT study, p_type, 'red' FROM h WHERE red),
m AS (SELECT study, hit, p_type, count(*) AS n FROM e GROUP BY ALL)
SELECT m.study, hit, sum(n)::BIGINT AS n_hit, any_value(s.n) AS n_study, arg_min(p_type, (-n, p_type)) AS modal FROM m JOIN (SELECT study, count(*) AS n FROM h GROUP BY study) s USING (study) GROUP BY m.study, hit""".replace("sum(n)", "sum(m.n)").replace("(-n, p_type)", "row(-m.n, p_type)"))
def review_counts(spark, sf_dir):
    patterns = {"ring": "ring", "red": "red"}
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("study"), "p_type", "p_name", C.audit_hits(F.col("p_name"), patterns).alias("hits"))
    return C.review_table(rows, "study", "hits", "p_type", "p_name", patterns).select("study", "hit", "n_hit", "n_study", "modal")
