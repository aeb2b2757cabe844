"""Queries on hierarchies and graphs, on areas, nations and regions: some areas and nations have two parents."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.operators import graph
from metaloam.operators import hierarchy as H
from metaloam.registry import query, table

_E = """a AS (SELECT DISTINCT c_custkey % 50 AS a FROM customer), e AS (SELECT 's' || a AS child, 'n' || (a % 25) AS parent FROM a UNION SELECT 's' || a, 'n' || ((a * 7 + 1) % 25) FROM a WHERE a % 4 = 0
UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'n' || n_nationkey, 'r' || ((n_regionkey + 1) % 5) FROM nation WHERE n_nationkey % 3 = 0 UNION SELECT 'r' || n_regionkey, 'root' FROM nation)"""
_CLOSURE = f"WITH RECURSIVE {_E}, n AS (SELECT child AS x FROM e UNION SELECT parent FROM e), p(node, ancestor, d) AS (SELECT x, x, 0 FROM n UNION ALL SELECT p.node, e.parent, d + 1 FROM p JOIN e ON p.ancestor = e.child), c AS (SELECT node, ancestor, min(d) AS distance FROM p GROUP BY ALL)"
#: Areas and nations are labels.
_BACK_OFF = (
    _CLOSURE
    + """, l AS (SELECT x AS label FROM n WHERE x[1] IN ('s', 'n')), w AS (SELECT o_custkey % 40 AS sample, 's' || (o_custkey % 50 // 7 * 6 + o_orderkey % 3) AS label, sum(o_totalprice) AS w FROM orders GROUP BY ALL), pr AS (SELECT sample, label, round(w / sum(w) OVER (PARTITION BY sample), 9) AS p FROM w WHERE label IN (SELECT label FROM l)),
below AS (SELECT ancestor AS node, count(*) AS n_below FROM c JOIN l ON c.node = l.label GROUP BY 1), depth AS (SELECT node, count(*) AS depth FROM c WHERE distance > 0 GROUP BY 1), mass AS (SELECT sample, ancestor AS node, sum(p) AS q FROM pr JOIN c ON c.node = pr.label GROUP BY ALL),
top AS (SELECT sample, arg_max(label, row(p, label)) AS label FROM pr GROUP BY sample), tau AS (SELECT unnest([0.3, 0.5, 0.7, 0.95]) AS tau),
own AS (SELECT tau, top.sample, mass.node, q, n_below, depth FROM top JOIN c ON c.node = top.label JOIN mass ON mass.sample = top.sample AND mass.node = c.ancestor JOIN l ON l.label = mass.node JOIN below ON below.node = mass.node JOIN depth ON depth.node = mass.node JOIN tau ON q >= tau - 1e-12),
pick AS (SELECT tau, sample, node FROM own QUALIFY row_number() OVER (PARTITION BY tau, sample ORDER BY n_below, depth DESC, round(q, 9) DESC, node) = 1), picks AS (SELECT tau::DOUBLE AS tau, top.sample, node AS pick FROM top CROSS JOIN tau LEFT JOIN pick USING (tau, sample))"""
)
TAUS = (0.3, 0.5, 0.7, 0.95)


def _edges(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    a = c.select((F.col("c_custkey") % 50).alias("a")).distinct()
    name = lambda kind, k: F.concat(F.lit(kind), k.cast("string"))
    k, r, x = F.col("n_nationkey"), F.col("n_regionkey"), F.col("a")
    parts = [
        a.select(name("s", x).alias("child"), name("n", x % 25).alias("parent")),
        a.filter("a % 4 = 0").select(name("s", x), name("n", (x * 7 + 1) % 25)),
        n.select(name("n", k), name("r", r)),
        n.filter("n_nationkey % 3 = 0").select(name("n", k), name("r", (r + 1) % 5)),
        n.select(name("r", r), F.lit("root")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _picks(spark, sf_dir):
    paths = H.closure(_edges(spark, sf_dir))
    labels = paths.filter("distance = 0 AND substring(node, 1, 1) IN ('s', 'n')").select(F.col("node").alias("label"))
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("sample"), F.concat(F.lit("s"), (F.floor(F.col("o_custkey") % 50 / 7) * 6 + F.col("o_orderkey") % 3).cast("string")).alias("label"), "o_totalprice")
    w = o.groupBy("sample", "label").agg(F.sum("o_totalprice").alias("w"))
    total = w.groupBy("sample").agg(F.sum("w").alias("all"))
    p = w.join(total, "sample").select("sample", "label", F.round(F.col("w") / F.col("all"), 9).alias("p")).join(labels, "label", "left_semi")
    counts = H.label_counts(paths, labels)
    return H.back_off(p, paths, counts, list(TAUS)).select("tau", "sample", "pick"), paths


@query(_CLOSURE + " SELECT node, ancestor, distance FROM c")
def dag_closure(spark, sf_dir):
    return H.closure(_edges(spark, sf_dir))


@query(_BACK_OFF + " SELECT tau, sample, pick FROM picks")
def dag_back_off(spark, sf_dir):
    return _picks(spark, sf_dir)[0]


@query(
    _BACK_OFF
    + """, g AS (SELECT tau, sample, pick, 's' || (sample % 8 * 6) AS gold FROM picks) SELECT tau, g.sample, CASE WHEN pick IS NULL THEN 'abstain' WHEN pick = gold THEN 'exact' WHEN u.node IS NOT NULL THEN 'coarser' WHEN d.node IS NOT NULL THEN 'too_specific' ELSE 'other' END AS outcome
FROM g LEFT JOIN c u ON u.node = gold AND u.ancestor = pick AND u.distance > 0 LEFT JOIN c d ON d.node = pick AND d.ancestor = gold AND d.distance > 0"""
)
def dag_outcomes(spark, sf_dir):
    picks, paths = _picks(spark, sf_dir)
    keyed = picks.select(F.struct("tau", "sample").alias("sample"), "pick")
    gold = keyed.select("sample", F.concat(F.lit("s"), (F.col("sample.sample") % 8 * 6).cast("string")).alias("gold"))
    return H.outcomes(keyed, gold, paths).select("sample.tau", "sample.sample", "outcome")


@query("""WITH s AS (SELECT 'n' || c_nationkey AS label, count(*) AS n FROM customer GROUP BY ALL)
SELECT s.label, CASE WHEN s.n >= 60 THEN s.label WHEN sum(s.n) OVER (PARTITION BY n_regionkey) >= 60 THEN 'r' || n_regionkey ELSE 'all' END AS coarse FROM s JOIN nation ON s.label = 'n' || n_nationkey""")
def coarsen_to_support(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    up = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    edges = up.unionByName(up.select(F.col("parent").alias("child"), F.lit("all").alias("parent")).distinct())
    support = table(spark, sf_dir, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return H.coarsen(support, H.closure(edges), 60)


@query("""WITH p AS (SELECT text, min(doc_id) AS m FROM documents GROUP BY text) SELECT doc_id AS node, m AS component FROM documents JOIN p USING (text) WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)""")
def copy_components(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("print"))
    first = d.groupBy("print").agg(F.min("doc_id").alias("a"))
    return graph.components(d.join(first, "print").select("a", F.col("doc_id").alias("b")))
