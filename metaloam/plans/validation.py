"""Queries of validation reports and tests, with order priorities as runs, customers as samples and a price rule as prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from metaloam.functions import tails
from metaloam.operators import agreement, ordering
from metaloam.operators import validation as V
from metaloam.registry import query, table

_R = "r AS (SELECT o_orderkey, o_custkey, o_orderpriority AS run, o_orderstatus AS gold, CASE WHEN o_totalprice > 200000 THEN 'F' WHEN o_totalprice > 100000 THEN 'O' ELSE 'P' END AS said, o_totalprice AS x FROM orders)"


def _erf(x: str) -> str:
    """SQL of the error function of a positive column: a series of positive terms."""
    return f"list_sum(list_transform(range(0, 150), lambda n: exp((2 * n + 1) * ln({x}) - lgamma(n + 1.5) - {x} * {x})))"


def _t_p(t: str, df: str) -> str:
    """SQL of the two-sided tail of Student's t: one minus a series of the incomplete beta function."""
    y = f"({t} * {t} / ({df} + {t} * {t}))"
    terms = f"list_sum(list_transform(range(0, 600), lambda n: exp(lgamma(0.5 + {df} / 2 + n) - lgamma(0.5 + {df} / 2) - lgamma(1.5 + n) + lgamma(1.5) + n * ln({y})) / 0.5))"
    return f"(1 - exp(lgamma(0.5 + {df} / 2) - lgamma(0.5) - lgamma({df} / 2) + 0.5 * ln({y}) + {df} / 2 * ln(1 - {y})) * {terms})"


def _runs(spark, sf_dir):
    x = F.col("o_totalprice")
    said = F.when(x > 200000, "F").when(x > 100000, "O").otherwise("P")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("gold"), said.alias("said"), x.alias("x"))


def _hits(spark, sf_dir):
    r = _runs(spark, sf_dir)
    exact = (F.col("gold") == F.col("said")).cast("int")
    return r.withColumns({"exact": exact, "lenient": F.greatest(exact, (F.col("gold") == "F").cast("int"))})


def _rounded(df, n, *columns):
    return df.withColumns({c: F.round(c, n) for c in columns})


@query(f"""WITH {_R}, h AS (SELECT run, (gold = said)::INT AS e, greatest((gold = said)::INT, (gold = 'F')::INT) AS l FROM r), a AS (SELECT run, sum(e)::BIGINT AS exact_sum, count(e) AS exact_count, round(avg(e) * 100, 2) AS exact_pct, round(round(stddev_samp(e), 2) * 100, 2) AS exact_sd,
sum(l)::BIGINT AS lenient_sum, count(l) AS lenient_count, round(avg(l) * 100, 2) AS lenient_pct, round(round(stddev_samp(l), 2) * 100, 2) AS lenient_sd FROM h GROUP BY run) SELECT *, printf('%.2f', exact_pct) || '%' || chr(10) || '(n=' || exact_count || ')' AS label FROM a""")
def agreement_by_run(spark, sf_dir):
    return V.agreement_by_run(_hits(spark, sf_dir), "run", "exact", "lenient")


_SCORES = f"""WITH {_R}, n AS (SELECT run, gold, said, count(*) AS n FROM r GROUP BY ALL), g AS (SELECT run, gold AS c, sum(n) AS ng, sum(CASE WHEN gold = said THEN n ELSE 0 END) AS tp FROM n GROUP BY ALL), q AS (SELECT run, said AS c, sum(n) AS np FROM n GROUP BY ALL),
b AS (SELECT run, c, coalesce(ng, 0) AS ng, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np FROM g FULL JOIN q USING (run, c)), s AS (SELECT *, CASE WHEN np > 0 THEN tp::DOUBLE / np ELSE 0 END AS p, CASE WHEN ng > 0 THEN tp::DOUBLE / ng ELSE 0 END AS r FROM b),
m AS (SELECT run, round(sum(tp)::DOUBLE / sum(ng), 6) AS accuracy, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM s GROUP BY run)"""


def _scores(spark, sf_dir):
    return _rounded(V.run_scores(_runs(spark, sf_dir), "run", "gold", "said"), 6, "accuracy", "precision", "recall", "f1")


@query(_SCORES + " SELECT * FROM m")
def run_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(_SCORES + " SELECT metric, min(v) AS low, max(v) AS high FROM (SELECT unnest(['accuracy', 'precision', 'recall', 'f1']) AS metric, unnest([accuracy, precision, recall, f1]) AS v FROM m) GROUP BY metric")
def run_score_ranges(spark, sf_dir):
    return V.score_ranges(_scores(spark, sf_dir))


_MCNEMAR = """e AS (SELECT o_custkey AS s, o_orderpriority AS run, max((o_totalprice > 250000)::INT) AS h FROM orders GROUP BY ALL), k AS (SELECT run, count(*) AS n, sum(h) AS s FROM e GROUP BY run),
c AS (SELECT a.run AS run1, b.run AS run2, count(*) AS common, count(*) FILTER (WHERE a.h = 1 AND b.h = 0) AS x, count(*) FILTER (WHERE a.h = 0 AND b.h = 1) AS y FROM e a JOIN e b USING (s) WHERE a.run < b.run GROUP BY ALL),
p AS (SELECT a.run AS run1, b.run AS run2, a.n::DOUBLE AS n1, b.n::DOUBLE AS n2, a.s::DOUBLE AS s1, b.s::DOUBLE AS s2, common, x, y FROM k a JOIN k b ON a.run < b.run JOIN c ON c.run1 = a.run AND c.run2 = b.run)"""


@query(f"""WITH {_MCNEMAR}, d AS (SELECT *, common >= <share> * least(n1, n2) AS mc, pow(abs(x - y) - 1, 2) / (x + y) AS chi,
(s1 / n1 - s2 / n2) / sqrt(((s1 - s1 * s1 / n1) + (s2 - s2 * s2 / n2)) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS t, n1 + n2 - 2 AS df FROM p),
w AS (SELECT *, sqrt(chi / 2) AS z FROM d), v AS (SELECT *, CASE WHEN mc THEN CASE WHEN z > 0 THEN 1 - {_erf('z')} ELSE 1 END ELSE {_t_p('t', 'df')} END AS pv FROM w)
SELECT run1, run2, CASE WHEN mc THEN 'McNemar' ELSE 'Independent T-test' END AS test, round(CASE WHEN mc THEN chi ELSE t END, 2) AS statistic, round(pv, 5) AS p, round(least(1.0, pv * (SELECT count(*) FROM p)), 5) AS adjusted FROM v""".replace("<share>", "0.9"))
def run_pair_tests(spark, sf_dir):
    hit = F.max((F.col("o_totalprice") > 250000).cast("int"))
    e = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(hit.alias("h"))
    return V.run_tests(e, "o_orderpriority", "o_custkey", "h")


_SIMS = "a AS (SELECT o_custkey AS k, avg(o_totalprice) AS x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice) AS y FROM orders WHERE o_orderstatus = 'O' <more> GROUP BY 1), m AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS vx, var_samp(y) AS vy, var_samp(x - y) AS vd FROM a JOIN b USING (k)), s AS (SELECT *, 100 * n / least((SELECT count(*) FROM a), (SELECT count(*) FROM b)) AS overlap FROM m)"


def _sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return (o.filter(F.col("o_orderstatus") == x).select("k", "v") for x in "FO")


@query(f"WITH {_SIMS.replace('<more>', '')}, t AS (SELECT *, (mx - my) / sqrt(vd / n) AS t, n - 1 AS df FROM s) SELECT round(overlap, 4) AS overlap, 'ttest_rel' AS test, round(t, 2) AS statistic, round({_t_p('t', 'df')}, 5) AS p, round(least(1.0, n * {_t_p('t', 'df')}), 5) AS adjusted FROM t")
def paired_similarities(spark, sf_dir):
    return V.similarity_test(*_sides(spark, sf_dir), "k", "v", 0.5)


@query(f"WITH {_SIMS.replace('<more>', '')}, t AS (SELECT *, (mx - my) / sqrt(((n - 1) * vx + (n - 1) * vy) / (2 * n - 2) * 2 / n) AS t, 2 * n - 2 AS df FROM s) SELECT round(overlap, 4) AS overlap, 'ttest_ind' AS test, round(t, 2) AS statistic, round({_t_p('t', 'df')}, 5) AS p, round(least(1.0, n * {_t_p('t', 'df')}), 5) AS adjusted FROM t")
def independent_similarities(spark, sf_dir):
    return V.similarity_test(*_sides(spark, sf_dir), "k", "v", 1.1)


@query(f"""WITH v AS (SELECT round(l_extendedprice, -2) AS v, l_returnflag = 'R' AS a FROM lineitem WHERE l_discount > 0.02), r AS (SELECT a, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0)::DOUBLE AS r FROM v),
t AS (SELECT sum(n::DOUBLE * n * n - n) AS ties FROM (SELECT count(*) AS n FROM v GROUP BY v)), s AS (SELECT sum(r) FILTER (WHERE a) AS ranks, count(*) FILTER (WHERE a)::DOUBLE AS n1, count(*)::DOUBLE AS n FROM r),
u AS (SELECT *, ranks - n1 * (n1 + 1) / 2 AS u, n - n1 AS n2 FROM s, t), z AS (SELECT u, greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) / sqrt(2) AS z FROM u)
SELECT round(u, 2) AS u, round(CASE WHEN z > 0 THEN 1 - {_erf('z')} ELSE 1 END, 3) AS p FROM z""")
def mann_whitney_prices(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_discount > 0.02").select(F.round("l_extendedprice", -2).alias("v"), (F.col("l_returnflag") == "R").alias("a"))
    return V.mann_whitney(rows, "v", "a")


@query(f"""WITH m AS (SELECT o_orderpriority AS g, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, count(*)::DOUBLE AS n FROM orders GROUP BY 1), q AS (SELECT a.g AS a, b.g AS b, (a.m - b.m) / sqrt(a.s * a.s / a.n + b.s * b.s / b.n) AS t,
pow(a.s * a.s / a.n + b.s * b.s / b.n, 2) / (pow(a.s * a.s / a.n, 2) / (a.n - 1) + pow(b.s * b.s / b.n, 2) / (b.n - 1)) AS df FROM m a JOIN m b ON a.g < b.g), p AS (SELECT *, {_t_p('t', 'df')} AS p FROM q),
i AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS k FROM p) SELECT a, b, round(t, 6) AS t, round(p, 6) AS p, i <= coalesce((SELECT max(i) FROM i WHERE p <= i * 0.05 / k), 0) AS rejected FROM i""")
def welch_by_priority(spark, sf_dir):
    """Welch tests of all pairs of order priorities; a row for each pair reaches Python."""
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.stddev_samp("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    a, b = (m.select(*(F.col(c).alias(f"{c[0] if c[0] != 'o' else 'g'}{i}") for c in m.columns)) for i in (1, 2))
    pairs = a.join(b, F.col("g1") < F.col("g2"))  # a row for each priority on each side

    def tested(batches):
        import pandas as pd

        for rows in batches:
            yield pd.DataFrame([(r.g1, r.g2, *map(float, tails.welch(r.m1, r.s1, r.n1, r.m2, r.s2, r.n2))) for r in rows.itertuples()], columns=["a", "b", "t", "df", "p"])

    out = agreement.benjamini_hochberg(pairs.mapInPandas(tested, "a string, b string, t double, df double, p double"), "p")
    return _rounded(out.select("a", "b", "t", "p", "rejected"), 6, "t", "p")


@query(f"WITH {_R}, c AS (SELECT gold, avg((gold = said)::INT) AS a FROM r GROUP BY gold) SELECT round(avg(a), 6) AS macro FROM c")
def macro_accuracy(spark, sf_dir):
    return _rounded(V.macro_accuracy(_hits(spark, sf_dir), "gold", "exact"), 6, "macro")


@query(f"WITH {_R}, c AS (SELECT gold, avg((gold = said)::INT) AS a FROM r GROUP BY gold) SELECT round(sum(a * w) / sum(w), 6) AS mean FROM c JOIN (VALUES ('F', 0.5), ('O', 0.25), ('P', 0.25)) t(gold, w) USING (gold)")
def reweighted_accuracy(spark, sf_dir):
    mix = spark.createDataFrame([("F", 0.5), ("O", 0.25), ("P", 0.25)], "gold string, w double")
    return _rounded(V.mixed_mean(_hits(spark, sf_dir), "gold", "exact", mix), 6, "mean")


@query(f"WITH {_R} SELECT count(*) FILTER (WHERE o_custkey % 10 = 0) AS n_flagged, round(avg((gold = said)::INT) FILTER (WHERE o_custkey % 10 = 0), 6) AS flagged, count(*) FILTER (WHERE o_custkey % 10 <> 0) AS n_other, round(avg((gold = said)::INT) FILTER (WHERE o_custkey % 10 <> 0), 6) AS other FROM r")
def flagged_accuracy(spark, sf_dir):
    return _rounded(V.conditional_means(_hits(spark, sf_dir).withColumn("flag", F.col("o_custkey") % 10 == 0), "flag", "exact"), 6, "flagged", "other")


@query(f"""WITH {_R}, p AS (SELECT gold AS arm, run, avg((gold = said)::INT) AS m FROM r GROUP BY ALL), d AS (SELECT p.arm, p.m, p.m - b.m AS d FROM p LEFT JOIN p b ON b.run = p.run AND b.arm = 'F')
SELECT arm, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, round(min(d), 6) AS least, round(max(d), 6) AS most FROM d GROUP BY arm""")
def arms_against_baseline(spark, sf_dir):
    return _rounded(V.baseline_differences(_hits(spark, sf_dir).withColumnRenamed("gold", "arm"), "arm", "run", "exact", "F"), 6, "mean", "sd", "least", "most")


@query(f"""WITH {_R}, b AS (SELECT *, CASE WHEN p >= 0.9 THEN '>=0.9' WHEN p >= 0.7 THEN '>=0.7' WHEN p >= 0.5 THEN '>=0.5' ELSE '<0.5' END AS band FROM (SELECT *, least(1, x / 400000) AS p FROM r))
SELECT band, count(*) AS n, round(avg((o_orderkey % 4 <> 0)::INT), 6) AS answered, round(avg((gold = said)::INT) FILTER (WHERE o_orderkey % 4 <> 0), 6) AS strict, round(avg((gold = said OR gold = 'F')::INT) FILTER (WHERE o_orderkey % 4 <> 0), 6) AS lenient FROM b GROUP BY band""")
def accuracy_by_band(spark, sf_dir):
    h = _hits(spark, sf_dir).withColumn("band", V.probability_band(F.least(F.lit(1.0), F.col("x") / 400000)))
    answer = F.when(F.col("o_orderkey") % 4 != 0, F.col("said"))
    return _rounded(V.strict_and_lenient(h, "band", answer, F.col("exact"), F.col("lenient")), 6, "answered", "strict", "lenient")


@query("""WITH b AS (SELECT text, lang, count(*) AS n FROM documents GROUP BY ALL), h AS (SELECT sum(n * (n - 1) / 2) AS hit FROM b), s AS (SELECT sum(n * (n - 1) / 2) AS said FROM (SELECT sum(n) AS n FROM b GROUP BY text)), t AS (SELECT sum(n * (n - 1) / 2) AS true FROM (SELECT sum(n) AS n FROM b GROUP BY lang))
SELECT round(hit / said, 9) AS precision, round(hit / true, 9) AS recall, round(2 * hit / (said + true), 9) AS f1 FROM h, s, t""".replace("AS true", "AS tr").replace("hit / true", "hit / tr").replace("said + true", "said + tr"))
def equal_text_partition(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("text"), "lang")
    return _rounded(V.partition_scores(d, "text", "lang"), 9, "precision", "recall", "f1")


@query("SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS clusters FROM part GROUP BY p_name")
def text_cluster_spread(spark, sf_dir):
    return V.text_spread(table(spark, sf_dir, "part"), "p_name", "p_brand")


@query("SELECT p_brand, sum(n)::BIGINT AS n, count(*) AS contexts, round(max(n) / sum(n)::DOUBLE, 6) AS purity FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def nesting_purity(spark, sf_dir):
    return _rounded(V.nesting(table(spark, sf_dir, "part"), "p_brand", "p_type"), 6, "purity")


@query("""WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT p_brand, sum(n)::BIGINT AS n_term, arg_min(p_type, row(-n, p_type)) AS majority FROM n GROUP BY p_brand)
SELECT p_brand, n_term, majority, string_agg(p_type, ';' ORDER BY p_type) AS classes FROM n JOIN t USING (p_brand) WHERE n >= 0.2 * n_term GROUP BY ALL""")
def coarse_classes(spark, sf_dir):
    return V.coarse_map(table(spark, sf_dir, "part"), "p_brand", "p_type").withColumn("classes", F.array_join("classes", ";"))


@query("""WITH n AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL), t AS (SELECT o_custkey, arg_min(s, row(-n, s)) AS top, arg_min(s, row((s = 'P')::INT, -n, s)) AS known FROM n GROUP BY 1) SELECT o_custkey, CASE WHEN top <> 'P' THEN top ELSE known END AS majority FROM t""")
def second_choice(spark, sf_dir):
    return V.second_choice(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "P")


@query(f"WITH {_R}, e AS (SELECT gold, said, count(*) AS n FROM r WHERE gold <> said GROUP BY ALL HAVING count(*) > 2) SELECT gold, said, n, round(n / sum(n) OVER (PARTITION BY gold)::DOUBLE, 6) AS share FROM e")
def error_shares(spark, sf_dir):
    return _rounded(V.error_shares(_runs(spark, sf_dir), "gold", "said"), 6, "share")


@query("""SELECT p_type, kind, count(DISTINCT p_brand) AS samples FROM (SELECT p_type, p_brand, CASE WHEN contains(p_name, 'ring') THEN 'full' WHEN contains(p_name, 'r') THEN 'any' ELSE 'none' END AS kind FROM part) GROUP BY ALL""")
def field_matches(spark, sf_dir):
    n = F.col("p_name")
    kind = F.when(F.contains(n, F.lit("ring")), "full").when(F.contains(n, F.lit("r")), "any").otherwise("none")
    return V.field_matches(table(spark, sf_dir, "part").select("p_type", "p_brand", kind.alias("kind")), "p_brand", "p_type", "kind")


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10")
def top_names(spark, sf_dir):
    return V.top_fields(table(spark, sf_dir, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n")), "p_name", "n", 10)


@query("""WITH l AS (SELECT o_orderstatus, o_custkey, coalesce(list(l_partkey) FILTER (WHERE l_quantity > 25), []) AS ids FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_custkey), a AS (SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE len(ids) > 0) AS with_ids, count(DISTINCT o_custkey) AS samples FROM l GROUP BY 1),
e AS (SELECT o_orderstatus, count(DISTINCT id) AS ids FROM (SELECT o_orderstatus, unnest(ids) AS id FROM l) GROUP BY 1) SELECT o_orderstatus, n, with_ids, samples, coalesce(ids, 0) AS ids FROM a LEFT JOIN e USING (o_orderstatus)""")
def ids_per_class(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_partkey").alias("ids"))
    rows = table(spark, sf_dir, "orders").join(lists, "o_orderkey", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    return V.exploded_counts(rows, "o_orderstatus", "o_custkey", "ids")


@query("SELECT sum(strlen(text))::BIGINT AS before, sum(strlen(regexp_replace(text, '[aeiou]', '', 'g')))::BIGINT AS after, round(100 * (1 - sum(strlen(regexp_replace(text, '[aeiou]', '', 'g'))) / sum(strlen(text))::DOUBLE), 4) AS reduction FROM documents")
def bytes_saved(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text", F.regexp_replace("text", "[aeiou]", "").alias("short"))
    return V.size_reduction(d, "text", "short")


@query("SELECT o_orderstatus, round(avg((o_totalprice > 200000)::INT) FILTER (WHERE o_custkey % 3 = 0), 6) AS recall, round(avg((o_totalprice > 300000)::INT) FILTER (WHERE o_custkey % 3 <> 0), 6) AS invention FROM orders GROUP BY 1")
def recall_and_invention(spark, sf_dir):
    x = F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", (F.col("o_custkey") % 3 == 0).alias("present"), (x > 200000).alias("c"), (x > 300000).alias("m"))
    return _rounded(V.recall_and_invention(rows, "o_orderstatus", "c", "m"), 6, "recall", "invention")


@query("SELECT o_orderkey, (sum(o_custkey) OVER (ORDER BY o_orderkey) - o_custkey)::BIGINT AS before FROM orders")
def running_sums(spark, sf_dir):
    return ordering.with_running_sum(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey", "before", 16).select("o_orderkey", "before")
