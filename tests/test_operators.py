import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from metaloam.catalogue import QUERIES
from metaloam.functions import tails
from metaloam.operators import batches, calibration, cleaning, graph, hierarchy, models, neighbours, ordering, sampling, shared, tables, transfer, validation
from metaloam.sources import records, sinks
from metaloam.streaming import incremental


def test_bins():
    assert batches.first_fit_decreasing([5, 4, 3, 2, 9], 7) == [[5, 2], [4, 3]]
    assert batches.next_fit([5, 4, 3, 2], 7) == [[5], [4, 3], [2]]
    assert batches.best_fit([5, 4, 3, 2], 7) == [[5, 2], [4, 3]]


def test_pack_rows_keeps_every_row(spark):
    df = spark.createDataFrame([(i, 1 + i % 9) for i in range(50)], "k long, s long")
    got = batches.pack_rows(df, "k", "s", 8).toPandas()
    assert sorted(got["key"]) == list(range(50)) and got[got["size"] > 8]["bin"].isna().all()
    assert got.dropna().groupby(["block", "bin"])["size"].sum().max() <= 8


def test_rate_window():
    now, slept = [0.0], []
    window = batches.RateWindow(2, 60, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(3):
        window.wait()
    assert slept == [60.0]


def test_service_keeps_failures(spark, rows):
    def client(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("1", "a"), ("2", "bad")], "id string, text string").coalesce(1)
    assert rows(batches.call_service(df, "id", "text", client, batch=1)) == [("1", "A", None), ("2", None, "no")]


def test_answers(spark, rows):
    lines = spark.createDataFrame([('{"custom_id":"s1","content":"{\\"biome_label\\":\\"soil\\"}"}',), ("broken",)], "value string")
    good, bad = batches.parse_answers(lines)
    assert rows(good) == [("s1", "soil", "N/A", "N/A", "N/A")] and rows(bad) == [("broken",)]


def test_components(spark, rows):
    chain = [(i, i + 1) for i in range(20)] + [(30, 31), (40, 40)]
    got = dict(rows(graph.components(spark.createDataFrame(chain, "a long, b long"))))
    assert {got[i] for i in range(21)} == {0} and got[31] == 30 and 40 not in got


def test_upsert_and_merge(spark, rows):
    a, b = spark.createDataFrame([("a", 1)], "k string, v long"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v long")
    assert rows(tables.upsert_keep_first(a, b, "k")) == [("a", 1), ("b", 3)]
    assert rows(tables.latest_per_key([a, b], "k")) == [("a", 2), ("b", 3)]


def test_temperature_finds_the_scale(spark):
    rng = np.random.default_rng(0)
    data = []
    for i in range(300):
        s = rng.normal(size=4)
        p = np.exp(s) / np.exp(s).sum()
        g = rng.choice(4, p=p)
        data += [(i, float(3 * x), j == g) for j, x in enumerate(s)]
    t = calibration.fit_temperature(spark.createDataFrame(data, "sample long, score double, is_gold boolean"))
    assert 2 < t < 4.5


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(60)], "id long, vector array<double>, label long")
    one = np.concatenate([np.ones((60, 1)), x], 1)
    target = -np.ones((60, 3))
    target[np.arange(60), y] = 1
    keep = np.diag([0.0] + [1.0] * 5)
    assert np.allclose(models.ridge(df, 3), np.linalg.solve(one.T @ one + keep, one.T @ target))


def test_records(spark, rows, tmp_path):
    (tmp_path / "dump.txt").write_text(">S1\nsample_host=soil\nnote\nx=NA\n\n>S2\ny=a=b\n")
    got = records.read_records(spark, str(tmp_path / "dump.txt"))
    assert rows(got) == [("S1", 0, "sample_host", "soil"), ("S1", 1, "note", None), ("S1", 2, "x", "NA"), ("S2", 0, "y", "a=b")]
    assert rows(records.record_text(got)) == [("S1", "host=soil"), ("S2", "y=a=b")]


def test_terms(spark, rows, tmp_path):
    (tmp_path / "t.obo").write_text('format-version: 1.2\n\n[Term]\nid: EN:1\nname: soil\ndef: "earth" [x]\nsynonym: "dirt" EXACT []\nis_a: EN:0 ! root\n\n[Term]\nid: XX:1\nname: other\n\n[Term]\nid: EN:2\nname: old\nis_obsolete: true\n')
    got = rows(records.read_terms(spark, str(tmp_path / "t.obo"), "EN"))
    assert got == [("en", "EN:1", "soil", ["dirt"], "earth", ["EN:0"], False), ("en", "EN:2", "old", [], None, [], True)]


def test_tables_and_clusters(spark, rows, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\t\n")
    assert rows(records.read_strings(spark, str(tmp_path / "t.tsv"))) == [("1", "")]
    (tmp_path / "p.tsv").write_text("s1\t{x, y}\nbad\ns2\tNA\n")
    assert rows(records.read_pairs(spark, str(tmp_path / "p.tsv"), True)) == [("s1", "x y")]
    (tmp_path / "c.tsv").write_text("SID\tcluster\nr1.s\t-1\nr2.s\t7\nr1.t\t7\nr2.t\t8\n")
    assert rows(records.read_clusters(spark, str(tmp_path / "c.tsv"))) == [("s", "7")]
    (tmp_path / "l.csv").write_text("s1,soil\nbroken\n")
    good, bad = records.read_labelled(spark, str(tmp_path / "l.csv"))
    assert rows(good) == [("s1", "soil")] and rows(bad) == [("broken",)]
    (tmp_path / "m.txt").write_text('sample S9 , meta {"lat": "1"}\n')
    assert rows(records.read_meta_lines(spark, str(tmp_path / "m.txt"))) == [("S9", {"lat": "1"})]


def test_append_missing_computes_new_keys_only(spark, rows, tmp_path):
    seen = []

    def compute(df):
        seen.append(df.count())
        return df.withColumn("v", F.col("k") * 2)

    path = str(tmp_path / "out")
    sinks.append_missing(spark.createDataFrame([(1,), (2,)], "k long"), "k", path, compute)
    got = sinks.append_missing(spark.createDataFrame([(2,), (3,)], "k long"), "k", path, compute)
    assert seen == [2, 1] and rows(got) == [(1, 2), (2, 4), (3, 6)]


def test_stream_runs_until_all_is_read(spark, rows, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    args = (spark, source, "k long", target, str(tmp_path / "checkpoint"), lambda df: df.withColumn("v", F.col("k") + 1), "k")
    spark.createDataFrame([(1,), (1,)], "k long").write.parquet(source)
    incremental.run_available(*args)
    spark.createDataFrame([(1,), (5,)], "k long").write.mode("append").parquet(source)
    incremental.run_available(*args)
    assert rows(spark.read.parquet(target)) == [(1, 2), (5, 6)]


def test_closure_refuses_what_it_would_lose(spark):
    chain = lambda n: spark.createDataFrame([(i, i + 1) for i in range(n)], "child long, parent long")
    assert hierarchy.closure(chain(8), 8).count() == 9 * 10 // 2
    with pytest.raises(ValueError):
        hierarchy.closure(chain(9), 8)


def test_welch_takes_all_groups(spark, tmp_path):
    orders = spark.range(360).selectExpr("concat('p', id % 120) o_orderpriority", "cast(id * id % 97 as double) o_totalprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    assert QUERIES["welch_by_priority"](spark, str(tmp_path)).count() == 120 * 119 // 2


def test_run_tests_choose_their_kind(spark):
    rows = [(r, i, int(h)) for r, n, h in (("a", 10, True), ("b", 10, False)) for i in range(n)]  # no variance, same samples: paired
    rows += [("c", 100 + i, 1) for i in range(8)] + [("d", 200 + i, i % 2) for i in range(8)]
    got = {(r["run1"], r["run2"]): r for r in validation.run_tests(spark.createDataFrame(rows, "run string, sample long, hit int"), "run", "sample", "hit").collect()}
    assert got["a", "b"]["test"] == "McNemar" and got["a", "b"]["statistic"] == pytest.approx(8.1) and got["a", "b"]["p"] == pytest.approx(0.00443)
    assert got["a", "b"]["adjusted"] == pytest.approx(6 * 0.004427, abs=1e-4)
    assert got["c", "d"]["test"] == "Fisher exact" and got["c", "d"]["p"] == pytest.approx(0.07692, abs=1e-5)
    assert got["a", "d"]["test"] == "Fisher exact" and len(got) == 6


def test_letters_of_groups():
    pairs = [(0, 1), (0, 2), (1, 2)]
    assert validation.letters(3, pairs, [0.5, 0.5, 0.5]) == ["a", "a", "a"]
    assert validation.letters(3, pairs, [0.01, 0.01, 0.01]) == ["a", "b", "c"]
    assert validation.letters(3, pairs, [0.5, 0.01, 0.5]) == ["a", "ab", "b"]


def test_tails_of_students_t():
    assert tails.student(1.0, 8.0, 5, 2.0, 8.0, 5)[0] == pytest.approx(-1.118034)
    assert tails.student(1.0, 8.0, 5, 2.0, 8.0, 5)[1] == pytest.approx(0.295996, abs=1e-5)
    assert tails.paired(0.0, 0.0, 4) == (0.0, 1.0) and tails.paired(1.0, 0.0, 4)[1] == 0.0


def test_best_columns_break_ties_by_id():
    rng = np.random.default_rng(2)
    sims = np.round(rng.random((40, 60)), 1)
    ids = np.array([rng.permutation(60) for _ in range(40)])
    got = neighbours.best_columns(sims, ids, 7)
    for i in range(40):
        assert sorted(ids[i][got[i]]) == sorted(ids[i][np.lexsort((ids[i], -sims[i]))[:7]])


def test_reviews_and_samples_refuse_what_they_cannot_do(spark):
    with pytest.raises(ValueError, match="unknown"):
        cleaning.checked_overrides(spark.createDataFrame([("study", "1", "", "maybe")], "scope string, id string, pattern string, decision string"))
    with pytest.raises(ValueError, match="need"):
        cleaning.checked_overrides(spark.createDataFrame([("study",)], "scope string"))
    rows = spark.createDataFrame([(i, i % 2) for i in range(9)], "k long, label int")
    assert sampling.n_per_class(rows, "label", "k", 4, exact=True).count() == 8
    with pytest.raises(ValueError, match="fewer"):
        sampling.n_per_class(rows, "label", "k", 5, exact=True)


def test_running_sums_of_ranges(spark):
    rows = spark.createDataFrame([(float(i * 7 % 101), i) for i in range(101)], "x double, v long")
    for ranges in (1, 16):
        got = {r["x"]: r["s"] for r in ordering.with_running_sum(rows, "x", "v", "s", ranges).collect()}
        order, total = sorted((r["x"], r["v"]) for r in rows.collect()), 0
        for x, v in order:
            assert got[x] == total
            total += v
    assert ordering.with_running_sum(rows.limit(0), "x", "v", "s").count() == 0


def test_intermediate_tables_go(spark):
    df = shared.stored(spark.range(5), "test")
    where = df._stored_at
    shared.discard(df, spark.range(3))
    assert not os.path.exists(where.removeprefix("file:")) and df._stored_at is None


def test_ranked_and_hybrid_scores(spark):
    scores = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 1.0), (2, "a", 2.0)], "s long, label string, score double")
    got = {r["s"]: r for r in transfer.ranked(scores, "s", 2).collect()}
    assert got[1]["top"] == ["c", "a"] and got[1]["confidence"] == 0.5 and got[2]["top"] == ["a"]
    linear = scores.filter("label <> 'b'")
    mixed = {(r["s"], r["label"]): r["score"] for r in transfer.hybrid(linear, scores, "s", 2.0).collect()}
    assert mixed[1, "b"] == 0.0 and mixed[1, "c"] == 3.0


def test_first_fit_by_tree_is_first_fit():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 200):
        sizes, rooms, bins = rng.integers(1, 30, n).tolist(), [], []
        for s in sorted(sizes, reverse=True):
            i = next((i for i, r in enumerate(rooms) if s <= r), len(rooms))
            if i == len(rooms):
                rooms.append(29)
                bins.append([])
            rooms[i] -= s
            bins[i].append(s)
        assert batches.first_fit_decreasing(sizes, 29) == bins


def test_retries_wait_longer_each_time():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return ["done"]

    assert batches.with_retries(call, 2, 1.0, waits.append) == (["done"], None) and waits == [1.0, 2.0]
    assert batches.with_retries(lambda: 1 / 0, 1, 0.0) == (None, "division by zero")


def test_rules_and_first_values(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "k long, scope string, said string")
    rules = spark.createDataFrame([("a", None, 1, "keep"), ("a", "^y", 2, "drop")], "scope string, pattern string, rule_order int, decision string")
    assert {r["k"]: r["decision"] for r in tables.ordered_rules(df, rules, "scope", "k", "said").collect()} == {1: "keep", 2: "drop", 3: None}
    long = spark.createDataFrame([(1, "i", "z", 0), (1, "i", "a", 1)], "k long, item string, v string, pos int")
    assert tables.wide_from_long(long, "k", "item", "v", ["i"], "pos").first()["i"] == "z"
