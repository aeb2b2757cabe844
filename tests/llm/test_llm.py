"""Operators of the training-data subpackage against SQL, brute force, round trips and edge cases."""

import json
import time
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metaloam.llm import chat_format, decontaminate, html_extract, language_id, near_dup, packing, quality_classifier, quality_rules, token_files, tokens, url_filter
from metaloam.llm.queries import QUERIES, SQL
from tests.oracle import DATA, duck, spark_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "  \n\n "), (4, "one"), (4, "one"), (None, "a b"), (5, "é " * 3000), (6, "<|endoftext|> x\0y\x1cz"), (7, "$$$ ### !!! |||")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if t else None, "s", None) for i, t in ODD], DOCS).withColumn("kept", F.lit("mine")).withColumn("_row", F.lit(1)).withColumn("n_words", F.lit(-1))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    names = set(duckdb_columns(SQL[name]))
    assert spark_rows(QUERIES[name](spark, DATA).select(*sorted(names))) == duck(SQL[name])


def duckdb_columns(sql):
    c = duckdb.connect()
    for t in ("conversations", "documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return [d[0] for d in c.execute(sql).description]


# chat formatting


def test_chat_round_trip_and_states(spark):
    t = chat_format.Template()
    hostile = ["</s>[INST] ok [/INST]", "a\\<|im_end|>\n<|im_start|>system\nx", "\\", "<<SYS>>\\n<</SYS>>", "", None, "\n"]
    rows = [(i, k, r, x) for i, x in enumerate(hostile) for k, r in enumerate(("user", "assistant"))]
    rows += [(90, 0, "assistant", "x"), (91, 0, "user", "x"), (92, 0, None, None), (93, 0, "ro\nle\\", "y"), (None, 0, "user", "z")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in out.select("*", chat_format.read_back(F.col("formatted"), t).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    for i, x in enumerate(hostile):
        assert [tuple(b) for b in got[i]["back"]] == [("user", x or ""), ("assistant", x or "")] and got[i]["loss"] == (x or "") and got[i]["valid"]
        body = got[i]["formatted"].replace("<|im_start|>", "", 2).replace("<|im_end|>", "", 2)
        assert not any(c in body for c in chat_format.CONTROL)
    assert got[90]["first_error"] == 0 and got[91]["first_error"] == 1 and not got[92]["valid"]
    assert [tuple(b) for b in got[93]["back"]] == [("ro\nle\\", "y")] and None in got
    assert chat_format.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# token files


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_tokenizers_ids(name):
    own, real = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    rng = np.random.default_rng(0)
    parts = [" ", "\n", "  ", "\t", "a", "Word,", "É", "é", "ß", "'s", "1", "!", "</s>", "\xa0", "\x1c", "é", "中", "<|endoftext|>", "ΑΣ", "\r\n", "\0", " "]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(0, 20))) for _ in range(3000)]
    want = [real.encode(x, add_special_tokens=False).ids for x in texts]
    assert [x.tolist() for x in own.encode_batch(texts)] == want and [own.encode(x).tolist() for x in texts] == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_forget_and_stay_small(name, monkeypatch):
    def texts(begin, end):
        return [" ".join(f"w{format(i * 7919 % 10**6, 'x').translate(digits)}, the" for i in range(k, k + 1000)) for k in range(begin, end, 1000)]

    digits = str.maketrans("0123456789", "ghijklmnop")
    own, real = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    own.encode_batch(["warm up"])
    tracemalloc.start()
    own.encode_batch(texts(0, 60_000))
    held = tracemalloc.get_traced_memory()[0]
    # texts that are long together: numbered a part at a time
    tracemalloc.reset_peak()
    long = ["the cat sat on " * 40_000 + str(i) for i in range(20)]
    got = own.encode_batch(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 60_000 * 250
    assert peak < 20_000_000 + sum(x.nbytes for x in got) + held + 100_000_000
    assert got[7].tolist() == real.encode(long[7], add_special_tokens=False).ids
    # pieces that were met again stay, and what is forgotten is learnt anew
    monkeypatch.setattr(tokens, "REMEMBER", 3000)
    for begin in (*range(0, 20_000, 2000), 0):
        for text, ids in zip(part := texts(begin, begin + 2000), own.encode_batch(part), strict=True):
            assert ids.tolist() == real.encode(text, add_special_tokens=False).ids
        assert len(own.place) <= 3000 + 2002
    key = " the".strip()
    learnt = []
    monkeypatch.setattr(own, "_piece", lambda k, f=own._piece: learnt.append(k) or f(k))
    for begin in range(30_000, 40_000, 2000):
        own.encode_batch(texts(begin, begin + 2000))
    assert learnt and key not in learnt


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_known_pieces_are_found_fast(name):
    """Encoding texts whose pieces are known takes less than it takes to copy each distinct one out of Arrow as a scalar."""
    own = tokens.Encoder(public_tokenizers.path(name))
    words = [f"w{i:x}a" for i in range(60_000)]
    texts = [" ".join(words[i : i + 300]) for i in range(0, len(words), 300)]
    coded = pa.array(words)
    first = own.encode_batch(texts)

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    took = min(seconds(lambda: own.encode_batch(texts)) for _ in range(7))
    copied = min(seconds(coded.to_pylist) for _ in range(7))
    assert took < copied
    assert all((a == b).all() for a, b in zip(first, own.encode_batch(texts), strict=True))
    # repeated unknown pieces of one text
    odd = "new\twq1 wq2\twq1  wq2 wq1"
    assert own.encode(odd).tolist() == Tokenizer.from_file(public_tokenizers.path(name)).encode(odd, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(tmp_path):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "own.json").write_text(json.dumps(spec))
    own, real = tokens.Encoder(str(tmp_path / "own.json")), Tokenizer.from_file(str(tmp_path / "own.json"))
    texts = ["Hello there", "a b\nc", "", None, " x"]
    assert not own.apart and [x.tolist() for x in own.encode_batch(texts)] == [real.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_token_file_query_against_the_library(spark):
    real = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, want = 0, []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect():
        ids = [*real.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = QUERIES["op2_token_files"](spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in got) == want


def test_token_files_round_trip(spark, odd, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest = token_files.write(odd, f"file://{tmp_path}/t", path)
    got = token_files.read_documents(spark, f"file://{tmp_path}/t", manifest).toPandas().sort_values("start")
    real = Tokenizer.from_file(path)
    want = sorted([(-1 if i is None else i, real.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in ODD], key=lambda r: r[0])
    assert [(-1 if pd.isna(i) else i) for i in got["doc_id"]] == [i for i, _ in want]
    assert got["start"].tolist() == np.cumsum([0, *(len(x) for _, x in want[:-1])]).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for _, x in want]
    none = token_files.write(empty, f"file://{tmp_path}/e", path)
    assert token_files.read_documents(spark, f"file://{tmp_path}/e", none).count() == 0


# quality


def test_repeated_words_match_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = rng.integers(0, 3, rng.integers(0, 60))
        windows = [tuple(ids[i : i + 8]) for i in range(len(ids) - 7)]
        n = Counter(windows)
        hit = {i + j for i, w in enumerate(windows) if n[w] > 1 for j in range(8)}
        assert quality_rules.repeated_words(ids) == len(hit)


def test_ledger_policies_and_ablation(spark, odd, empty):
    entries = quality_rules.apply_policy(quality_rules.ledger(odd))
    got = {r["text"]: r for r in entries.collect()}
    assert got[None]["n_words"] == 0 and not got[None]["kept"] and got["é " * 3000]["n_repeat_words"] == 3000
    assert quality_rules.measure("a b\n\nA  b\na b\n \n")[:5] == (6, 6, 0, 1, 0)
    rows = {r["rule"]: r for r in quality_rules.ablation(entries).collect()}
    masks = [r["failures"] for r in entries.collect()]
    assert all(rows[r.name]["n_failed"] == sum(m >> r.bit & 1 for m in masks) and rows[r.name]["n_alone"] == sum(m == 1 << r.bit for m in masks) for r in quality_rules.RULES)
    assert quality_rules.keep(odd).columns == odd.columns and quality_rules.keep(empty).count() == 0


def test_machine_uses_the_sum_of_squares():
    rng = np.random.default_rng(5)
    m = quality_classifier.FactorisationMachine(0.1, rng.normal(size=quality_classifier.DIM), rng.normal(size=(quality_classifier.DIM, 4)))
    at, x = quality_classifier.features("Some words, some MORE words!!")
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    margin, _ = m.terms(quality_classifier.Rows.of([(at, x)]))
    assert margin[0] == pytest.approx(0.1 + m.linear[at] @ x + pairs, rel=1e-5)


def test_classifier_learns_and_handles_odd_rows(spark, odd, empty):
    good, bad = "the plain words of a text number {} follow here", "$$$ ### BUY!! NOW!! {} ### $$$ NOW!! BUY!!"
    docs = spark.createDataFrame([(i, (good if i % 2 else bad).format(i)) for i in range(400)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    model = quality_classifier.train(docs, labels)
    scored = docs.withColumn("s", quality_classifier.score(spark, model, F.col("text"))).toPandas()
    assert ((scored["s"] > 0.7) == (scored["doc_id"] % 2 == 1)).mean() > 0.99
    values = odd.withColumn("s", quality_classifier.score(spark, model, F.col("text"))).toPandas()["s"]
    assert values.between(0, 1).all() and len(values) == len(ODD)
    assert quality_classifier.keep(odd, model).columns == odd.columns
    none = quality_classifier.train(empty, labels.limit(0))
    assert none.score(quality_classifier.Rows.of([quality_classifier.features("x")]))[0] == 0.5


def test_language(spark, odd, empty):
    texts = {"en": "the house and the garden of the town {}", "de": "das haus und der garten der stadt {}", "fr": "la maison et le jardin de la ville {}"}
    docs = spark.createDataFrame([(i, lang, t.format("x" * (i % 5))) for i in range(90) for lang, t in [list(texts.items())[i % 3]]], "doc_id long, lang string, text string")
    models = language_id.train(docs)
    predict = lambda t: language_id.decided(models, [t])[0]
    assert [predict(t)[0] for t in texts.values()] == list(texts) and predict("12 !")[0] == "und" and predict(None) == ("und", 0.0)
    assert predict("\U000e0041\U000f0000") == ("und", 0.0) and predict("\U00020000")[0] != "und"
    long = "das haus " * 200_000
    assert predict(long)[0] == "de" and sum(len(g) for g in language_id.grams(long)) > 2.7 * len(long)
    assert predict("das haus der stadt")[1] > predict("das haus de la ville")[1] > 0
    got = odd.select(language_id.predict(spark, models, F.col("text")).alias("p")).select("p.*").toPandas()
    assert got["score"].between(0, 1).all() and (got["lang_pred"] == "und").sum() == 4
    assert language_id.decided(language_id.train(empty), ["text"]) == [("und", 0.0)]
    assert empty.select(language_id.predict(spark, models, F.col("text"))).count() == 0
    tied = language_id.train(spark.createDataFrame([(i, x, "same words") for i, x in enumerate("ab" * 20)], "doc_id long, lang string, text string"))
    n = {k: tied[0].log_prior[i] for i, k in enumerate(tied[0].languages)}
    assert language_id.decided(tied, ["same words"])[0][0] == max(sorted(n), key=n.get)


def test_more_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 3)
    names = [f"l{i}" for i in range(8)]
    docs = spark.createDataFrame([(8 * j + i, x, f"{chr(97 + i) * 3} {chr(98 + i) * 2}") for i, x in enumerate(names) for j in range(6)], "doc_id long, lang string, text string")
    models = language_id.train(docs)
    assert [len(m.languages) for m in models] == [3, 3, 2]
    assert [x for x, _ in language_id.decided(models, [f"{chr(97 + i) * 3}" for i in range(8)])] == names


def test_language_evidence_is_plain_naive_bayes():
    rng = np.random.default_rng(4)
    model = language_id.NaiveBayes(["a", "b", "c"], np.log([0.2, 0.3, 0.5]), np.log(rng.random((1 << language_id.BITS, 3))).astype(np.float32))
    texts = ["One text, and more.", None, "", "Zwei! " * 50, "\u00e9t\u00e9"]
    n, totals = model.evidence(texts)
    for text, k, total in zip(texts, n, totals, strict=True):
        buckets = [b for part in language_id.grams(text) for b in part.tolist()]
        assert k == len(buckets) and total == pytest.approx(model.log_prior + sum((model.log_prob[b].astype(float) for b in buckets), np.zeros(3)), rel=1e-5)


@pytest.mark.parametrize("name, least", [("op3_quality_classifier", 0.9), ("op9_language_id", 0.95)])
def test_held_out_accuracy(spark, name, least):
    """Over the rows that no model has seen."""
    data = DATA.replace("0.001", "0.01")
    got = {r["doc_id"]: r for r in QUERIES[name](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    if name.startswith("op3"):
        truth, said = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}, "predicted"
    else:
        truth, said = {r["doc_id"]: r["lang"] for r in docs.filter("lang IS NOT NULL AND text RLIKE '[a-z]'").collect()}, "lang_pred"
    right = [got[i][said] == x for i, x in truth.items() if x is not None and got[i]["held_out"]]
    assert len(right) > 50 and np.mean(right) >= least


# urls and pages


def test_urls(spark):
    urls = ["http://A.Net/x", "http://a.net", "https://b.example.net/en/1", "http://example.com/de/", "http://xexample.com/de/", "http://z.org/fr/1", "http://www.cheap-pills.example.com/", "http://news.example.com/", None, "nothing", "http://É.NET/?q#f"]
    got = [tuple(r) for r in url_filter.judge(spark.createDataFrame([(u,) for u in urls], "url string").coalesce(1)).select("host", "path", "rule", "verdict").collect()]
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2] is None and got[2] == ("b.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2] is None and got[5][2:] == ("org/fr/", "allow")
    assert got[6][3] == "block" and got[7][3] == "allow" and got[8][:2] == ("", "") == got[9][:2] and got[10] == ("É.net", "/", "net/", "block")


def test_url_model_on_held_out_urls(spark):
    table = url_filter.labelled_urls()
    assert table["url"].is_unique and set(table["label"]) == {0, 1} and url_filter.accuracy(table) >= 0.9
    model = url_filter.train(table)
    assert url_filter.score(model, "alphabet.com", "/x") < 0.5 < url_filter.score(model, "www.cheap-pills.com", "/")
    empty = spark.createDataFrame([], "url string")
    assert url_filter.judge(empty).count() == 0
    clash = spark.createDataFrame([("http://a.net/x", "mine", 7)], "url string, host string, other int")
    assert tuple(url_filter.judge(clash).select("host", "other", "verdict").first()) == ("a.net", 7, "block")
    none = url_filter.judge(clash, rules=(), labelled=table.iloc[:0]).first()
    assert none["rule"] is None and none["verdict"] == "allow"


def test_url_query_against_plain_python(spark):
    model = url_filter.train(url_filter.labelled_urls())
    rules = dict(url_filter.RULES)
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = QUERIES["op6_url_filter"](spark, DATA).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = url_filter.split_url(urls[r["page_id"]])
        fit = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        verdict = rules[rule] if rule else "block" if url_filter.score(model, host, path) >= 0.5 else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


PAGE = '<html><body class="has-sidebar"><header><a href=/>Site</a></header><div class="cookie-notice">We use cookies</div><div id=menu><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div><div class="content"><h1>Ti&eacute;tle {0}</h1><p>First <b>pa</b>ra {0}.<p>Second&nbsp;para<br>line {0}<form>Your name <input></form></div><div id="comments"><p>nice!</p></div><div class=sidebar>side</div><footer>(c)</footer>'


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.example.org/{i}", PAGE.format(f"number {i}")) for i in range(10)] + [(20, None, None), (21, "x", ""), (21, "x", "")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Tiétle number {i} First para number {i}. Second para line number {i}" for i in range(10)) and got[20] == got[21] == ""
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes_are_the_template():
    pages = [html_extract.parse(f"<div><ul>{'<li><a>x%d</a></li>' % i * (i + 1)}</ul></div><p>Same words here {i} </p>") for i in range(6)]
    found = html_extract.classes(pages)
    assert {"Same", "words", "here"} <= {t for c in found for _, t in c.tokens} and any(c.vector == (1, 2, 3, 4, 5, 6) for c in found)


def test_copies_keep_their_text():
    page = "<body><h1>Big title</h1><p>Short text here</p></body>"
    assert html_extract.extract_block([page] * 3) == ["Big title Short text here"] * 3
    assert html_extract.extract_block([page, None, page, page + "<!-- again -->"]) == ["Big title Short text here", "", *["Big title Short text here"] * 2]


def test_template_inside_an_article():
    pages = [f"<body><article><h1>Title{i}</h1><p>Own words{i} of page{i}</p><div><p>Read our letter daily</p></div><p>The end{i}</p></article></body>" for i in range(6)]
    assert html_extract.extract_block(pages) == [f"Title{i} Own words{i} of page{i} The end{i}" for i in range(6)]


@pytest.mark.parametrize("kinds", [1, 2, 4, 12])
def test_each_layout_of_a_large_host_has_a_template(kinds):
    pages = []
    for i in range(48):
        k = i % kinds
        notice = f"<p>Kind{k} pages{k} are{k} printed{k}</p>"
        pages.append(f"<body>{'<div>' * (k + 1)}{notice}<h1>Title{i}</h1><p>Own words{i} of page{i}</p>{'</div>' * (k + 1)}</body>")
    assert html_extract.extract_block(pages) == [f"Title{i} Own words{i} of page{i}" for i in range(48)]


def one(page):
    return html_extract.extract_block([page])[0]


def test_nothing_of_an_article_is_lost():
    assert one("<p>" + "\u0130" * 6 + "<script>x</script>Hello world") == "\u0130" * 6 + "Hello world"
    inside = '<div class="related">a</div><p class="share-price">b</p><ul id="rating-agencies"><li>c</ul><section id="discussion">d</section><p>e <math>f</math> <svg><text>g</text></svg></p><h2 class="header">h</h2>'
    assert one(f"<body><nav>x</nav><article>{inside}</article><footer>y</footer>").split() == list("abcdefgh")
    gone = '<div class="ad">x</div><div class="cookie-notice">x</div><form>x</form><aside>x</aside><ul class="comments"><li>x</ul><nav>x</nav><style>x</style><SCRIPT>x</ScRiPt><noscript>x</noscript><div role="search">x</div>'
    assert one(f"<article>{gone}a</article>") == "a"
    assert one("<body><p><a href=1>A linked paragraph</a><p>Then text") == "A linked paragraph Then text"
    assert one("<body><ul><li><a>x</a><li><a>y</a></ul><p>text <a>and link</a>") == "text and link"
    assert one("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after") == "deep after"
    long = " ".join(f"w{i}" for i in range(200_000))
    assert one(f"<article><p>{long}</article>") == long
    assert one("a &lt;b&gt; &amp;amp; &#x41; &nbsp;\n\t c") == "a <b> &amp; A c"


def test_template_is_a_tree_and_its_slots_give_the_text():
    rows = ["".join(f"<tr><td>Name</td><td>n{i}{k}</td><td>Price</td><td>p{i}{k}</td></tr>" for k in range(i + 1)) for i in range(6)]
    sources = [f"<article><h1>Head{i}</h1><div><p>Read our letter daily</p></div><table>{r}</table><p>End{i}</p></article>" for i, r in enumerate(rows)]
    pages = [html_extract.parse(x) for x in sources]
    template = html_extract.deduce(pages)
    outer = next(k for k, c in enumerate(template.classes) if c.vector == (1,) * 6)
    inner = next(c for c in template.classes if c.vector == (1, 2, 3, 4, 5, 6))
    assert inner.parent == outer and template.classes[outer].tokens[inner.gap][1].startswith("<table")
    free = template.slot_words(pages[1])
    assert [w for (_, w), f in zip(pages[1].tokens, free, strict=True) if f and w[0] != "<"] == ["Head1", "n10", "p10", "n11", "p11", "End1"]
    assert html_extract.main_text(pages[1], template) == "Head1 n10 p10 n11 p11 End1"
    assert "Read our letter daily" in html_extract.main_text(pages[1], html_extract.Template())


def test_repeated_rows_and_extra_columns(spark):
    rows = [(1, "http://a.org/1", "<p>One")] * 90 + [(None, None, "<p>Two")] * 70 + [(i, "http://a.org/x", f"<p>Page {i}") for i in range(2, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in ("_host", "_salt", "_page", "text", "_n")})
    got = Counter((r["page_id"], r["text"]) for r in html_extract.extract(pages, block_pages=16).collect())
    assert got == Counter([(1, "One")] * 90 + [(None, "Two")] * 70 + [(i, f"Page {i}") for i in range(2, 60)])


def test_page_query_against_a_plain_reading(spark):
    """The test pages have one article; what it holds, read by removing tags, is the text."""
    import html
    import re

    def plain(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1|div|article)[^>]*>", body[1] if body else "")
        found = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks)
        return " ".join(b for b in found if b)

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = QUERIES["op10_html_extract"](spark, DATA).collect()
    assert len(got) == len(pages) and all((r["url"], r["text"], r["n_chars"]) == (pages[r["page_id"]]["url"], plain(pages[r["page_id"]]["html"]), len(r["text"])) for r in got)


# near duplicates


@pytest.mark.parametrize("most", [1, 9])
def test_signature_estimates_probability_jaccard(most):
    rng = np.random.default_rng(7)
    agreed, real = [], []
    for _ in range(30):
        ids = rng.integers(1, 1 << 62, 400).astype(np.uint64)
        a, b = np.sort(ids[:300]), np.sort(ids[60:360])
        x, y = rng.integers(1, most + 1, 300), rng.integers(1, most + 1, 300)
        agreed.append((near_dup.signature(a, x) == near_dup.signature(b, y)).mean())
        real.append(near_dup.probability_jaccard(a, x, b, y))
        assert real[-1] == pytest.approx(plain_similarity(dict(zip(a.tolist(), x.tolist(), strict=True)), dict(zip(b.tolist(), y.tolist(), strict=True))))
    assert abs(np.mean(agreed) - np.mean(real)) < 0.03 and (most > 1 or np.mean(real) == pytest.approx(240 / 360))


def plain_similarity(x, y):
    """Probability Jaccard by its definition."""
    both = [i for i in x if i in y]
    only = sum(w for i, w in x.items() if i not in y), sum(w for i, w in y.items() if i not in x)
    return sum(1 / (sum(max(x[j] / x[i], y[j] / y[i]) for j in both) + only[0] / x[i] + only[1] / y[i]) for i in both)


def brute_classes(rows):
    counts = [Counter(near_dup.shingles(t).tolist()) for _, t in rows]
    lead = list(range(len(rows)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            common, union = len(counts[i].keys() & counts[j].keys()), len(counts[i].keys() | counts[j].keys())
            near = union and common >= 0.8 * union
            if not near and common > 0.3 * union and max(*counts[i].values(), *counts[j].values()) > 1:
                near = plain_similarity(counts[i], counts[j]) >= 0.8
            if same or rows[i][0] == rows[j][0] or near:
                lead[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), k), k)
    return sorted((k, least[top(i)]) for i, (k, _) in enumerate(rows))


def test_classes_match_brute_force(spark, empty):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(500)]
    rows, k = [], 0
    for _ in range(12):
        base = list(rng.choice(words, 80))
        for _ in range(6):
            own = list(base)
            for at in rng.integers(0, 80, rng.integers(0, 4)):
                own[at] = "new"
            rows.append((k := k + 1, " ".join(own)))
    rows += [(100, "a b"), (101, "A, b!"), (102, ""), (103, ""), (104, None), (105, None), (106, "!!"), (7, rows[40][1])]
    long = [f"x{i}" for i in range(30_000)]
    rows += [(110, " ".join(long)), (111, " ".join([*long[:-1], "other"])), (112, " ".join(long[:60])), (113, " ".join(long[:60] + 9 * long[40:60])), (113, " ".join(long[100:160]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("mine") for c in ("class_id", "node", "_lead", "_row", "key")})
    assert sorted(tuple(r) for r in near_dup.classes(docs).collect()) == brute_classes(rows)
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute_classes(rows)})
    assert near_dup.classes(empty).count() == 0


def test_query_finds_the_links_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in QUERIES["op4_near_dup"](spark, DATA).collect()) == brute_classes([tuple(r) for r in docs])


def test_sketch_is_safe_for_repeated_lines():
    words = [f"w{i}" for i in range(104)]
    once, often = " ".join(words), " ".join(words + 19 * words[-14:])
    assert near_dup.probability_jaccard(*np.unique(near_dup.shingles(once), return_counts=True), *np.unique(near_dup.shingles(often), return_counts=True)) < 0.5
    assert set(near_dup.sketch(once)) & set(near_dup.sketch(often)) and brute_classes([(1, once), (2, often)]) == [(1, 1), (2, 1)]


@pytest.mark.parametrize("block", [1024, 7])
def test_no_pair_of_a_group_is_left_untested(spark, block):
    """Any single link between different classes of a group of 40 is found, whichever members it joins."""
    rng = np.random.default_rng(3)
    members, elements, expected = [], [], {}
    for key in range(20):
        own = rng.integers(0, 1 << 62, (40, 120)).astype(np.uint64)
        x, y = sorted(rng.choice(40, 2, replace=False).tolist())
        own[y, :110] = own[x, :110]
        own[:, 110] = key
        members += [(key, 100 * key + i, "", 1 + 39 // block) for i in range(40)]
        elements += [(100 * key + i, "", bytearray(np.sort(s).tobytes()), None) for i, s in enumerate(own)]
        expected[100 * key + y] = 100 * key + x
    groups = spark.createDataFrame(members, "key long, node long, _print string, blocks long")
    weighed = spark.createDataFrame(elements, "node long, _print string, elements binary, counts binary")
    first = groups.select("key", "node", "_print", F.col("node").alias("label"), F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.lit(0).cast("long").alias("other"))
    found = near_dup._links(first, weighed)
    labels = found.select(F.col("b").alias("node"), F.col("a").alias("label"))
    rest = near_dup._links(near_dup._rest(groups, labels), weighed)
    assert {max(r): min(r) for r in found.union(rest).collect()} == expected


def test_products_are_sums_over_common_elements():
    rng = np.random.default_rng(1)
    for m in (2, 9, 60):
        elements = [np.unique(rng.integers(0, 200, rng.integers(0, 150))).astype(np.uint64) for _ in range(m)]
        values = [rng.random(len(e)) for e in elements]
        got = near_dup.products(elements, values)
        for i in range(m):
            own = dict(zip(elements[i].tolist(), values[i], strict=True))
            for j in range(m):
                want = sum(own.get(e, 0) * v for e, v in zip(elements[j].tolist(), values[j], strict=True))
                assert i == j or got[i, j] == pytest.approx(want, rel=1e-5, abs=1e-9)


def look_alikes(rng, name, size, bridge):
    """Two classes of variants, all pairs of which look alike; a bridge of two texts links them by one pair alone."""
    base = [f"{name}{i}" for i in range(300)]
    between = lambda n: base[:125] + [f"{name}other{i}" for i in range(n)] + base[125 + n :]
    out = []
    for k in range(size):
        for own in between(0), between(34):
            own[int(rng.integers(0, 100))] = f"{name}own{k}"
            out.append(" ".join(own))
    for own in (between(11), between(23)) if bridge else ():
        own[30] = own[60] = f"{name}bridge"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("size, bridge, limits", [(150, True, {}), (150, False, {}), (30, True, {"block": 20}), (60, False, {"block": 20}), (30, True, {"block_shingles": 3000})])
def test_all_pairs_of_look_alikes_are_decided(spark, size, bridge, limits):
    rows = list(enumerate(look_alikes(np.random.default_rng(5), "p", size, bridge), 1))
    expected = brute_classes(rows)
    assert len({c for _, c in expected}) == 2 - bridge
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in near_dup.classes(docs, **limits).collect()) == expected


# decontamination and packing


def test_short_items_and_removal(spark, empty):
    items = spark.createDataFrame([(1, "The and"), (2, "  "), (3, None), (4, "a b c d e f g h i j k l m")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x The, and q"), (2, ""), (3, None), (4, "w " * 60 + "THE... and! " + "v " * 60), (4, "w " * 60 + "THE... and! " + "v " * 60)], "doc_id long, text string").withColumn("_hit", F.lit(1)).withColumn("w", F.lit(2))
    got = decontaminate.remove(docs, items)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in got.collect() if r["text"]) == [(4, "w " * 60 + "v " * 60)] * 2
    assert sorted(r["doc_id"] for r in got.collect()) == [2, 3, 4, 4]
    whole = decontaminate.hits(docs.select(F.col("doc_id").alias("_row"), "text"), items, broadcast_bytes=1)
    assert {r["_row"]: len(r["spans"]) for r in whole.filter("_row < 4").collect()} == {1: 1, 2: 0, 3: 0}
    assert decontaminate.remove(docs, items.limit(0)).count() == 5 and decontaminate.remove(empty, items).count() == 0


def test_blocks_of_windows_give_the_same_hits(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("_row"), "text")
    long = spark.createDataFrame([(-1, " ".join(f"w{i % 977}" for i in range(20_000)))], "_row long, text string")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.concat(F.lit("item "), "item_id").alias("item_id"), "text")
    items = items.unionByName(spark.createDataFrame([("own", " ".join(f"w{i}" for i in range(40, 60)))], "item_id string, text string"))
    told = lambda df: sorted((r["_row"], r["n_words"], [tuple(x) for x in r["spans"]], sorted(r["items"])) for r in df.collect())
    once = told(decontaminate.hits(docs.unionByName(long), items))
    assert once == told(decontaminate.hits(docs.unionByName(long), items, broadcast_bytes=200_000))
    assert once[0][:2] == (-1, 20_000) and len(once[0][2]) == 21 and once[0][3] == ["own"]
    assert any(len(r[2]) > 0 for r in once[1:])


def test_removal_goes_by_content(spark):
    items = spark.createDataFrame([("i", "a b c d e f g h i j k l m")], "item_id string, text string")
    texts = ["w " * 400 + "A b, c d e f g h i j k l m! " + "v " * 400, "x y z", None, "a b c d e f g h i j k l m"]
    docs = spark.createDataFrame([(i % 4, texts[i % 4]) for i in range(60)], "doc_id long, text string").repartition(5).withColumn("_key", F.lit("mine"))
    for limit in (decontaminate.BROADCAST_BYTES, 1):
        got = decontaminate.remove(docs, items, broadcast_bytes=limit)
        assert got.columns == docs.columns
        assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter({(0, "w " * 400 + "v " * 400): 15, (1, "x y z"): 15, (2, None): 15})


def test_plan_places_every_piece():
    rng = np.random.default_rng(2)
    sizes = packing.slot_sizes()
    h = Counter(int(sizes[np.searchsorted(sizes, v)]) for v in np.clip(np.exp(rng.normal(6, 1.2, 4000)).astype(int), 1, 2048))
    used = Counter()
    for parts, times in packing.plan(h):
        assert sum(parts) <= 2048 and times > 0
        for s in parts:
            used[s] += times
    assert used == h and packing.plan({}) == []


def test_pack_is_whole(spark, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.cut(odd, path).withColumn("_piece", F.monotonically_increasing_id()).persist()
    got = packing.pack(pieces).toPandas().sort_values(["sequence_id", "offset"])
    assert (got["offset"] == got.groupby("sequence_id")["length"].cumsum() - got["length"]).all() and got.groupby("sequence_id")["length"].sum().max() <= 2048
    real = Tokenizer.from_file(path)
    want = Counter(tuple(real.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in ODD)
    assert got["length"].sum() == sum(len(k) * n for k, n in want.items())
    whole = packing.sequences(packing.pack(pieces)).toPandas()
    assert all(len(x) == 4 * 2048 or (len(x) // 4) & (len(x) // 4 - 1) == 0 for x in whole["ids"])
    assert packing.pack(packing.cut(empty, path).withColumn("_piece", F.monotonically_increasing_id())).count() == 0


def test_pack_query_against_the_library(spark):
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*real.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = QUERIES["op5_packing"](spark, DATA).toPandas()
    for doc, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        assert own["start"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() == len(ids[doc]) == own["doc_tokens"].iloc[0]
        for start, n, crc in own[["start", "length", "ids_crc32"]].itertuples(index=False):
            assert crc == zlib.crc32(np.array(ids[doc][start : start + n], "<u4").tobytes())
    assert set(got["doc_id"]) == set(ids)
    filled = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert (got.sort_values(["sequence_id", "offset"])["offset"] == filled.cumsum() - got.sort_values(["sequence_id", "offset"])["length"]).all()
    totals = filled.sum()
    places = totals.where((totals & (totals - 1)) == 0, 2048)
    assert totals.max() <= 2048 and totals.sum() / places.sum() > 0.97


def test_pieces_keep_clashing_columns(spark):
    pieces = spark.createDataFrame([(i, 100 + i, "a", "b", i) for i in range(50)], "_piece long, length long, _slot string, _number string, offset long")
    got = packing.pack(pieces)
    assert sorted(got.columns) == sorted(["length", "_slot", "_number", "offset", "sequence_id"])
    assert got.filter("_slot = 'a' AND _number = 'b'").count() == 50 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_long_texts_and_clashing_columns(spark):
    long = " ".join(f"word{i}</s>" for i in range(60_000))
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string").withColumns({c: F.lit("mine") for c in ("turns", "segments", "m", "t")})
    got = chat_format.format_conversations(turns).select(chat_format.read_back(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss")).first()
    assert got["loss"] == long and [tuple(x) for x in got["back"]] == [("user", "q"), ("assistant", long)]
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string").withColumn("_score", F.lit("mine"))
    model = quality_classifier.FactorisationMachine(0.5, np.zeros(quality_classifier.DIM), np.zeros((quality_classifier.DIM, 2)))
    assert quality_classifier.keep(docs, model, 0.6).count() == 2 and quality_classifier.keep(docs, model, 0.6).columns == docs.columns
    path = public_tokenizers.path("byte_bpe_50k.json")
    n = len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids) + 1
    pieces = packing.cut(docs, path).filter("doc_id = 1").toPandas()
    assert pieces["length"].sum() == n == pieces["doc_tokens"].iloc[0] and pieces["length"].max() == 2048


def plain_decontamination(texts, items):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    known = set()
    for x in items:
        w = [low(y) for y in word.findall(x or "")]
        known.update(tuple(w[i : i + min(13, len(w))]) for i in range(max(0, len(w) - 12) or (1 if w else 0)))
    sizes = sorted({len(k) for k in known})
    out = {}
    for i, x in texts.items():
        found = list(word.finditer(x or ""))
        w = [low(m[0]) for m in found]
        hit = {k for n in sizes for at in range(len(w) - n + 1) if tuple(w[at : at + n]) in known for k in range(at, at + n)}
        if hit and 20 * len(hit) >= len(w):
            continue
        if hit:
            ends = [m.start() for m in found[1:]] + [len(x)]
            x = x[: found[0].start()] + "".join(x[m.start() : e] for k, (m, e) in enumerate(zip(found, ends, strict=True)) if k not in hit)
        out[i] = x
    return out


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-duplicates", "benchmark decontamination", "packing"]
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    judged = duck(f"SELECT doc_id, kept FROM ({SQL['op7_quality_rules']})")
    texts = {i: texts[i] for i, kept in judged if kept}
    model = quality_classifier.train(docs, labels)
    texts = {i: t for i, t in texts.items() if model.score(quality_classifier.Rows.of([quality_classifier.features(t)]))[0] >= 0.7}
    texts = {i: texts[i] for i, c in brute_classes(sorted(texts.items())) if i == c}
    texts = plain_decontamination(texts, [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    real = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*real.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    got = corpus_pipeline.run(spark, DATA).toPandas()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.itertuples()) == sorted((i, at, len(x[at : at + 2048]), zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes())) for i, x in ids.items() for at in range(0, len(x), 2048))


def test_pipeline_of_odd_and_no_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    seen = odd.unionByName(odd.withColumn("text", F.concat(F.lit("The plain words of a text follow here, "), F.expr("array_join(transform(sequence(1, 300), x -> concat('w', x * (doc_id + 1) % 997)), ' ')"))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, DATA)
        assert seen.columns == odd.columns, name
        seen.write.parquet(str(tmp_path / name.replace(" ", "-")))
        seen = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
    assert set(corpus_pipeline.pack(spark, seen, DATA).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


