"""Hand-derived cases for the rules the tables do not reach."""

import datetime as dt
import json
import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blogindex import schemas
from blogindex.functions import text as tx
from blogindex.functions import urls
from blogindex.functions.sql import register_functions
from blogindex.functions.stemming import stem
from blogindex.operators import (
    classify, domains, extract, features, frontier, index, ingest, present, routing, search, seeds, stats)
from blogindex.sources import lists, records, stores
from blogindex.streaming.store import PageStore


def values(spark, expr, rows, schema="x STRING"):
    df = spark.createDataFrame([(i, *r) if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)],
                               f"_i INT, {schema}")
    return [r[0] for r in df.orderBy("_i").select(expr.alias("v")).collect()]


HTML = [
    ('<p>a<a href="/x">b</a>c</p>', {"content": ["a"], "links": ["https://h.org/p/x"]}),
    ("<p>a<br>b<br/>c", {"content": ["a"]}),
    ("<p>a<br/>b", {"content": ["a", "b"]}),
    ("<p>a<!--x-->b", {"content": ["a", "b"]}),
    ("<h2> x </h2>tail<p>y", {"headings": ["x", "tail"], "content": ["y"]}),
    ("text<p>", {"content": [], "headings": []}),
    ("<title>A &amp; <b>B</b></title>", {"title": "A & <b>B</b>"}),
    ("<title>T</title><title>U</title>", {"title": "U"}),
    ('<meta name="description" content=" d ">', {"description": "d"}),
    ('<meta name="description" content="d"/>', {"description": None}),
    ('<meta name="Description" content="d">', {"description": None}),
    ('<meta name="author" content="x"><meta name="author" content="y">', {"author": "y"}),
    ('<meta name="keywords" content="a, b">', {"keywords": ["a", " b"]}),
    ('<script src="/s.js">v</script>', {"script_links": ["https://h.org/p/s.js"], "script_content": ["v"]}),
    ('<A HREF="/x">', {"links": ["https://h.org/p/x"]}),
    ("<script>if (a</p>b) 1 &amp; 2</script>", {"script_content": ["if (a</p>b) 1 &amp; 2"]}),
    ("<p>1 < 2 &lt; 3</p>", {"content": ["1 < 2 < 3"]}),
    ('<p>a<p class="x>y">b', {"content": ["a", "b"]}),
    ("<p>a<![x]>b<?y?>c</>d", {"content": ["a", "b", "c", "d"]}),
    ("<p>a<b", {"content": ["a"]}),
    ("<a href=/x?a=1&copy=2&amp;b=3>", {"links": ["https://h.org/p/x%3Fa=1&copy=2&b=3"]}),
    ("<style>p{}</style><p>x\r\ny", {"content": ["x\ny"]}),
    ("<textarea><p>no</textarea><p>yes", {"content": ["yes"]}),
]


def test_html(spark):
    rows = [(i, "https://h.org/p", h) for i, (h, _) in enumerate(HTML)]
    df = spark.createDataFrame(rows, "page_id INT, url STRING, html STRING")
    out = {r["page_id"]: r for r in extract.extract_pages(df).collect()}
    for i, (html, want) in enumerate(HTML):
        for field, value in want.items():
            assert out[i][field] == value, (html, field)


def test_links(spark):
    base = "https://h.org/a/b?q=1#f"
    cases = {
        "/c": "https://h.org/a/b/c?q=1#f", "../c": "https://h.org/a/c?q=1#f", "c/": "https://h.org/a/b/c/?q=1#f",
        "": "https://h.org/a/b?q=1#f", "#top": "https://h.org/a/b/%23top?q=1#f", "?p=2": "https://h.org/a/b/%3Fp=2?q=1#f",
        "//cdn.org/j.js": "//cdn.org/j.js", " http://O.org/Z ": "http://O.org/Z", "HTTP://O.org/a b": "http://O.org/a%20b",
        "für": "https://h.org/a/b/f%C3%BCr?q=1#f", "a%2fb": "https://h.org/a/b/a%2fb?q=1#f",
        "a+b*c~": "https://h.org/a/b/a+b*c~?q=1#f", "a b*": "https://h.org/a/b/a%20b%2A?q=1#f", "%zz": None, ":x": None, "mailto:x@y.z": "https://h.org/a/b/mailto:x@y.z?q=1#f",
    }
    got = values(spark, urls.normalize_link(F.lit(base), F.col("x")), list(cases))
    assert got == list(cases.values())
    register_functions(spark)
    assert values(spark, F.expr(f"normalize_link('{base}', x)"), list(cases)) == list(cases.values())
    resolved = {
        "/c": "https://h.org/c", "../c": "https://h.org/c", "c/": "https://h.org/a/c/", "": "https://h.org/a/b?q=1",
        "#t": "https://h.org/a/b?q=1#t", "?p=2": "https://h.org/a/b?p=2", "//o.org/j": "https://o.org/j", "..": "https://h.org/",
    }
    got = values(spark, urls.normalize_link(F.lit(base), F.col("x"), "rfc3986"), list(resolved))
    assert got == list(resolved.values())


def test_hosts(spark):
    cases = ["https://u:p@A.org:80/x", "http://[::1]:8/x", "//h.org/x", "mailto:x", "http://a_b.org?q"]
    assert values(spark, urls.hostname(F.col("x")), cases) == ["A.org", "::1", "h.org", "", "a_b.org"]
    assert values(spark, urls.netloc(F.col("x")), cases) == ["u:p@A.org:80", "[::1]:8", "", "", "a_b.org"]
    assert values(spark, urls.domain(F.col("x")), ["https://a.org:1?x", "HTTP://b/c"]) == ["a.org:1?x", "HTTP:"]


def test_domain_filter(spark):
    listed = lists.domain_table(spark, ["Example.com", "b.c.org", "io"])
    hosts = ["example.com", "SUB.example.com", "a.b.c.org", "io", "c.org", "x.io"]
    df = spark.createDataFrame([(f"http://{h}/",) for h in hosts] + [("nohost",)], "url STRING")
    passed = {r["url"] for r in domains.block_domains(df, listed).collect()}
    assert passed == {"http://c.org/", "http://x.io/", "nohost"}


def test_dynamic_blacklist_keys(spark):
    df = spark.createDataFrame([("http://a.org:80/x",), ("http://B.org/",)], "url STRING")
    black = spark.createDataFrame([("a.org:80",), ("b.org",)], "domain STRING")
    assert domains.drop_blacklisted(df, black).count() == 2
    assert domains.drop_blacklisted(df, black, key="hostname").count() == 0
    assert domains.drop_blacklisted(df, None).count() == 2


def test_seeds(spark, tmp_path):
    df = spark.createDataFrame([("https://blog.a.org/x",), ("",)], "seed STRING")
    got = [r["candidate"] for r in seeds.seed_candidates(df).orderBy("ord").collect()]
    assert got == ["https://blog.a.org/x", "https://blog.a.org", "https://a.org",
                   "http://blog.a.org/x", "http://blog.a.org", "http://a.org"]
    path = tmp_path / "seeds.txt"
    path.write_text("https://a.org\n\n:bad\n")
    assert [r[1] for r in lists.read_seeds(spark, str(path), "drop").orderBy("seq").collect()] == ["https://a.org", ""]
    with pytest.raises(Exception, match="no URL"):
        lists.read_seeds(spark, str(path)).collect()
    (tmp_path / "d.txt").write_text("A.org \na.ORG \nb\n")
    assert {r[0] for r in lists.read_domain_list(spark, str(tmp_path / "d.txt")).collect()} == {"a.org ", "b"}
    assert lists.read_domain_list(spark, "").count() == 0


def test_tokens(spark):
    assert values(spark, tx.tokens(F.col("x")), ["Café foo42 Rust's Tokio async-std _rust abcd5 abcd"]) == [
        ["rust", "tokio", "async", "abcd"]]


def test_ngrams_and_stop_words(spark):
    toks = tx.remove_stop_words(F.split("x", " "), ["with"])
    assert values(spark, tx.ngrams(toks, 1, 3), ["alpha with beta", "one"]) == [["alpha", "beta", "alpha beta"], ["one"]]


def test_dictionary_prefix(spark):
    docs = spark.createDataFrame([(1, ["rust", "rusty", "tokio"])], "id INT, tokens ARRAY<STRING>")
    words = spark.createDataFrame([("rust",), ("tokio",)], "word STRING")
    got = features.filter_dictionary(docs, words, "id").collect()
    assert [(r["pos"], r["token"]) for r in got] == [(1, "rusty")]


def test_routing(spark):
    cases = [(.9, .95, "blacklist"), (.9, .9, "blacklist"), (.9, .5, "index"), (.9, .51, "follow"), (.4, .45, "blacklist")]
    df = spark.createDataFrame(cases, "t DOUBLE, p DOUBLE, want STRING")
    for t, _, _ in cases:
        got = df.filter(F.col("t") == t).select(routing.route_of(F.col("p"), t).alias("r"), "want").collect()
        assert all(r["r"] == r["want"] for r in got)


def test_word_count(spark):
    cases = {None: 0, "": 0, "a b": 2, "a, b": 3, " a": 2, "a\nb": 1, "don't": 2, "a, b  c.": 6}
    assert values(spark, tx.word_count(F.col("x")), list(cases)) == list(cases.values())


def test_hash_and_validation(spark):
    one_space = values(spark, F.sha2(F.lit(" "), 256), ["x"])[0]
    assert values(spark, tx.content_hash(F.lit(None).cast("string"), F.col("x")), ["", "  \t", None]) == [one_space] * 3
    long = {"ftp://x": "error", "HTTP://x": "error", None: "error", "http://x": "accepted"}
    rows = [(loc, None, "T", None, ["a" * 100]) for loc in long]
    sizes = {99: "skipped", 100: "accepted", 50_000: "accepted", 50_001: "skipped"}
    rows += [("http://x", None, None, None, ["a" * n]) for n in sizes]
    rows += [("http://x", None, "", None, [" " * 100]), ("http://x", None, "T", None, [" " * 100]),
             ("http://x", "a" * 513, "T", None, ["a" * 100]), ("http://" + "d" * 256, None, "T", None, ["a" * 100]),
             ("http://x/" + "u" * 2048, None, "T", None, ["a" * 99])]
    want = [*long.values(), *sizes.values(), "skipped", "accepted", "error", "error", "skipped"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "i INT, location STRING, author STRING, title STRING, description STRING, content ARRAY<STRING>")
    assert [r["status"] for r in ingest.validate(df).orderBy("i").collect()] == want


def test_created_at_units(spark):
    df = spark.createDataFrame([(1, "http://x", 1_700_000_000_123), (2, "http://x", 0), (3, "http://x", None)],
                               "seq INT, location STRING, created_at BIGINT")
    for c in ("title", "author", "description", "text"):
        df = df.withColumn(c, F.lit("t"))
    for c in ("headings", "keywords", "links", "script_links"):
        df = df.withColumn(c, F.array(F.lit("t")))
    as_of = F.lit("1970-01-01 00:01:00").cast("timestamp")
    got = [r["created_at"] for r in ingest.indexed_page(df, as_of, "ms").orderBy("seq").collect()]
    assert got == [1_700_000_000, 60, 60]


def test_snippet(spark):
    cases = {"aaaa bbbb cccc": "aaaa bbbb...", "short": "short", "abcdefghijklm": "...", None: "", "  a\tb  ": "a\tb"}
    assert values(spark, tx.snippet(F.col("x"), 10), list(cases)) == list(cases.values())


def test_paging_and_window(spark):
    totals = spark.createDataFrame([(20,)], "total BIGINT")
    row = search.paging(totals, 2, 10).first()
    assert (row["has_next"], row["has_prev"]) == (False, True)
    df = spark.createDataFrame([(95, p, 10) for p in (5, 4, 3)] + [(10, 1, 10)], "total BIGINT, page INT, per_page INT")
    got = {(r["total"], r["page"]): r for r in present.page_window(df).collect()}
    assert [got[95, p]["window"] for p in (5, 4, 3)] == ["3 4 5 6 7", "2 3 4 5 6", "1 2 3 4 5"]
    assert [(got[95, p]["first"], got[95, p]["gap_before"]) for p in (5, 4, 3)] == [(True, True), (True, False), (False, False)]
    assert all(got[95, p]["last"] and got[95, p]["gap_after"] for p in (5, 4, 3))
    assert got[10, 1]["window"] is None
    assert present.shown_range(df.filter("page = 1")).first()["shown_to"] == 10


def _pages(spark, rows):
    """rows: (id, title, content)"""
    df = spark.createDataFrame(rows, "id STRING, title STRING, content STRING")
    return df.select("id", F.concat(F.lit("http://x/"), "id").alias("url"), "title",
                     F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("author"),
                     F.expr("cast(array() as array<string>)").alias("headings"), "content",
                     F.expr("cast(array() as array<string>)").alias("keywords"), F.lit("x").alias("domain"),
                     F.size(F.split("content", " ")).alias("word_count"), F.lit(0).cast("bigint").alias("created_at"))


def test_english_rank(spark):
    pages = _pages(spark, [("1", "Spark joins", "joins in spark"), ("2", "other", "joining sparks"), ("3", "none", "")])
    vectors = {(r["lexeme"], r["pos"], r["weight"]) for r in
               index.document_vectors(pages, config="english").filter("id = '1'").collect()}
    assert vectors == {("spark", 1, "A"), ("join", 2, "A"), ("join", 3, "C"), ("spark", 5, "C")}
    postings = index.build_postings(pages, config="english")
    queries = spark.createDataFrame([(1, "spark joins"), (2, "the of"), (3, "spark")], "query_id BIGINT, q STRING")
    got = {(r["query_id"], r["id"]): r["rank"] for r in search.search(postings, pages, queries, config="english").collect()}
    assert got.keys() == {(1, "1"), (1, "2"), (3, "1"), (3, "2")}
    assert math.isclose(got[1, "1"], 1.1) and math.isclose(got[3, "1"], 1.2)
    totals = {r["query_id"]: r["total"] for r in search.search_totals(postings, pages, queries, "english").collect()}
    assert totals == {1: 2, 2: 0, 3: 2}


def test_position_caps(spark):
    pages = _pages(spark, [("1", "t", " ".join(["spam"] * 300 + ["x"] * 16_200 + ["egg"] * 3))])
    got = {r["lexeme"]: r["positions"] for r in index.build_postings(pages, position_limits=True).collect()}
    assert len(got["spam"]) == 256 and [p["pos"] for p in got["egg"]] == [16_383]
    whole = {r["lexeme"]: r["positions"] for r in index.build_postings(pages).collect()}
    assert len(whole["spam"]) == 300 and [p["pos"] for p in whole["egg"]] == [16_502, 16_503, 16_504]


def test_filters_off(spark):
    pages = _pages(spark, [("1", "spark", "a b")])
    postings = index.build_postings(pages)
    queries = spark.createDataFrame([(1, "spark")], "query_id BIGINT, q STRING")
    assert search.search(postings, pages, queries, domain="", min_words=0).count() == 1
    assert search.search(postings, pages, queries, min_words=3).count() == 0
    with pytest.raises(ValueError):
        search.search(postings, pages, queries, per_page=101)


def test_stems():
    # Published sample pairs of the algorithm.
    pairs = {
        "consign": "consign", "consigned": "consign", "consignment": "consign", "consistency": "consist",
        "consolation": "consol", "conspicuously": "conspicu", "knightly": "knight", "kneeling": "kneel",
        "knots": "knot", "generously": "generous", "communication": "communic", "dying": "die", "skies": "sky",
        "hopping": "hop", "hoping": "hope", "happily": "happili", "relational": "relat", "agreed": "agre",
        "joins": "join", "news": "news", "succeed": "succeed", "say": "say", "cry": "cri", "by": "by",
    }
    assert {w: stem(w) for w in pairs} == pairs


def test_stems_by_expressions(spark):
    """The rules as column expressions give what the function gives, on words that meet every rule."""
    from blogindex.functions import stemming
    heads = ["", "a", "by", "hop", "hopp", "gener", "commun", "arsen", "sky", "tri", "bead", "relat", "vil", "ey", "yy", "sayY", "über", "conspic", "succ"]
    ends = ["", "s", "es", "ies", "ied", "sses", "us", "ss", "y", "ly", "e", "ll", "eed", "eedly", "ed", "edly", "ing", "ingly", *stemming._STEP2, *stemming._STEP3,
            *stemming._STEP4, "logi", "sion", "tion", "atted", "bling", "izing"]
    words = sorted({(h + e).lower() for h in heads for e in ends} | set(stemming._WHOLE) | set(stemming._AFTER_1A) - {""})
    rows = spark.createDataFrame([(w,) for w in words if w], "word STRING")
    got = {r["word"]: r["stem"] for r in stemming.stem_vocabulary(rows).collect()}
    assert got == {w: stem(w) for w in words if w}


def test_json_records(spark):
    rows = ['{"location":"u","retries":2}', '{"location":"u"', '{"retries":null}']
    df = spark.createDataFrame([(r,) for r in rows], "value STRING")
    assert [(r[0], r[1]) for r in records.parse_frontier(df).collect()] == [("u", 2), ("", 0)]
    typed = [
        ({"location": "http://x", "content": "one", "keywords": None}, False), ({"location": 5}, True), ({"title": "x"}, True),
        ({"location": "http://x", "title": 3}, True), ({"location": "http://x", "links": "a"}, True),
        ({"location": "http://x", "links": ""}, False), ({"location": "http://x", "headings": ["a", None]}, True),
        ({"location": "http://x", "created_at": 12}, False), ({"location": "http://x", "created_at": 1.5}, True),
        ({"location": "http://x", "content": ["a", "b"], "links": []}, False), ({"location": "http://x", "keywords": 0}, False),
    ]
    df = spark.createDataFrame([(i, json.dumps(t[0])) for i, t in enumerate(typed)] + [(99, "[1]"), (98, "{")], "i INT, value STRING")
    got = {r["i"]: r for r in records.parse_typed_pages(df).collect()}
    assert set(got) == set(range(len(typed)))
    assert [got[i]["type_error"] for i in range(len(typed))] == [t[1] for t in typed]
    assert got[0]["content"] == ["one"] and got[0]["keywords"] == []


def test_page_json_and_store(spark, tmp_path):
    page = spark.createDataFrame([("T", None, None, None, ["h"], ["c"], ["l"], [], [], "http://A.org:1/x", 1_700_000_000)], schemas.PAGE)
    record = json.loads(stores.page_json(page).first()[0])
    assert list(record) == schemas.PAGE_COLUMNS
    assert record["keywords"] is None and record["author"] == "" and record["created_at"] == 1_700_000_000_000
    stores.write_pages_json(page, str(tmp_path / "json"))
    assert records.parse_pages(spark.read.text(str(tmp_path / "json")), missing_text="").count() == 1
    stores.store_pages(page, str(tmp_path / "store"))
    ids = page.select(stores.uuid_from_hash(F.sha2("location", 256)).alias("id"))
    assert stores.lookup_pages(spark, str(tmp_path / "store"), ids).first()["host"] == "A.org"
    stores.append_stage(page, str(tmp_path / "next"))
    stores.append_stage(page, str(tmp_path / "next"))
    assert spark.read.schema(schemas.PAGE).json(str(tmp_path / "next")).count() == 2


def test_corpus(spark, tmp_path):
    for root, names in (("pos", ["a", "b"]), ("neg", ["c"])):
        for n in names:
            (tmp_path / root / n).mkdir(parents=True)
            (tmp_path / root / n / "1.json").write_text(json.dumps({"title": n, "content": ["x"]}, indent=1))
            (tmp_path / root / n / "skip.txt").write_text("no")
    got = records.read_corpus(spark, str(tmp_path / "pos"), str(tmp_path / "neg"))
    assert sorted((r["title"], r["label"]) for r in got.collect()) == [("a", 1.0), ("b", 1.0), ("c", 0.0)]


def test_running_mean_golden(spark):
    cases = {1: [10, 20, 40], 2: [10, None, 20], 3: [None, 20], 4: [None]}
    rows = [(dt.date(2024, 1, d), i, None if x is None else float(x)) for d, xs in cases.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "date DATE, batch BIGINT, ms DOUBLE").withColumn("ms", F.col("ms").cast("decimal(10,2)"))
    got = {r["date"].day: r["mean"] for r in stats.running_mean(df).collect()}
    assert {k: None if v is None else float(v) for k, v in got.items()} == {1: 27.5, 2: 15.0, 3: 10.0, 4: None}


def test_stats_for_missing_day(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5, 1, 1, 1, 2, 10.0)],
                                 "batch BIGINT, date DATE, processed INT, inserted INT, updated INT, skipped INT, errors INT, ms DOUBLE")
    table = stats.update_daily_stats(None, rows)
    row = stats.stats_for(table, dt.date(2024, 1, 2)).first()
    assert row["pages_processed"] == 0 and row["avg_processing_time_ms"] is None
    again = stats.update_daily_stats(table, rows.withColumn("ms", F.lit(20.0))).first()
    assert again["pages_processed"] == 10 and float(again["avg_processing_time_ms"]) == 15.0


def test_frontier_rules(spark):
    empty = spark.createDataFrame([], "location STRING, retries INT")
    seed = spark.createDataFrame([("a",)], "location STRING")
    assert frontier.seed_frontier(empty, seed).collect() == [("a", 0)]
    full = spark.createDataFrame([("b", 2)], "location STRING, retries INT")
    assert frontier.seed_frontier(full, seed).collect() == [("b", 2)]
    failed = spark.createDataFrame([("b", 2, 1, True), ("c", 0, 2, False)], "location STRING, retries INT, seq INT, check_failed BOOLEAN")
    assert frontier.requeue_failed(failed).collect() == [("b", 3, 1)]


def test_crawl_waves_with_route(spark):
    graph = {"http://a.org/": ["http://b.org/", "http://c.org/"], "http://b.org/": ["http://d.org/", "http://c.org/2"],
             "http://c.org/": ["http://e.org/", "http://b.org/3"], "http://d.org/": None, "http://b.org/3": ["http://f.org/"]}
    pages = spark.createDataFrame(list(graph.items()), "location STRING, links ARRAY<STRING>")
    seed = spark.createDataFrame([("http://a.org/", 7), ("http://a.org/", 3)], "location STRING, seq BIGINT")
    waves = frontier.crawl_waves(seed, pages)
    assert [(r["location"], r["wave"]) for r in waves.orderBy("seq").collect()] == [
        ("http://a.org/", 0), ("http://b.org/", 1), ("http://c.org/", 1), ("http://d.org/", 2), ("http://c.org/2", 2),
        ("http://e.org/", 2), ("http://b.org/3", 2), ("http://f.org/", 3)]

    def reject_b(fetched):
        bad = fetched.filter(F.col("location") == "http://b.org/")
        return (fetched.filter(F.col("location") != "http://b.org/"), bad.select(urls.netloc(F.col("location")).alias("domain")))

    routed = frontier.crawl_waves(seed, pages, route=reject_b)
    # b.org is rejected in wave 1, so its later page is admitted but not fetched.
    assert [r["location"] for r in routed.orderBy("seq").collect()] == [
        "http://a.org/", "http://b.org/", "http://c.org/", "http://e.org/", "http://b.org/3"]


def test_sql_functions(spark):
    assert set(register_functions(spark)) >= {"extract_domain", "word_count", "hostname", "netloc", "content_hash", "snippet"}
    row = spark.sql("""SELECT extract_domain('https://a.org:1/x') d, word_count('a, b  c.') w, hostname('http://u@H.org:8/') h,
        netloc('http://u@H.org:8/') n, content_hash(' T ', NULL) c, snippet(' a ') s""").first()
    assert tuple(row)[:4] == ("a.org:1", 6, "H.org", "u@H.org:8") and row["s"] == "a"
    want = spark.range(1).select(tx.content_hash(F.lit(" T "), F.lit(None).cast("string"))).first()[0]
    assert row["c"] == want


def test_report_without_predictions(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label INT, prediction INT")
    got = {r["name"]: r for r in classify.classification_report(df).collect()}
    assert got["1"]["precision"] == 0.0 and got["accuracy"]["f1"] == 0.5


def test_model_round_trip(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, ["rust", "code", "blog"] if i % 2 else ["shop", "sale", "price"], float(i % 2)) for i in range(40)],
        "doc_id BIGINT, tokens ARRAY<STRING>, label DOUBLE")
    path = str(tmp_path / "model")
    with pytest.raises(Exception):
        classify.load_model(path)
    model = classify.load_or_train(path, lambda: docs, "doc_id", stop_words=[])
    for fitted in (model, classify.load_or_train(path, None, "doc_id")):
        rows = classify.score(docs, fitted, []).collect()
        assert all((r["p_dev"] > 0.5) == (r["label"] == 1.0) and math.isclose(r["p_dev"] + r["p_not"], 1) for r in rows)


def test_store_needs_content(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "none"))
    assert store.pages() is None and store.daily_stats() is None
    with pytest.raises(ValueError):
        store.search(spark.createDataFrame([(1, "x")], "query_id BIGINT, q STRING"))


def test_seeds_are_numbered_by_file_and_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("http://a.org/0\n")
    (tmp_path / "b.txt").write_text("".join(f"http://b.org/{i}\n" for i in range(50)))
    rows = lists.read_seeds(spark, str(tmp_path)).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == list(enumerate(["http://a.org/0", *[f"http://b.org/{i}" for i in range(50)]]))


@pytest.mark.parametrize("use", [lambda df: df.count(), lambda df: df.select("seq").collect(), lambda df: df.collect()])
def test_bad_seed_fails_whatever_is_read(spark, tmp_path, use):
    (tmp_path / "a.txt").write_text("http://a.org/\n:no\n")
    with pytest.raises(Exception, match="seed line is no URL"):
        use(lists.read_seeds(spark, str(tmp_path)))


def test_crawl_ends_when_the_frontier_is_empty(spark):
    from blogindex.operators import frontier
    pages = spark.createDataFrame([(f"http://a.org/{i}", [f"http://a.org/{i + 1}"]) for i in range(5)], "location string, links array<string>")
    seeds = spark.createDataFrame([("http://a.org/0", 0)], "location string, seq bigint")
    got = frontier.crawl_waves(seeds, pages).collect()
    assert sorted((r.wave, r.location) for r in got) == [(i, f"http://a.org/{i}") for i in range(6)]
    assert frontier.crawl_waves(seeds, pages, max_waves=6).count() == 6
    with pytest.raises(RuntimeError, match="1 locations are left after 3 waves"):
        frontier.crawl_waves(seeds, pages, max_waves=3)
    assert frontier.crawl_waves(seeds.limit(0), pages).count() == 0


def test_model_that_cannot_be_read_is_not_replaced(spark, tmp_path):
    (tmp_path / "model").mkdir()
    with pytest.raises(Exception):
        classify.load_or_train(str(tmp_path / "model"), lambda: pytest.fail("trained"), "doc_id")


def test_corpus_leaves_out_blank_pages(spark, tmp_path):
    for kind, texts in (("yes", ["about code", " \t "]), ("no", ["shop", ""])):
        for i, text in enumerate(texts):
            folder = tmp_path / kind / f"site{i}"
            folder.mkdir(parents=True)
            (folder / "a.json").write_text(json.dumps({"location": f"http://{kind}{i}.org/", "content": [text]}, indent=1))
    got = records.read_corpus(spark, str(tmp_path / "yes"), str(tmp_path / "no")).select("location", "label").collect()
    assert sorted(map(tuple, got)) == [("http://no0.org/", 0.0), ("http://yes0.org/", 1.0)]


def test_running_totals_over_many_runs(spark):
    rows = spark.range(5000).select(F.col("id").alias("batch"), (F.col("id") % 7).alias("v"))
    got = {r.batch: r.v for r in stats.running_totals(rows, "batch", ["v"], span=2).collect()}
    total = 0
    for i in range(5000):
        total += i % 7
        assert got[i] == total


def test_pages_are_walked_in_slices():
    pages = [f"<title>{i}</title><a href='/{i}'>" for i in range(450)] + [None]
    out = list(extract.raw_fields.func(iter([pa.array(pages), pa.array([], pa.string())])))
    assert max(map(len, out)) <= 200 < sum(map(len, out)) == 451
    rows = [r for part in out for r in part.to_pylist()]
    assert [(r["title"], r["hrefs"]) for r in rows] == [*[(str(i), [f"/{i}"]) for i in range(450)], (None, [])]


def test_only_pressed_positions_are_compared(spark):
    """Without limits positions differ by themselves; with them those at the limit are kept once, the first 256 of a word."""
    words = ["a", "b"] * 9_000 + ["c"] * 300
    row = ("u", "a b", None, ["b"], " ".join(words), ["a", "z"])
    df = spark.createDataFrame([row], "id STRING, title STRING, description STRING, headings ARRAY<STRING>, content STRING, keywords ARRAY<STRING>")

    def rows(limits):
        return {r["lexeme"]: [(p["pos"], p["w"]) for p in r["positions"]] for r in index.build_postings(df, position_limits=limits).collect()}

    every, pressed, want = rows(False), rows(True), {}
    for pos, (word, letter) in enumerate([("a", "A"), ("b", "A"), ("b", "B"), *[(w, "C") for w in words], ("a", "D"), ("z", "D")], 1):
        want.setdefault(word, []).append((pos, letter))
    assert every == want
    assert pressed["c"] == [(16_383, "C")] and pressed["z"] == [(16_383, "D")]
    assert all(pressed[w] == want[w][:256] for w in "ab")
    plans = [index.build_postings(df, position_limits=limits)._jdf.queryExecution().optimizedPlan().toString() for limits in (False, True)]
    assert plans[0].count("filter(") < plans[1].count("filter(")
