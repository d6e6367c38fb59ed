"""What the physical plans must and must not hold."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from blogindex.operators import features, frontier, index, search
from blogindex.plans import adapters as ad
from blogindex.plans import catalog
from blogindex.sources import stores
from tests.conftest import DATA

PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups")
# Extraction and the stemmer are the only Python steps.
WITH_PYTHON = {n for n in catalog.QUERIES if n.startswith("extract_")} | {"assemble_page", "search_english"}
# Queries that run streams, files or model fits while they are built.
SKIP = {"train_classifier", "classify_pages", "crawl_waves", "store_lookup", "read_corpus", "read_seeds",
        "stream_admission", "stream_admission_report", "stream_route", "stream_classify", "stream_chain", "stream_index", "stream_search", "stream_counts", "stream_daily_stats",
        "stream_replay"}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_no_python_and_no_cross_product(spark, monkeypatch):
    # The index as part of the plan, not read back from files; the vocabulary without counting it.
    monkeypatch.setattr(catalog, "_postings", lambda s, d, config="simple": index.build_postings(ad.indexed_docs(s, d), config=config))
    monkeypatch.setattr(catalog, "_stored_tokens", catalog._doc_tokens)
    terms = spark.createDataFrame([("that", 9, 12), ("with that", 3, 4)], "term STRING, df BIGINT, total BIGINT")
    monkeypatch.setattr(catalog, "_vocabulary", lambda docs: terms)
    for name, fn in catalog.QUERIES.items():
        if name in SKIP:
            continue
        text = plan(fn(spark, DATA))
        if name not in WITH_PYTHON:
            assert not any(node in text for node in PYTHON_NODES), name
        assert "CartesianProduct" not in text, name


def test_postings_are_map_only(spark):
    pages = ad.indexed_docs(spark, DATA)
    before, after = plan(pages).count("Exchange ("), plan(index.build_postings(pages)).count("Exchange (")
    assert before == after


def test_ranking_keeps_top_rows_per_task(spark):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["search_ranked"](spark, DATA))


def test_single_search_takes_ordered(spark):
    pages = ad.indexed_docs(spark, DATA)
    assert "TakeOrderedAndProject" in plan(search.search_pages(index.build_postings(pages), pages, "the with"))


def test_lookup_reaches_the_scan(spark, tmp_path):
    pages = ad.indexed_docs(spark, DATA)
    path = str(tmp_path / "postings")
    index.cluster_postings(index.build_postings(pages), path)
    parsed = search.parse_queries(ad.queries(spark, DATA).filter("query_id < 2000000"))
    text = plan(search.lookup(spark.read.parquet(path), parsed))
    assert "PushedFilters: [In(lexeme" in text


def test_no_positions_before_all_words_are_found(spark, tmp_path):
    path = str(tmp_path / "postings")
    index.write_postings(index.build_postings(ad.indexed_docs(spark, DATA)), path)
    postings, parsed = spark.read.parquet(path), search.parse_queries(ad.queries(spark, DATA))
    assert "positions:array" not in plan(search.match_pages(postings, parsed))
    # The whole search reads them in one scan, behind the join to the pages that are left.
    text = plan(search.match(postings, parsed))
    assert text.count("ReadSchema: struct<lexeme:string,id:string,positions") == 1


def test_a_wave_does_not_move_the_visited_set(spark):
    visited = frontier.VisitedTable(spark, 4)
    rows = spark.createDataFrame([(f"http://a.org/{i}", i) for i in range(50)], "location STRING, seq BIGINT")
    visited.append(rows, 0)
    visited.append(rows.selectExpr("concat(location, 'x') AS location", "seq"), 1)
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wave = [*((f"http://a.org/{i}", i) for i in range(50)), ("http://b.org/", 50)]
        left = visited.unseen(spark.createDataFrame(wave, rows.schema))
        text = plan(left)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    # One exchange, that of the wave.
    assert text[:text.index("(1) ")].count("Exchange") == 1 and "Bucketed: true" in text
    assert [r.location for r in left.collect()] == ["http://b.org/"]
    assert visited.close().count() == 100


def test_lookup_opens_only_the_folders_of_its_pages(spark, tmp_path):
    root = str(tmp_path / "store")
    pages = ad.doc_pages(spark, DATA).drop("doc_id", "seq")
    stores.store_pages(pages, root, rows_per_file=3)
    one = pages.limit(1).select(stores.uuid_from_hash(F.sha2("location", 256)).alias("id"))
    found = stores.lookup_pages(spark, root, one)
    assert re.search(r"PartitionFilters: \[.*concat_ws", plan(found))
    assert found.count() == 1
    host = found.first()["host"]
    # A host has as many files as its rows need.
    rows = pages.filter(F.col("location").contains(f"//{host}/")).count()
    stored = spark.read.schema("id STRING, host STRING, slot INT").json(root).filter(F.col("host") == host)
    assert 1 < stored.select(F.input_file_name()).distinct().count() <= -(-rows // 3)


def test_stop_words_are_filtered_once(spark):
    kept = features.with_ngrams(spark.createDataFrame([(1, ["a", "b"])], "doc_id INT, tokens ARRAY<STRING>"), ["a"])
    text = plan(kept)
    assert text.count("filter(tokens") == 1


def test_each_page_is_walked_once(spark):
    for name in ("extract_links", "extract_headings", "extract_content", "extract_script_text", "assemble_page"):
        text = plan(catalog.QUERIES[name](spark, DATA))
        tree = text[:text.index("(1) Scan")]
        assert tree.count("ArrowEvalPython (") == 1, name


def test_scans_read_few_columns(spark):
    text = plan(catalog.QUERIES["block_domains"](spark, DATA))
    assert "html" not in text
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


def test_filters_on_stored_pages_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages = ad.indexed_docs(spark, DATA)
    pages.write.parquet(path)
    stored = spark.read.parquet(path)
    hits = search.ranked_hits(index.build_postings(pages), stored, ad.queries(spark, DATA),
                              domain="src3.example.com", min_words=10)
    text = plan(hits)
    assert "EqualTo(domain,src3.example.com)" in text and "GreaterThanOrEqual(word_count,10)" in text
    assert hits.select(F.count("*")).first()[0] >= 0
