"""Streams in several batches equal the batch operators on the whole; a replay changes nothing."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from blogindex import schemas
from blogindex.operators import ingest, routing
from blogindex.plans import adapters as ad
from blogindex.plans import catalog
from blogindex.sources import lists, records
from blogindex.streaming import jobs
from blogindex.streaming.store import PageStore
from tests.conftest import DATA

NOW = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)


def _write(path, number, text):
    """A file whose time tells its place: a stream takes older files first."""
    path.write_text(text)
    os.utime(path, (1_700_000_000 + 60 * number,) * 2)


def _write_parts(df, path, parts):
    """One file per part, in order of seq."""
    rows = [json.loads(r) for r in df.orderBy("seq").toJSON().collect()]
    step = -(-len(rows) // parts)
    path.mkdir()
    for i in range(parts):
        text = "\n".join(json.dumps({**r, "seq": n}) for n, r in list(enumerate(rows))[i * step:(i + 1) * step])
        _write(path / f"{i}.json", i, text)


def test_index_stream(spark, tmp_path):
    _write_parts(ad.recrawls(spark, DATA), tmp_path / "in", 3)
    store = PageStore(spark, str(tmp_path / "store"))
    stream = records.stream_pages(spark, str(tmp_path / "in"), max_files=1)
    query = jobs.index_stream(stream, store, str(tmp_path / "cp"), now=lambda: NOW)
    query.awaitTermination()
    assert store.counts().count() == 3
    whole = spark.read.schema(schemas.PAGE + ", seq BIGINT").json(str(tmp_path / "in"))
    valid = ingest.validate(whole)
    statuses = ingest.full_status(valid, None)
    want = ingest.apply_upsert(ingest.indexed_page(valid, ad.as_of()), statuses, None, ad.as_of())
    columns = ["id", "url", "title", "content", "keywords", "content_hash", "word_count", "created_at"]
    assert sorted(map(str, store.pages().select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    totals = store.counts().agg(*[F.sum(c).alias(c) for c in ("processed", "inserted", "updated", "skipped", "errors")]).first()
    assert tuple(totals) == (240, 136, 57, 47, 0)
    assert store.daily_stats().first()["pages_processed"] == 240

    queries = ad.queries(spark, DATA)
    before = sorted(map(str, store.search(queries).collect()))
    # Replay of the last batch.
    last = spark.read.schema(schemas.PAGE + ", seq BIGINT").json(str(tmp_path / "in" / "2.json"))
    store.write_batch(last, 2, F.lit(NOW).cast("timestamp"))
    assert sorted(map(str, store.search(queries).collect())) == before
    assert store.counts().agg(F.sum("processed")).first()[0] == 240
    small = store.compact(str(tmp_path / "compact"))
    assert sorted(map(str, small.search(queries).collect())) == before
    assert small.pages().count() == 136
    # The last batch may run again after the compaction as well, with the same counts.
    small.write_batch(last, 2, F.lit(NOW).cast("timestamp"))
    assert sorted(map(str, small.search(queries).collect())) == before
    assert sorted(map(str, small.counts().drop("ms").collect())) == sorted(map(str, store.counts().drop("ms").collect()))
    # The compacted store takes further batches.
    small.write_batch(last, 3, F.lit(NOW).cast("timestamp"))
    assert small.counts().filter("batch_id = 3").first()["updated"] == 0


def test_second_checkpoint_adds_to_the_store(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "store"))
    pages = ad.doc_pages(spark, DATA)
    for number, rest in enumerate((0, 1)):
        _write_parts(pages.filter(F.col("doc_id") % 2 == rest), tmp_path / f"in{rest}", 1)
        stream = records.stream_pages(spark, str(tmp_path / f"in{rest}"), max_files=1)
        jobs.index_stream(stream, store, str(tmp_path / f"cp{rest}"), now=lambda: NOW).awaitTermination()
        assert store.counts().count() == number + 1
    accepted = ingest.validate(pages).filter(F.col("status") == ingest.ACCEPTED).count()
    assert store.pages().count() == accepted
    # A restart of the first stream finds its number again and has nothing left to do.
    stream = records.stream_pages(spark, str(tmp_path / "in0"), max_files=1)
    jobs.index_stream(stream, store, str(tmp_path / "cp0"), now=lambda: NOW).awaitTermination()
    assert store.counts().count() == 2 and store.pages().count() == accepted


def test_admission_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    parts = [[("http://a.org/", 0), ("http://b.org/", 4), ("http://a.org/", 1)], [("http://a.org/", 0), ("http://b.org/", 0), ("http://x.bad.org/", 0)],
             [("http://c.org/", 0), (":no", 0)]]
    for i, part in enumerate(parts):
        _write(src / f"{i}.json", i, "\n".join(json.dumps({"location": u, "retries": r, "seq": 0}) for u, r in part))
    stream = records.stream_frontier(spark, str(src), max_files=1)
    jobs.admission_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lambda s: lists.domain_table(s, ["bad.org"]),
                          lambda s: s.createDataFrame([("c.org",)], "domain STRING")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out" / "admitted")).select("batch_id", "location").collect()
    assert {tuple(r) for r in got} == {(0, "http://a.org/"), (1, "http://b.org/")}


def test_routing_stream(spark, tmp_path):
    _write_parts(ad.doc_pages(spark, DATA).withColumn("links", F.array("location")), tmp_path / "in", 2)

    def score(df):
        return df.withColumn("p_not", (F.length("title") % 100) / 100.0)

    stream = records.stream_pages(spark, str(tmp_path / "in"), max_files=1)
    jobs.routing_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), score, 0.8).awaitTermination()
    routed = routing.route(score(spark.read.schema(schemas.PAGE).json(str(tmp_path / "in"))), 0.8)
    for name, want in (("index", routing.index_pages(routed)), ("frontier", routing.route_outlinks(routed)),
                       ("blacklist", routing.blacklist_domains(routed))):
        got = spark.read.parquet(str(tmp_path / "out" / name))
        column = "domain" if name == "blacklist" else "location"
        rows = sorted(r[column] for r in got.select(column).collect())
        assert (sorted(set(rows)) if name == "blacklist" else rows) == sorted(r[column] for r in want.select(column).collect())


def test_admission_puts_failed_items_back(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    parts = [[("http://a.org/", 0, 5), ("http://a.org/", 1, 3), ("http://f.org/", 2, 6)], [("http://f.org/", 3, 7), ("http://v.org/", 0, 8), (None, 0, 9)],
             [("http://f.org/", 4, 10), ("http://a.org/", 0, 1)]]
    for i, part in enumerate(parts):
        _write(src / f"{i}.json", i, "\n".join(json.dumps({"location": u, "retries": r, "seq": s}) for u, r, s in part))
    seeds = records.stream_frontier(spark, str(src), max_files=1)
    visited = spark.createDataFrame([("http://v.org/",)], "location STRING")

    def check(items):
        return items.withColumn("check_failed", F.col("location").startswith("http://f") & (F.col("retries") < 3))

    runs = jobs.drain(lambda: jobs.admission_stream(
        jobs.frontier_queue(seeds, out), out, str(tmp_path / "cp"), lambda s: None, visited=visited, check=check))
    assert runs == 3
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/report").select("seq", "retries", "reason").collect())
    # Of one batch the smallest seq is first; an earlier batch comes before a smaller seq.
    assert got == [(1, 0, "visited"), (3, 1, "admitted"), (5, 0, "visited"), (6, 2, "requeued"), (6, 3, "visited"),
                   (7, 3, "admitted"), (8, 0, "visited"), (9, 0, "malformed"), (10, 4, "retries")]


def test_admission_refused_without_rocksdb(spark, tmp_path):
    (tmp_path / "in").mkdir()
    other = spark.newSession()
    other.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    items = records.stream_frontier(other, str(tmp_path / "in"))
    with pytest.raises(ValueError, match="RocksDB"):
        jobs.admission_stream(items, str(tmp_path / "out"), str(tmp_path / "cp"), lambda s: None)


def test_classifier_in_the_stream(spark, tmp_path):
    """Scores by the saved model in micro-batches equal the batch ones; rejected domains come out once."""
    got = catalog.QUERIES["stream_classify"](spark, DATA)
    want = catalog.QUERIES["classify_pages"](spark, DATA)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.filter("route = 'index'").collect()))


def test_rejected_domains_are_fed_back(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    page = dict.fromkeys(["title", "description", "author"], "") | {"keywords": [], "headings": [], "content": [], "script_links": [], "script_content": [], "created_at": 0}
    for i, hosts in enumerate((["good", "bad"], ["bad", "good"])):
        _write(src / f"{i}.json", i, "\n".join(json.dumps({**page, "location": f"http://{h}.org/{i}", "links": [f"http://{h}.org/next"]}) for h in hosts))

    def score(df):
        return df.withColumn("p_not", F.col("location").contains("bad").cast("double"))

    stream = records.stream_pages(spark, str(src), max_files=1)
    jobs.routing_stream(stream, out, str(tmp_path / "cp"), score, 0.9, skip_rejected=True).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{out}/blacklist").select("domain", "batch_id").collect()] == [("bad.org", 0)]
    assert [r[0] for r in jobs.rejected_domains(out)(spark).collect()] == ["bad.org"]
    assert sorted(r[0] for r in spark.read.parquet(f"{out}/index").select("location").collect()) == ["http://good.org/0", "http://good.org/1"]


def test_a_batch_opens_only_the_prefixes_of_its_addresses(spark, tmp_path):
    """What a second batch reads of the store does not grow with the addresses of other prefixes."""
    one = ad.doc_pages(spark, DATA).filter("doc_id = 5").select(*schemas.PAGE_COLUMNS, "seq")
    own = one.select(F.sha2("location", 256).alias("url_hash"))
    seen = []
    for name, rest in (("small", "doc_id < 20"), ("large", "true")):
        store = PageStore(spark, str(tmp_path / name))
        pages = ad.doc_pages(spark, DATA).filter(rest).select(*schemas.PAGE_COLUMNS, "seq")
        store.write_batch(pages, 0, F.lit(NOW).cast("timestamp"))
        log = spark.read.parquet(f"{store.root}/hashes")
        hashes = store.current_hashes(before=1, of=own)
        text = hashes._jdf.queryExecution().explainString(hashes._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "PartitionFilters" in text and "(prefix" in text
        prefix = own.first()["url_hash"][:1]
        seen.append(log.filter(F.col("prefix").cast("string") == prefix).select(F.input_file_name()).distinct().count())
        store.write_batch(one, 1, F.lit(NOW).cast("timestamp"))
        assert store.counts().filter("batch_id = 1").first()["skipped"] == 1
        assert store.current_hashes().count() == store.pages().count()
    assert seen[0] == seen[1] == 1
