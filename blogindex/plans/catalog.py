"""Named queries over the given tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blogindex import schemas
from blogindex.functions import stemming
from blogindex.functions import text as tx
from blogindex.functions import urls
from blogindex.functions.sql import register_functions
from blogindex.functions.stopwords import ENGLISH_STOP_WORDS
from blogindex.operators import (
    classify, domains, extract, features, frontier, index, ingest, present, routing, search,
    seeds, stats)
from blogindex.plans import adapters as ad
from blogindex.session import new_work_dir, work_root
from blogindex.sources import lists, records, stores
from blogindex.streaming import jobs
from blogindex.streaming.admission import with_rocksdb
from blogindex.streaming.store import PageStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

THRESHOLD = 0.55
LINK_SHAPES = ["/c", "../c", "c/", "", "#top", "?p=2", "//cdn.org/j.js", " http://O.org/Z "]
# Recrawls number up to one per document; a small span makes hot addresses cross chunks.
SPAN = 256


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- sources and sinks

def _raw_frontier(spark, d):
    """Frontier JSON of all page addresses; those in French paths are cut off."""
    item = F.to_json(F.struct(F.col("url").alias("location"), (F.col("page_id") % 5).cast("int").alias("retries")))
    broken = F.col("url").contains("/fr/")
    return ad.table(spark, d, "pages").select(
        "page_id", F.when(broken, F.expr("left(url, 9)")).otherwise(item).alias("value"))


@query
def parse_frontier(spark, d):
    return records.parse_frontier(_raw_frontier(spark, d))


def _raw_pages_json(spark, d):
    record = F.to_json(F.struct(*schemas.PAGE_COLUMNS))
    cut = F.element_at("keywords", 1) == "fr"
    return ad.doc_pages(spark, d).select(
        "doc_id", F.when(cut, F.substring(record, 2, 40)).otherwise(record).alias("value"))


def _page_digest(pages):
    return pages.select(
        "doc_id", "title", F.coalesce("author", F.lit("<null>")).alias("author"),
        F.size("content").cast("bigint").alias("lines"), F.size("links").cast("bigint").alias("links"),
        F.md5(tx.content_text(F.col("content"))).alias("digest"), "created_at")


@query
def parse_pages(spark, d):
    return _page_digest(records.parse_pages(_raw_pages_json(spark, d)))


@query
def parse_pages_router(spark, d):
    return _page_digest(records.parse_pages(_raw_pages_json(spark, d), missing_text=""))


@query
def rejected_pages(spark, d):
    return records.split_pages(_raw_pages_json(spark, d))[1].select("doc_id", "value")


@query
def typed_pages(spark, d):
    """Page JSON with content as one string, and a wrong type in the keywords of some sources."""
    whole = F.array_join("content", "\n")
    keywords = F.when(F.element_at("keywords", 2) == "src1", F.lit("7")) \
        .otherwise(F.to_json("keywords"))
    value = F.concat(F.lit('{"location":'), F.to_json(F.array("location")).substr(F.lit(2), F.length(F.to_json(F.array("location"))) - 2),
                     F.lit(',"content":'), F.to_json(F.array(whole)).substr(F.lit(2), F.length(F.to_json(F.array(whole))) - 2),
                     F.lit(',"keywords":'), keywords, F.lit(',"links":null}'))
    raw = ad.doc_pages(spark, d).select("doc_id", value.alias("value"))
    return records.parse_typed_pages(raw).select(
        "doc_id", "location", F.array_join("content", "|").alias("content"),
        F.array_join("keywords", "|").alias("keywords"), F.size("links").cast("bigint").alias("links"),
        "type_error")


@query
def pages_json(spark, d):
    value = F.col("value")
    record = F.from_json(value, schemas.PAGE)
    return stores.page_json(ad.doc_pages(spark, d)).select(
        F.get_json_object(value, "$.location").alias("location"),
        F.get_json_object(value, "$.author").alias("author"),
        F.get_json_object(value, "$.created_at").cast("bigint").alias("created_at"),
        F.md5(F.concat_ws("|", *[F.array_join(record[c], ",") if c in schemas.LIST_COLUMNS else record[c].cast("string")
                                 for c in schemas.PAGE_COLUMNS[:-1]])).alias("digest"),
        F.size(F.json_object_keys(value)).cast("bigint").alias("fields"))


@query
def store_lookup(spark, d):
    """Pages stored by host and read back by the ids of the English ones."""
    root = new_work_dir(spark, "pages")
    pages = ad.doc_pages(spark, d)
    stores.store_pages(pages.drop("doc_id", "seq"), root)
    wanted = pages.filter(F.element_at("keywords", 1) == "en").select(
        stores.uuid_from_hash(F.sha2("location", 256)).alias("id"))
    return stores.lookup_pages(spark, root, wanted).select("id", "host", "location")


@query
def read_seeds(spark, d):
    path = new_work_dir(spark, "seeds")
    url = F.when(F.col("url").contains("#"), F.concat(F.lit(":"), "url")).otherwise(F.col("url"))
    ad.table(spark, d, "pages").select(url).write.text(path)
    return lists.read_seeds(spark, path, on_bad="drop").select("location")


@query
def read_corpus(spark, d):
    """Labelled documents as page files per source under two roots, read back.

    The tasks move their files into place themselves; by default the driver would, one after another. On a local disk
    no checksum file is written beside each: setting the rights of a file starts a process there.
    """
    options = {"maxRecordsPerFile": 1, "mapreduce.fileoutputcommitter.algorithm.version": "2",
               "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
    root = new_work_dir(spark, "corpus")
    pages = ad.labelled_docs(spark, d).withColumn("site", F.element_at("keywords", 2))
    for name, label in (("positive", 1.0), ("negative", 0.0)):
        (pages.filter(F.col("label") == label).select("site", *schemas.PAGE_COLUMNS)
         .write.options(**options).partitionBy("site").json(f"{root}/{name}"))
    return records.read_corpus(spark, f"{root}/positive", f"{root}/negative") \
        .select("location", "label", F.size("content").cast("bigint").alias("lines"))


# ---- addresses and domains

def _seed_list(spark, d):
    url = F.col("url")
    host = F.regexp_extract(url, "^https?://([^/]+)", 1)
    shapes = F.array(url, F.regexp_replace(url, "^https?://", ""), F.regexp_extract(url, "^https?://[^/]+", 0),
                     F.concat(F.lit("https://"), F.upper(host), F.lit(":8443/a;v=1?x#y")))
    return ad.table(spark, d, "pages").select(F.explode(shapes).alias("seed")).distinct()


@query
def seed_candidates(spark, d):
    return seeds.seed_candidates(_seed_list(spark, d)).select("seed", F.col("ord").cast("bigint").alias("ord"), "candidate")


@query
def resolve_seeds(spark, d):
    tried = seeds.seed_candidates(_seed_list(spark, d))
    known = ad.table(spark, d, "pages").select(F.col("url").alias("candidate"), F.lit(True).alias("ok")).distinct()
    code = F.concat(F.lit("HTTP "), (F.length("candidate") % 20 + 400))
    status = tried.select("candidate").distinct().join(known, "candidate", "left").select(
        F.col("candidate").alias("url"), F.coalesce("ok", F.lit(False)).alias("ok"),
        F.when(F.col("ok").isNull(), code).alias("error"))
    return seeds.resolve_seeds(tried, status)


@query
def working_seeds(spark, d):
    """The working addresses as a line list, read back as seeds."""
    path = new_work_dir(spark, "working")
    seeds.write_working_seeds(resolve_seeds(spark, d), path)
    return lists.read_seeds(spark, path, on_bad="drop").select("location")


@query
def hostname(spark, d):
    return ad.table(spark, d, "pages").select("page_id", urls.hostname(F.col("url")).alias("hostname"))


@query
def domain(spark, d):
    return ad.table(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query
def netloc(spark, d):
    with_user = F.regexp_replace("url", "://", "://u:p@")
    return ad.table(spark, d, "pages").select("page_id", urls.netloc(with_user).alias("netloc"))


@query
def valid_location(spark, d):
    shapes = F.array(F.col("url"), F.upper("url"), F.regexp_replace("url", "^http", "ftp"))
    rows = ad.table(spark, d, "pages").select("page_id", F.explode(shapes).alias("location"))
    return rows.select("page_id", "location", urls.valid_location(F.col("location")).alias("valid"))


@query
def normalize_link(spark, d):
    shapes = F.array(*[F.lit(s) for s in LINK_SHAPES])
    rows = ad.table(spark, d, "pages").select("page_id", "url", F.posexplode(shapes).alias("shape", "href"))
    return rows.select("page_id", F.col("shape").cast("bigint").alias("shape"),
                       urls.normalize_link(F.col("url"), F.col("href")).alias("link"))


@query
def sql_normalize_link(spark, d):
    """The same through the SQL functions."""
    register_functions(spark)
    shapes = F.array(*[F.lit(s) for s in LINK_SHAPES])
    rows = ad.table(spark, d, "pages").select("page_id", "url", F.posexplode(shapes).alias("shape", "href"))
    return rows.selectExpr("page_id", "cast(shape AS bigint) AS shape", "normalize_link(url, href) AS link")


@query
def sql_page_columns(spark, d):
    """Hash, word count, hosts of documents as pages, by the SQL functions."""
    register_functions(spark)
    pages = ad.doc_pages(spark, d).select("doc_id", "title", "location", F.array_join("content", " ").alias("body"))
    return pages.selectExpr(
        "doc_id", "content_hash(title, body) AS content_hash", "cast(word_count(body) AS bigint) AS word_count",
        "hostname(location) AS hostname", "netloc(location) AS netloc", "extract_domain(location) AS domain")


@query
def block_domains(spark, d):
    pages = ad.table(spark, d, "pages").select("page_id", "url")
    return domains.block_domains(pages, lists.domain_table(spark, ad.BLOCKED))


def _page_blacklist(spark, d):
    """Authorities of the pages with a file name."""
    return ad.table(spark, d, "pages").filter(F.col("url").contains(".html")) \
        .select(urls.netloc(F.col("url")).alias("domain")).distinct()


@query
def drop_blacklisted(spark, d):
    pages = ad.table(spark, d, "pages").select("page_id", "url")
    return domains.drop_blacklisted(pages, _page_blacklist(spark, d))


# ---- extraction

@query
def gate_documents(spark, d):
    url = F.col("url")
    kind = (F.when(url.contains("?"), "text/plain").when(url.contains("#"), "application/pdf")
            .when(url.contains(".html"), "text/html; charset=utf-8").otherwise("text/html"))
    docs = ad.table(spark, d, "pages").select("page_id", "url", "html", kind.alias("content_type"))
    return records.gate_documents(docs).select(
        "page_id", "content_type", F.length("html").cast("bigint").alias("chars"))


def _extracted(spark, d):
    pages = ad.raw_pages(spark, d).select("page_id", "url", "html", "content_type")
    return extract.extract_pages(records.gate_documents(pages).drop("content_type"))


@query
def extract_title(spark, d):
    return _extracted(spark, d).select("page_id", "title")


def _list_field(spark, d, name):
    # The inner form would walk every page twice.
    return _extracted(spark, d).select("page_id", F.posexplode_outer(name).alias("pos", name)) \
        .filter("pos IS NOT NULL").withColumn("pos", F.col("pos").cast("bigint"))


@query
def extract_headings(spark, d):
    return _list_field(spark, d, "headings")


@query
def extract_content(spark, d):
    return _list_field(spark, d, "content")


@query
def extract_links(spark, d):
    return _list_field(spark, d, "links")


@query
def extract_script_text(spark, d):
    return _list_field(spark, d, "script_content")


@query
def assemble_page(spark, d):
    pages = _extracted(spark, d).withColumn("created_at", F.unix_timestamp(ad.as_of()) * 1000)
    return pages.select(
        "page_id", "location", "created_at", *[F.size(c).cast("bigint").alias(c) for c in
                                               ("headings", "content", "links", "script_content")])


@query
def extract_meta(spark, d):
    """Meta fields and the first script link; the table has none, so tags made from its columns come first."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    tags = F.concat(
        F.lit('<meta name="description" content=" About '), host, F.lit(' "><meta name="description" content=" ">'
              '<meta name="author" content="First"><meta content="'), host, F.lit('" name=" author "><meta name="Author" content="No">'
              '<meta name="keywords" content="k1, '), F.col("page_id").cast("string"), F.lit(',z"><script src="/c"></script>'))
    pages = ad.raw_pages(spark, d).select("page_id", "url", F.concat(tags, "html").alias("html"))
    return extract.extract_pages(pages).select(
        "page_id", "description", "author", F.array_join("keywords", "|").alias("keywords"),
        F.get("script_links", F.lit(0)).alias("script_link"))


# ---- frontier

@query
def seed_frontier(spark, d):
    rows = ad.table(spark, d, "pages").select(F.col("url").alias("location"))
    return frontier.seed_frontier(rows.filter("location = ''").withColumn("retries", F.lit(0)), rows)


@query
def frontier_size(spark, d):
    return frontier.frontier_size(frontier.expand_links(ad.linked_docs(spark, d)))


def _frontier(spark, d):
    """Every page address twice, and once with a bad escape at its end."""
    pages = ad.table(spark, d, "pages").select("page_id", "url")
    shapes = F.array(F.col("url"), F.col("url"), F.concat("url", F.lit("%zz")))
    return pages.select("page_id", F.posexplode(shapes).alias("copy", "location")).select(
        "location", (F.col("page_id") % 6).cast("int").alias("retries"),
        (F.col("page_id") * 3 + F.col("copy")).alias("seq"),
        F.col("location").endswith("ref=x").alias("check_failed"))


@query
def admission_report(spark, d):
    visited = ad.table(spark, d, "pages").filter(F.col("url").contains("utm_source")).select(F.col("url").alias("location"))
    return frontier.admission_report(_frontier(spark, d), visited, lists.domain_table(spark, ad.BLOCKED),
                                     _page_blacklist(spark, d)).select("seq", "location", "reason")


@query
def admit(spark, d):
    visited = ad.table(spark, d, "pages").filter(F.col("url").contains("utm_source")).select(F.col("url").alias("location"))
    return frontier.admit(_frontier(spark, d), visited)[0].select("location", "seq")


@query
def requeue_failed(spark, d):
    return frontier.requeue_failed(_frontier(spark, d))


@query
def expand_links(spark, d):
    return frontier.expand_links(ad.linked_docs(spark, d), "doc_id") \
        .withColumn("pos", F.col("pos").cast("bigint"))


@query
def crawl_waves(spark, d):
    work_root(spark)
    pages = ad.linked_docs(spark, d).select("location", "links").checkpoint()
    first = ad.table(spark, d, "documents").filter("doc_id = 0").select(
        F.format_string("https://%s.example.com/%s/%d", "source", "lang", "doc_id").alias("location"),
        F.col("doc_id").alias("seq"))
    return frontier.crawl_waves(first, pages, buckets=spark.sparkContext.defaultParallelism)


# ---- text and features

@query
def page_text_serve(spark, d):
    text = tx.page_text(schemas.SERVE_FIELDS)
    return ad.doc_pages(spark, d).select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("chars"))


@query
def page_text_train(spark, d):
    text = tx.page_text(schemas.TRAIN_FIELDS)
    return ad.doc_pages(spark, d).select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("chars"))


def _doc_tokens(spark, d):
    return features.page_tokens(ad.doc_pages(spark, d), "doc_id", schemas.TRAIN_FIELDS)


@query
def tokens(spark, d):
    return _doc_tokens(spark, d).select("doc_id", F.array_join("tokens", " ").alias("tokens"))


def _word_list(spark, d):
    return ad.table(spark, d, "benchmark").select(F.explode(tx.tokens(F.col("text"))).alias("word")).distinct()


@query
def filter_dictionary(spark, d):
    return features.filter_dictionary(_doc_tokens(spark, d), _word_list(spark, d), "doc_id") \
        .withColumn("pos", F.col("pos").cast("bigint"))


@query
def lemmatize(spark, d):
    occurrences = features.token_occurrences(_doc_tokens(spark, d), "doc_id")
    lemmas = _word_list(spark, d).filter("length(word) > 5").select(
        F.col("word").alias("token"), F.expr("left(word, 5)").alias("lemma"))
    return features.lemmatize(occurrences, lemmas).withColumn("pos", F.col("pos").cast("bigint"))


@query
def remove_stop_words(spark, d):
    kept = tx.remove_stop_words(F.col("tokens"), ENGLISH_STOP_WORDS)
    return _doc_tokens(spark, d).select("doc_id", F.array_join(kept, " ").alias("tokens"))


@query
def ngrams(spark, d):
    terms = tx.ngrams(F.col("tokens"), 1, 3)
    return _doc_tokens(spark, d).select(
        "doc_id", F.size(terms).cast("bigint").alias("terms"), F.md5(F.array_join(terms, "|")).alias("digest"))


def _stored_tokens(spark, d):
    """The tokens of the documents, written once: vocabulary and vectors read them several times."""
    path, docs = new_work_dir(spark, "tokens"), _doc_tokens(spark, d)
    docs.write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


def _vocabulary(docs):
    return features.mine_vocabulary(docs, "doc_id", features.document_count(docs), stop_words=ENGLISH_STOP_WORDS)


@query
def vocabulary(spark, d):
    return _vocabulary(_stored_tokens(spark, d))


def _vectors(spark, d):
    docs = _stored_tokens(spark, d)
    return features.vectorize(docs, "doc_id", _vocabulary(docs), features.document_count(docs), stop_words=ENGLISH_STOP_WORDS)


@query
def tfidf(spark, d):
    vectors, terms = _vectors(spark, d)
    return features.tfidf(vectors, terms, "doc_id").withColumn("weight", F.round("weight", 6))


# ---- classifier and routing

@query
def split_md5(spark, d):
    return ad.table(spark, d, "labels").select(
        "doc_id", (classify.split_bucket(F.col("doc_id")) < 20).alias("is_test"))


@query
def training_set(spark, d):
    rows = ad.table(spark, d, "labels").select("doc_id", "quality")
    return classify.training_set(rows.filter("quality = 1").select("doc_id"), rows.filter("quality = 0").select("doc_id"))


@query
def class_weights(spark, d):
    return classify.class_weights(ad.table(spark, d, "labels"), "quality").withColumn("weight", F.round("weight", 6))


def _scored(spark, d):
    """Probabilities from coefficients given by a rule on the term."""
    vectors, terms = _vectors(spark, d)
    return classify.score_linear(vectors, [(len(t) % 7 - 3) / 2.0 for t in terms], 0.1, "doc_id")


@query
def score_linear(spark, d):
    return _scored(spark, d).select("doc_id", F.round("p_not", 6).alias("p_not"), F.round("p_dev", 6).alias("p_dev"))


@query
def predict(spark, d):
    return _scored(spark, d).select("doc_id", classify.predict(F.round("p_dev", 6)).cast("bigint").alias("prediction"))


@query
def classification_report(spark, d):
    labels = ad.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    docs = ad.table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 600, 1).otherwise(0).alias("prediction"))
    report = classify.classification_report(labels.join(docs, "doc_id"))
    return report.select("name", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                         F.col("support").cast("bigint").alias("support"))


def _routed(spark, d):
    pages = ad.linked_docs(spark, d)
    scored = _scored(spark, d).withColumn("p_not", F.round("p_not", 6))
    return routing.route(pages.join(scored, "doc_id"), THRESHOLD)


@query
def route(spark, d):
    return _routed(spark, d).select("doc_id", "p_not", "route")


@query
def blacklist_domains(spark, d):
    return routing.blacklist_domains(_routed(spark, d))


@query
def route_index(spark, d):
    return routing.index_pages(_routed(spark, d)).select("doc_id", "location")


@query
def route_outlinks(spark, d):
    return routing.route_outlinks(_routed(spark, d), "doc_id").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "location", "retries")


@query
def route_counts(spark, d):
    return routing.route_counts(_routed(spark, d))


# ---- validation and upsert

@query
def validate(spark, d):
    """Documents as they are, with a foreign scheme, and with an over-long author."""
    pages = ad.doc_pages(spark, d)
    foreign = pages.withColumn("location", F.regexp_replace("location", "^https", "ftp"))
    wide = pages.withColumn("author", F.repeat(F.lit("a"), F.length("location") * 14))
    shapes = pages.withColumn("shape", F.lit("plain")).union(foreign.withColumn("shape", F.lit("foreign"))) \
        .union(wide.withColumn("shape", F.lit("wide")))
    return ingest.validate(shapes).select("doc_id", "shape", "status")


@query
def url_hash(spark, d):
    return ad.doc_pages(spark, d).select("doc_id", tx.url_hash(F.col("location")).alias("url_hash"))


@query
def content_hash(spark, d):
    text = tx.content_text(F.col("content"))
    return ad.doc_pages(spark, d).select("doc_id", tx.content_hash(F.col("title"), text).alias("content_hash"))


@query
def word_count(spark, d):
    text = tx.content_text(F.col("content"))
    return ad.doc_pages(spark, d).select("doc_id", tx.word_count(text).cast("bigint").alias("word_count"))


@query
def indexed_pages(spark, d):
    return ad.indexed_docs(spark, d).select(
        "id", "url", "domain", "content_hash", F.col("word_count").cast("bigint").alias("word_count"), "created_at")


def _recrawl_status(spark, d):
    return ingest.full_status(ingest.validate(ad.recrawls(spark, d)), None, SPAN)


@query
def upsert_status(spark, d):
    return _recrawl_status(spark, d)


@query
def apply_upsert(spark, d):
    valid = ingest.validate(ad.recrawls(spark, d))
    pages = ingest.indexed_page(valid, ad.as_of())
    table = ingest.apply_upsert(pages, ingest.full_status(valid, None, SPAN), None, ad.as_of())
    return table.select("id", "url", "url_hash", "title", "domain", "content_hash",
                        F.col("word_count").cast("bigint").alias("word_count"), "created_at")


@query
def batch_counts(spark, d):
    rows = _recrawl_status(spark, d).withColumn("batch", F.floor(F.col("seq") / 100).cast("bigint"))
    return stats.batch_counts(rows, "batch")


@query
def daily_stats(spark, d):
    return _daily(spark, d)


def _daily(spark, d):
    out = stats.update_daily_stats(None, ad.batches(spark, d))
    return out.withColumn("avg_processing_time_ms", F.col("avg_processing_time_ms").cast("double"))


@query
def stats_for(spark, d):
    out = stats.stats_for(stats.update_daily_stats(None, ad.batches(spark, d)), dt.date(2024, 1, 15))
    return out.withColumn("avg_processing_time_ms", F.col("avg_processing_time_ms").cast("double"))


@query
def session_totals(spark, d):
    return stats.session_totals(ad.batches(spark, d))


@query
def page_count(spark, d):
    return stats.page_count(ad.indexed_docs(spark, d))


@query
def content_duplicates(spark, d):
    return ingest.content_duplicates(ad.indexed_docs(spark, d))


# ---- index and search

def _urls(pages):
    """(id, urls): joined to the index, so that the pairs of query and page need not move for it."""
    return pages.select("id", "url").groupBy("id").agg(F.collect_list("url").alias("urls"))


@query
def document_vectors(spark, d):
    rows = index.document_vectors(ad.indexed_docs(spark, d).withColumn("id", F.col("url")), position_limits=True)
    return rows.select(F.col("id").alias("url"), "lexeme", F.col("pos").cast("bigint").alias("pos"), "weight")


def _postings(spark, d, config="simple"):
    """The index of the documents, written and read back: a search looks into it several times."""
    path = new_work_dir(spark, "postings")
    index.write_postings(index.build_postings(ad.indexed_docs(spark, d, by_text=True), config=config), path)
    return spark.read.parquet(path)


@query
def postings(spark, d):
    rows = index.build_postings(ad.indexed_docs(spark, d).withColumn("id", F.col("url")), position_limits=True)
    written = F.array_join(F.transform("positions", lambda p: F.concat(p["pos"].cast("string"), p["w"])), " ")
    return rows.select("lexeme", F.col("id").alias("url"), written.alias("positions"))


@query
def postings_without_limits(spark, d):
    """Every position of every lexeme, none pressed together."""
    rows = index.build_postings(ad.indexed_docs(spark, d).withColumn("id", F.col("url")))
    written = F.array_join(F.transform("positions", lambda p: F.concat(p["pos"].cast("string"), p["w"])), " ")
    return rows.select("lexeme", F.col("id").alias("url"), written.alias("positions"))


@query
def parse_queries(spark, d):
    return search.parse_queries(ad.queries(spark, d)).select("query_id", "lexeme", F.col("n").cast("bigint").alias("n"))


@query
def match(spark, d):
    found = search.match(_postings(spark, d), search.parse_queries(ad.queries(spark, d)), "id", _urls(ad.indexed_docs(spark, d)))
    return found.select("query_id", F.explode("urls").alias("url"))


@query
def rank(spark, d):
    found = search.rank(search.match(_postings(spark, d), search.parse_queries(ad.queries(spark, d)), "id", _urls(ad.indexed_docs(spark, d)), by_page=True))
    return found.select("query_id", F.round("rank", 6).alias("rank"), F.explode("urls").alias("url")).select("query_id", "url", "rank")


def _search(spark, d, **options):
    return search.search(_postings(spark, d, options.get("config", "simple")), ad.indexed_docs(spark, d),
                         ad.queries(spark, d), **options)


def _result_columns(results):
    return results.select(
        "query_id", F.col("position").cast("bigint").alias("position"), "url", "title", "content_summary",
        "domain", F.col("word_count").cast("bigint").alias("word_count"), "created_at", F.round("rank", 6).alias("rank"))


@query
def search_ranked(spark, d):
    return _result_columns(_search(spark, d))


@query
def search_filtered(spark, d):
    return _result_columns(_search(spark, d, page=2, per_page=3, domain="src3.example.com", min_words=100))


@query
def search_second_page(spark, d):
    return _result_columns(_search(spark, d, page=2, per_page=5))


def _totals(spark, d):
    return search.search_totals(_postings(spark, d), ad.indexed_docs(spark, d), ad.queries(spark, d))


@query
def search_totals(spark, d):
    return _totals(spark, d)


@query
def paging(spark, d):
    out = search.paging(_totals(spark, d), page=2, per_page=10)
    return present.shown_range(out).select("query_id", "total", "has_next", "has_prev", "shown_from", "shown_to")


@query
def page_window(spark, d):
    """Page buttons of each query's result, for pages 1 to 5 of two each."""
    rows = _totals(spark, d).select("query_id", "total", F.lit(2).alias("per_page"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page"))
    return present.page_window(rows).select("query_id", "page", "pages", "window", "first", "gap_before", "last", "gap_after")


@query
def snippet(spark, d):
    return ad.indexed_docs(spark, d).select("url", tx.snippet(F.col("content")).alias("snippet"))


@query
def search_pages(spark, d):
    out = search.search_pages(_postings(spark, d), ad.indexed_docs(spark, d), ad.common_words(spark, d), limit=20, offset=5)
    return out.select(F.col("position").cast("bigint").alias("position"), "url", "title", "author", "domain", F.round("rank", 6).alias("rank"))


@query
def terminal_listing(spark, d):
    out = search.search_pages(_postings(spark, d), ad.indexed_docs(spark, d), ad.common_words(spark, d), limit=20)
    return present.terminal_listing(out).select(F.col("position").cast("bigint").alias("position"), "title", "url", "domain", "author", "description", F.col("rank").alias("rank"))


@query
def search_results(spark, d):
    return search.search_results(ad.indexed_docs(spark, d)).select(
        "id", "url", "title", "domain", F.col("word_count").cast("bigint").alias("word_count"), "created_at", "rank")


@query
def result_cards(spark, d):
    return present.result_cards(_search(spark, d), "query_id") \
        .withColumn("word_count", F.col("word_count").cast("bigint"))


@query
def corpus_summary(spark, d):
    out = stats.corpus_summary(ad.indexed_docs(spark, d))
    return out.withColumn("shown_words", stats.whole_words(F.col("average_word_count")))


@query
def summary_change(spark, d):
    """Snapshots after every hundred documents: pages and hosts known so far."""
    rows = ad.indexed_docs(spark, d).select("domain", F.floor((F.col("created_at") - 1704067200) / 100).cast("bigint").alias("snapshot"))
    pages = rows.groupBy("snapshot").agg(F.count("*").alias("total_pages"))
    first = rows.groupBy("domain").agg(F.min("snapshot").alias("snapshot")).groupBy("snapshot").agg(F.count("*").alias("unique_domains"))
    counts = pages.join(first, "snapshot", "left").select("snapshot", "total_pages", F.coalesce("unique_domains", F.lit(0)).alias("unique_domains"))
    return stats.summary_change(stats.running_totals(counts, "snapshot", ["total_pages", "unique_domains"]))


# ---- trained classifier and English search

def _trained(spark, d):
    """(labelled documents, model)."""
    labels = ad.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    docs = _doc_tokens(spark, d).join(labels, "doc_id")
    return docs, classify.train(docs, "doc_id", stop_words=ENGLISH_STOP_WORDS)


@query
def train_classifier(spark, d):
    """Report of the held-out split."""
    docs, model = _trained(spark, d)
    scored = classify.score(classify.split(docs, "doc_id")[1], model, ENGLISH_STOP_WORDS)
    return classify.classification_report(scored.withColumn("prediction", classify.predict(F.col("p_dev"))))


@query
def classify_pages(spark, d):
    """All documents scored by the trained model on the serving fields, and routed."""
    pages = features.page_tokens(ad.doc_pages(spark, d), "doc_id", schemas.SERVE_FIELDS)
    scored = classify.score(pages, _trained(spark, d)[1], ENGLISH_STOP_WORDS)
    return routing.route(scored, 0.9).select("doc_id", "p_not", "p_dev", "route")


@query
def stem(spark, d):
    """Stems of all words of the documents and the benchmark, by column expressions."""
    words = [ad.table(spark, d, t).select(F.explode_outer(tx.words(F.col("text"))).alias("word")) for t in ("documents", "benchmark")]
    return stemming.stem_vocabulary(words[0].union(words[1]).filter("word IS NOT NULL"))


@query
def search_english(spark, d):
    return _result_columns(_search(spark, d, config="english"))


# ---- streams over the tables

def _fails_at_first(items):
    """The visited check of some addresses fails until they have been put back twice."""
    return items.withColumn("check_failed", F.col("location").endswith("ref=x") & (F.col("retries") < 2))


def _admission(spark, d):
    """Folder of an admission stream over all page addresses that feeds itself; state in RocksDB."""
    session = with_rocksdb(spark)
    root = new_work_dir(spark, "admission")
    shapes = F.array(F.col("url"), F.col("url"), F.concat("url", F.lit("%zz")))
    stream = ad.table_stream(session, d, "pages", "page_id")
    seeds = stream.select("page_id", F.posexplode(shapes).alias("copy", "location")).select(
        "location", (F.col("page_id") % 6).cast("int").alias("retries"), (F.col("page_id") * 3 + F.col("copy")).alias("seq"))
    visited = ad.table(session, d, "pages").filter(F.col("url").contains("utm_source")).select(F.col("url").alias("location"))
    jobs.drain(lambda: jobs.admission_stream(
        jobs.frontier_queue(seeds, root), root, f"{root}/checkpoint", lambda s: lists.domain_table(s, ad.BLOCKED),
        lambda s: _page_blacklist(s, d), visited=visited, check=_fails_at_first))
    return root


@query
def stream_admission(spark, d):
    return spark.read.parquet(f"{_admission(spark, d)}/admitted").select("seq", "location", "retries")


@query
def stream_admission_report(spark, d):
    """What became of every item in every pass, over several micro-batches and requeues."""
    return spark.read.parquet(f"{_admission(spark, d)}/report").select("seq", "location", "retries", "reason")


@query
def stream_route(spark, d):
    """Routes of a stream of documents, scored by a rule on the title, by output."""
    root = new_work_dir(spark, "route")
    pages = ad.pages_of_documents(ad.table_stream(spark, d, "documents", "doc_id")).withColumn(
        "links", F.array("location", F.concat("location", F.lit("/next"))))
    jobs.routing_stream(pages, root, f"{root}/checkpoint",
                        lambda df: df.withColumn("p_not", (F.length("title") % 100) / 100.0), 0.8).awaitTermination()
    outputs = [spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("output"), F.col(col).alias("value"))
               for name, col in (("index", "location"), ("frontier", "location"), ("blacklist", "domain"))]
    return outputs[0].union(outputs[1]).union(outputs[2])


@query
def stream_chain(spark, d):
    """Queue files through admission, fetch, routing and indexing, each stage a stream over what the one before wrote."""
    session, root = with_rocksdb(spark), new_work_dir(spark, "chain")
    docs = ad.doc_pages(session, d)
    queue = docs.select("location", (F.col("doc_id") % 6).cast("int").alias("retries"), F.col("doc_id").alias("seq"))
    for rest in (0, 1):  # every location twice
        stores.append_stage(queue.withColumn("seq", F.col("seq") + rest * 1_000_000_000), f"{root}/queue")
    session.createDataFrame([("SRC3.example.com",), ("src5.example.com",)], "value STRING").write.text(f"{root}/blocked")
    jobs.admission_stream(records.stream_frontier(session, f"{root}/queue", max_files=4), f"{root}/admission", f"{root}/admission/checkpoint",
                          lambda s: lists.read_domain_list(s, f"{root}/blocked")).awaitTermination()
    admitted = session.readStream.schema("seq BIGINT, location STRING, retries INT").parquet(f"{root}/admission/admitted")
    jobs.fetch_stream(admitted, lambda s: ad.doc_pages(s, d), f"{root}/fetch", f"{root}/fetch/checkpoint").awaitTermination()
    fetched = records.stream_pages(session, f"{root}/fetch/pages", max_files=8)
    jobs.routing_stream(fetched, f"{root}/route", f"{root}/route/checkpoint",
                        lambda df: df.withColumn("p_not", (F.length("title") % 100) / 100.0), 0.8).awaitTermination()
    routed = session.readStream.schema(fetched.schema).parquet(f"{root}/route/index")
    _index(session, routed, PageStore(session, f"{root}/store"), "checkpoint")
    return PageStore(spark, f"{root}/store").pages().select(
        "id", "url", "url_hash", "title", "domain", "content_hash", F.col("word_count").cast("bigint").alias("word_count"), "created_at")


@query
def stream_classify(spark, d):
    """The documents as a stream, scored by the trained model, which is saved first, and routed."""
    root = new_work_dir(spark, "classify")
    classify.save_model(_trained(spark, d)[1], f"{root}/model")
    pages = ad.pages_of_documents(ad.table_stream(spark, d, "documents", "doc_id"))
    score = jobs.model_scorer(f"{root}/model", ENGLISH_STOP_WORDS)
    jobs.routing_stream(pages, f"{root}/out", f"{root}/checkpoint", score, 0.9).awaitTermination()
    return spark.read.parquet(f"{root}/out/index").select("doc_id", "p_not", "p_dev", "route")


def _visit_stream(spark, d):
    return ad.visits_of(ad.pages_of_documents(ad.table_stream(spark, d, "documents", "doc_id")))


def _index(spark, pages, store, checkpoint):
    jobs.index_stream(pages, store, f"{store.root}/{checkpoint}", partitions=spark.sparkContext.defaultParallelism,
                      now=lambda: dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)).awaitTermination()


def _stream_store(spark, d):
    store = PageStore(spark, new_work_dir(spark, "store"))
    _index(spark, _visit_stream(spark, d), store, "checkpoint")
    return store


@query
def stream_index(spark, d):
    return _stream_store(spark, d).pages().select(
        "id", "url", "url_hash", "title", "domain", "content_hash",
        F.col("word_count").cast("bigint").alias("word_count"), "created_at")


@query
def stream_search(spark, d):
    """Search over the streamed, then compacted, index."""
    store = _stream_store(spark, d).compact(new_work_dir(spark, "compact"))
    return store.search(ad.queries(spark, d)).select(
        "query_id", F.col("position").cast("bigint").alias("position"), "url", F.round("rank", 6).alias("rank"))


@query
def stream_counts(spark, d):
    """What the micro-batches of the visits did, all together."""
    store = _stream_store(spark, d)
    return store.counts().agg(F.count("*").alias("batches"), *[F.sum(c).cast("bigint").alias(c) for c in stats.COUNTS])


@query
def stream_daily_stats(spark, d):
    """The day's counters after several batches have been merged into them."""
    daily = _stream_store(spark, d).daily_stats()
    return daily.select("date", *stats.STATS_COUNTERS)


@query
def stream_replay(spark, d):
    """Search after four micro-batches, a compaction, the last batch once more, and a second stream.

    The second stream, with a checkpoint of its own, visits every document at its own address.
    """
    store = _stream_store(spark, d).compact(new_work_dir(spark, "compact"))
    last = store.counts().agg(F.max("batch_id")).first()[0]
    pages = ad.recrawls(spark, d)
    low, high = ad.table(spark, d, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    replayed = pages.filter(F.col("doc_id") >= low + 3 * max(1, -(-(high - low + 1) // 4)))
    store.write_batch(replayed.select(*schemas.PAGE_COLUMNS, "seq"), last, ad.as_of())
    _index(spark, ad.pages_of_documents(ad.table_stream(spark, d, "documents", "doc_id")), store, "second")
    return store.search(ad.queries(spark, d)).select(
        "query_id", F.col("position").cast("bigint").alias("position"), "url", F.round("rank", 6).alias("rank"))
