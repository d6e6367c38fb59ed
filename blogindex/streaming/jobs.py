"""The three streaming jobs: admission, routing, indexing.

Each writes one folder per micro-batch with overwrite, so a batch that runs again after a
failure replaces its own output. Folders are numbered by checkpoint and batch: a stream with
a new checkpoint adds to what is there.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from blogindex import schemas
from blogindex.functions import text as tx
from blogindex.functions import urls
from blogindex.operators import classify, domains, routing
from blogindex.operators.frontier import list_flags
from blogindex.schemas import FRONTIER
from blogindex.session import exists
from blogindex.settings import DEFAULTS
from blogindex.sources.records import stream_frontier
from blogindex.streaming.admission import sightings
from blogindex.streaming.store import STREAM_BATCHES, PageStore, stream_number

Lookup = Callable[[SparkSession], DataFrame | None]


def _folder(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch_id={batch_id}"


def _start(stream: DataFrame, root: str, checkpoint: str, once: bool, work) -> StreamingQuery:
    first = stream_number(stream.sparkSession, root, checkpoint) * STREAM_BATCHES
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: work(batch, first + batch_id))
    return (writer.trigger(availableNow=True) if once else writer).start()


def admission_stream(frontier: DataFrame, out: str, checkpoint: str, blocked: Lookup,
                     blacklist: Lookup = lambda spark: None, key: str = "exact", once: bool = True,
                     max_retries: int = DEFAULTS.max_retries, visited: DataFrame | None = None,
                     check: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Decide every item of (location, retries[, seq]) of a frontier stream.

    Writes report (all items with the reason admission_report gives them), admitted, and
    requeue: the items whose check failed, with one retry more, as JSON that
    records.stream_frontier reads; frontier may itself read them (see frontier_queue).
    check adds check_failed to the items. The visited set is keyed state in RocksDB, begun
    with visited; the first item is that of the smallest seq in a micro-batch, and an earlier
    batch comes first. Blocked items stay visited. The lists are read anew for every
    micro-batch.
    """
    items = frontier if "seq" in frontier.columns else frontier.withColumn("seq", F.lit(0))
    items = check(items) if check else items.withColumn("check_failed", F.lit(False))
    seen = sightings(items.withColumn("seq", F.coalesce("seq", F.lit(0))), max_retries, visited)

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            flags = list_flags(batch.filter("reason = 'first' AND location IS NOT NULL").select("location"),
                               blocked(spark), blacklist(spark), key)
            reason = (F.when(F.col("reason") != "first", F.col("reason"))
                      .when(~F.coalesce(urls.parses(F.col("location")), F.lit(False)), "malformed")
                      .when(F.col("_blocked"), "blocked").when(F.col("_black"), "blacklisted").otherwise("admitted"))
            report = batch.join(flags, "location", "left").select("seq", "location", "retries", reason.alias("reason"))
            report.write.mode("overwrite").parquet(_folder(out, "report", batch_id))
            written = spark.read.schema(report.schema).parquet(_folder(out, "report", batch_id))
            written.filter("reason = 'admitted'").drop("reason").write.mode("overwrite").parquet(_folder(out, "admitted", batch_id))
            written.filter("reason = 'requeued'").select("location", (F.col("retries") + 1).alias("retries"), "seq") \
                .write.mode("overwrite").json(_folder(out, "requeue", batch_id))
        finally:
            batch.unpersist()

    return _start(seen, out, checkpoint, once, work)


def frontier_queue(seeds: DataFrame, out: str) -> DataFrame:
    """The stream of new items (location, retries, seq) and of those that admission_stream puts back under out."""
    spark = seeds.sparkSession
    again = f"{out}/requeue"
    if not exists(spark, again):
        # A file stream needs a folder to list.
        spark.createDataFrame([], FRONTIER + ", seq BIGINT").write.mode("overwrite").json(f"{again}/batch_id=none")
    return seeds.select("location", "retries", "seq").unionByName(
        stream_frontier(spark, f"{again}/batch_id=*").select("location", "retries", "seq"))


def drain(start: Callable[[], StreamingQuery], limit: int = DEFAULTS.max_retries + 3) -> int:
    """Run a stream that feeds itself until a run finds nothing new; returns the runs.

    One run takes what is there when it starts. An item is put back at most max_retries + 1
    times, so more than limit runs are an error.
    """
    for run in range(1, limit + 1):
        query = start()
        query.awaitTermination()
        if not any(p["numInputRows"] for p in query.recentProgress):
            return run
    raise RuntimeError(f"the queue is not empty after {limit} runs")


def fetch_stream(admitted: DataFrame, pages: Lookup, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the fetched pages of admitted locations to the next stage, as JSON that stream_pages reads.

    pages gives the page snapshot, read anew for every micro-batch; a location without a page
    is dropped. seq is the admitted item's.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        fetched = pages(batch.sparkSession).drop("seq").join(batch.select("location", "seq"), "location")
        fetched.select(*schemas.PAGE_COLUMNS, F.col("seq").cast("bigint")).write.mode("overwrite") \
            .option("ignoreNullFields", "false").json(_folder(out, "pages", batch_id))

    return _start(admitted, out, checkpoint, once, work)


def model_scorer(path: str, stop_words: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Adds p_not and p_dev of a saved model to pages; pages without tokens are dropped.

    The model is read for every micro-batch, so one that was saved anew counts from the
    next batch on. A missing model is an error.
    """
    def score(batch: DataFrame) -> DataFrame:
        text = tx.page_text(schemas.SERVE_FIELDS)
        pages = batch.filter(tx.has_tokens(text)).withColumn("tokens", tx.tokens(text))
        return classify.score(pages, classify.load_model(path), stop_words).drop("tokens")

    return score


def rejected_domains(out: str, before: int | None = None) -> Lookup:
    """Reads the domains that a routing stream under out has rejected, or none yet."""
    def read(spark: SparkSession) -> DataFrame | None:
        if not exists(spark, f"{out}/blacklist"):
            return None
        known = spark.read.schema("domain string, batch_id bigint").parquet(f"{out}/blacklist")
        return (known if before is None else known.filter(F.col("batch_id") < before)).select("domain").distinct()

    return read


def routing_stream(pages: DataFrame, out: str, checkpoint: str, score: Callable[[DataFrame], DataFrame],
                   threshold: float = DEFAULTS.rejection_threshold, once: bool = True,
                   skip_rejected: bool = False) -> StreamingQuery:
    """Score pages and write the three outputs: index, frontier, blacklist.

    score adds p_not to a micro-batch (see model_scorer). A domain is written to the
    blacklist once; rejected_domains hands it to the admission stream, so it counts there
    from the next batch on. With skip_rejected, pages of domains that earlier batches
    rejected are dropped before they are scored.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        known = rejected_domains(out, batch_id)(batch.sparkSession)
        if skip_rejected:
            batch = domains.drop_blacklisted(batch, known, "location")
        routed = routing.route(score(batch), threshold).persist()
        try:
            routing.index_pages(routed).write.mode("overwrite").parquet(_folder(out, "index", batch_id))
            routing.route_outlinks(routed).select("location", "retries") \
                .write.mode("overwrite").parquet(_folder(out, "frontier", batch_id))
            rejected = routing.blacklist_domains(routed)
            if known is not None:
                rejected = rejected.join(known, "domain", "left_anti")
            rejected.write.mode("overwrite").parquet(_folder(out, "blacklist", batch_id))
        finally:
            routed.unpersist()

    return _start(pages, out, checkpoint, once, work)


def index_stream(pages: DataFrame, store: PageStore, checkpoint: str, once: bool = True,
                 partitions: int | None = None,
                 now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc)) -> StreamingQuery:
    """Validate and upsert micro-batches of pages (PAGE columns and seq) into the store.

    partitions spreads a micro-batch by address when its few files would make few tasks.
    """
    def work(batch: DataFrame, batch_id: int) -> None:
        begun = time.monotonic()
        ready = batch.select(*schemas.PAGE_COLUMNS, "seq")
        if partitions:
            ready = ready.repartition(partitions, "location", "seq")
        store.write_batch(ready, batch_id, F.lit(now()).cast("timestamp"),
                          lambda: round((time.monotonic() - begun) * 1000, 2))

    return _start(pages, store.root, checkpoint, once, work)
