"""The page table as an append-only version log with postings and batch counts.

Layout under the root, one folder per batch in each:
  versions/batch_id=N   rows that changed the table, with all stored columns
  hashes/batch_id=N/prefix=P   their address and content hashes, by the first signs of the
                        address hash: a batch opens only the prefixes of its own addresses
  postings/batch_id=N   postings of those rows, sorted by lexeme
  counts/batch_id=N     one row of counts and time, written last: it commits the batch
  base                  postings of a compaction, with the batch each one came from
  streams               the number of each checkpoint that has written here
A batch that runs again overwrites its own folders and reads only the ones before it,
so it gives the same result. Compacted postings lie apart from the batch folders; those of
a batch that has run again since are taken from its folder. A batch is numbered by its
checkpoint and its place in it, so a new checkpoint never writes over an older one's
batches. Streams write to a store one after another, not at the same time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blogindex import schemas
from blogindex.functions import text as tx
from blogindex.operators import index, ingest, search, stats
from blogindex.plans.sizing import spread_text
from blogindex.session import exists

_VERSION = ["batch_id", "seq"]
# Batches that the numbering leaves to each stream.
STREAM_BATCHES = 1 << 40
_HASHES = "url_hash string, content_hash string, seq double, batch_id bigint, prefix string"


def _version_id() -> Column:
    """Page id and version: what postings refer to."""
    return F.concat_ws("@", "id", F.concat_ws(".", F.col("batch_id").cast("string"), F.col("seq").cast("string")))


def stream_number(spark: SparkSession, root: str, checkpoint: str) -> int:
    """Number of a checkpoint among those that write under root; a new one gets the next number.

    The number is kept in the checkpoint, so it is found again after a restart.
    """
    known, listed = f"{checkpoint}/stream-number", f"{root}/streams"
    if exists(spark, known):
        return spark.read.parquet(known).first()["number"]
    number = 0
    if exists(spark, listed):
        number = 1 + spark.read.parquet(listed).agg(F.max("number")).first()[0]
    row = spark.range(1).select(F.lit(number).cast("bigint").alias("number"))
    row.write.mode("append").parquet(listed)
    row.write.mode("overwrite").parquet(known)
    return number


class PageStore:
    def __init__(self, spark: SparkSession, root: str, config: str = "simple",
                 stop_words: list[str] | None = None, prefix: int = 1):
        """prefix: hexadecimal signs of the address hash that name a folder, 16 folders for each; fixed for a store."""
        self.spark, self.root, self.config, self.stop_words, self.prefix = spark, root, config, stop_words, prefix

    def _path(self, table: str, batch_id: int | None = None) -> str:
        return f"{self.root}/{table}" + ("" if batch_id is None else f"/batch_id={batch_id}")

    def _read(self, table: str) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(self._path(table))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return df.withColumn("batch_id", F.col("batch_id").cast("bigint"))

    def counts(self) -> DataFrame | None:
        return self._read("counts")

    def _committed(self, table: str, before: int | None = None) -> DataFrame | None:
        """Rows of committed batches, optionally only of those before a batch."""
        return self._of_batches(self._read(table), before)

    def _of_batches(self, df: DataFrame | None, before: int | None) -> DataFrame | None:
        counts = self.counts()
        if df is None or counts is None:
            return None
        if before is not None:
            df, counts = df.filter(F.col("batch_id") < before), counts.filter(F.col("batch_id") < before)
        return df.join(counts.select("batch_id").distinct(), "batch_id", "left_semi")

    def _prefix(self) -> Column:
        return F.substring("url_hash", 1, self.prefix).alias("prefix")

    def current_hashes(self, before: int | None = None, of: DataFrame | None = None) -> DataFrame | None:
        """(url_hash, content_hash) of the table, or of the URLs in of.

        With of, only the folders of the prefixes in it are opened, of which there are at most
        16 to the power of prefix, and the log is cut down to those URLs before anything is
        grouped.
        """
        if not exists(self.spark, self._path("hashes")):
            return None
        log = self._of_batches(self.spark.read.schema(_HASHES).parquet(self._path("hashes")), before)
        if log is None:
            return None
        if of is not None:
            touched = [r["prefix"] for r in of.select(self._prefix()).filter("prefix IS NOT NULL").distinct().collect()]
            log = log.filter(F.col("prefix").isin(touched)).join(of.select("url_hash").distinct(), "url_hash", "left_semi")
        return log.groupBy("url_hash").agg(F.max_by("content_hash", F.struct(*_VERSION)).alias("content_hash"))

    def _write_hashes(self, versions: DataFrame, path: str, *partitions: str) -> None:
        versions.select("url_hash", "content_hash", F.col("seq").cast("double"), *partitions, self._prefix()) \
            .repartition(*partitions, "prefix").sortWithinPartitions("prefix", "url_hash") \
            .write.mode("overwrite").partitionBy(*partitions, "prefix").parquet(path)

    def pages(self, before: int | None = None) -> DataFrame | None:
        """The page table: STORED_COLUMNS, times and version."""
        log = self._committed("versions", before)
        return None if log is None else ingest.latest_versions(log, _VERSION)

    def postings(self) -> DataFrame | None:
        """Postings of the batches, and those of a compaction whose batch has not run again."""
        deltas = self._committed("postings")
        if not exists(self.spark, self._path("base")):
            return deltas
        base = self.spark.read.parquet(self._path("base"))
        if deltas is None:
            return base
        return base.join(deltas.select("batch_id").distinct(), "batch_id", "left_anti").unionByName(deltas)

    def write_batch(self, batch: DataFrame, batch_id: int, as_of: Column,
                    elapsed_ms: Callable[[], float] | None = None, settings=ingest.DEFAULTS) -> None:
        """Validate, decide, and append one batch of pages (PAGE columns and seq).

        elapsed_ms tells the time spent so far, when the counts are about to be written.
        """
        valid = ingest.validate(batch, settings).persist()
        urls = valid.select(tx.url_hash(F.col("location")).alias("url_hash"))
        statuses = ingest.full_status(valid, self.current_hashes(before=batch_id, of=urls)).persist()
        try:
            pages = ingest.indexed_page(valid, as_of, settings.created_at_unit)
            changed = ingest.new_versions(pages, statuses).select(
                "seq", *schemas.STORED_COLUMNS, as_of.alias("indexed_at"), as_of.alias("updated_at"))
            changed.write.mode("overwrite").parquet(self._path("versions", batch_id))
            written = self.spark.read.schema(changed.schema).parquet(self._path("versions", batch_id)) \
                .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            self._write_hashes(written, self._path("hashes", batch_id))
            keyed = spread_text(written, "content", "id").withColumn("id", _version_id())
            index.write_postings(index.build_postings(keyed, "id", self.config, self.stop_words),
                                 self._path("postings", batch_id))
            counts = stats.batch_counts(statuses).withColumns({
                "date": F.to_date(as_of), "ms": F.lit(elapsed_ms() if elapsed_ms else None).cast("decimal(10,2)")})
            counts.write.mode("overwrite").parquet(self._path("counts", batch_id))
        finally:
            statuses.unpersist()
            valid.unpersist()

    def daily_stats(self) -> DataFrame | None:
        """Derived from the batch rows, so a repeated batch counts once."""
        counts = self.counts()
        return None if counts is None else stats.update_daily_stats(
            None, counts.withColumnRenamed("batch_id", "batch"))

    def search(self, queries: DataFrame, **options) -> DataFrame:
        """search() over the stored index.

        Replaced versions drop out in the join to the narrow columns of the pages; the
        text of the winners is then read from the log by their version.
        """
        postings, pages = self.postings(), self.pages()
        if postings is None or pages is None:
            raise ValueError(f"nothing is indexed in {self.root}")
        parsed = search.parse_queries(queries, self.config, self.stop_words)
        found = search.search(search.lookup(postings, parsed), pages.withColumn("id", _version_id()), queries,
                              texts=self._committed("versions").withColumn("id", _version_id()),
                              config=self.config, stop_words=self.stop_words, **options)
        return found.withColumn("id", F.substring("id", 1, 36))

    def compact(self, target: str) -> PageStore:
        """Write the current table as one batch of a new store.

        Postings are not built anew: those of current versions are kept and sorted as a
        whole. Versions keep the batch they came from, which their postings refer to. The
        state before the last batch is kept as well, so that this batch may run again.
        """
        pages, postings, counts = self.pages(), self.postings(), self.counts()
        if pages is None or postings is None or counts is None:
            raise ValueError(f"nothing is indexed in {self.root}")
        new = PageStore(self.spark, target, self.config, self.stop_words, self.prefix)
        last = counts.agg(F.max("batch_id")).first()[0]
        earlier = self.pages(before=last)
        kept = pages if earlier is None else pages.unionByName(
            earlier.join(pages.select("url_hash", *_VERSION), ["url_hash", *_VERSION], "left_anti"))
        kept.repartition("batch_id", F.pmod(F.xxhash64("url_hash"), F.lit(64))) \
            .sortWithinPartitions("batch_id", "domain", "created_at") \
            .write.mode("overwrite").partitionBy("batch_id").parquet(new._path("versions"))
        new._write_hashes(kept, new._path("hashes"), "batch_id")
        live = postings.drop("batch_id").join(pages.select(_version_id().alias("id"), "batch_id"), "id")
        index.cluster_postings(live.select("lexeme", "id", "batch_id", "positions"), new._path("base"))
        counts.write.mode("overwrite").partitionBy("batch_id").parquet(new._path("counts"))
        if exists(self.spark, self._path("streams")):
            self.spark.read.parquet(self._path("streams")).write.mode("overwrite").parquet(new._path("streams"))
        return new


def read_pages(spark: SparkSession, root: str) -> DataFrame | None:
    return PageStore(spark, root).pages()
