"""Validation, fingerprints and the ordered upsert of crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blogindex import schemas
from blogindex.functions import text as tx
from blogindex.functions import urls
from blogindex.functions.ids import uuid_from_hash
from blogindex.plans.sizing import chunk_of
from blogindex.settings import DEFAULTS, Settings

ACCEPTED, SKIPPED, ERROR = "accepted", "skipped", "error"
INSERTED, UPDATED = "inserted", "updated"
# Widths of the stored columns.
MAX_URL, MAX_AUTHOR, MAX_DOMAIN = 2048, 512, 255


def coerce_lists(df: DataFrame) -> DataFrame:
    """Null lists become empty ones."""
    empty = F.expr("cast(array() as array<string>)")
    return df.withColumns({c: F.coalesce(F.col(c), empty)
                           for c in schemas.LIST_COLUMNS if c in df.columns})


def gate(settings: Settings = DEFAULTS, type_error: Column | None = None) -> Column:
    """accepted, skipped or error; needs location, title, author, text."""
    length = F.length("text")
    no_title = F.coalesce(F.col("title"), F.lit("")) == ""
    bad = ~urls.valid_location(F.col("location"))
    if type_error is not None:
        bad = bad | type_error
    too_wide = ((F.length("location") > MAX_URL)
                | (F.length(F.coalesce("author", F.lit(""))) > MAX_AUTHOR)
                | (F.length(urls.domain(F.col("location"))) > MAX_DOMAIN))
    return (F.when(bad, ERROR)
            .when((length < settings.min_content_length) | (length > settings.max_content_length),
                  SKIPPED)
            .when(no_title & (tx.strip(F.col("text")) == ""), SKIPPED)
            .when(too_wide, ERROR)
            .otherwise(ACCEPTED))


def validate(df: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages with their content as one text and the gate's status."""
    listed = coerce_lists(df).withColumn("text", tx.content_text(F.col("content")))
    bad_type = F.col("type_error") if "type_error" in df.columns else None
    return listed.withColumn("status", gate(settings, bad_type))


def indexed_page(validated: DataFrame, as_of: Column, created_at_unit: str = "s") -> DataFrame:
    """Stored form of validated pages: url, hashes, domain, word count and creation time."""
    if created_at_unit not in ("s", "ms"):
        raise ValueError(f"unknown created_at_unit: {created_at_unit}")
    given = F.nullif(F.col("created_at"), F.lit(0))
    if created_at_unit == "ms":
        given = F.floor(given / 1000).cast("bigint")
    url_hash = tx.url_hash(F.col("location"))
    rest = [c for c in validated.columns
            if c in ("seq", "status", "batch_id")]
    return validated.select(
        *rest,
        uuid_from_hash(url_hash).alias("id"),
        F.col("location").alias("url"),
        url_hash.alias("url_hash"),
        "title", "description", "author", "headings",
        F.col("text").alias("content"),
        "keywords", "links", "script_links",
        urls.domain(F.col("location")).alias("domain"),
        tx.content_hash(F.col("title"), F.col("text")).alias("content_hash"),
        tx.word_count(F.col("text")).alias("word_count"),
        F.coalesce(given, F.unix_timestamp(as_of)).alias("created_at"))


def upsert_status(pages: DataFrame, current: DataFrame | None, span: int = 1_000_000) -> DataFrame:
    """Accepted pages (url_hash, content_hash, seq, ...) with inserted, updated or skipped.

    The state after any row is that row's hash, so each row compares with the one before
    it of the same URL, or with the stored hash. One URL may fill much of a batch, so the
    row before is found inside (url, chunk of arrival numbers); the last hash of each
    chunk then reaches the next chunk through a table of one row per url and chunk.
    """
    rows = pages.withColumn("_chunk", chunk_of(F.col("seq"), span))
    lasts = rows.groupBy("url_hash", "_chunk").agg(F.max_by("content_hash", "seq").alias("_last"))
    chain = Window.partitionBy("url_hash").orderBy("_chunk")
    carried = lasts.select("url_hash", "_chunk", F.lag("_last").over(chain).alias("_carried"))
    if current is None:
        carried = carried.withColumn("_stored", F.lit(None).cast("string"))
    else:
        carried = carried.join(
            current.select("url_hash", F.col("content_hash").alias("_stored")), "url_hash", "left")
    inside = Window.partitionBy("url_hash", "_chunk").orderBy("seq")
    before = F.coalesce(F.lag("content_hash").over(inside), F.col("_carried"), F.col("_stored"))
    status = (F.when(F.col("_before").isNull(), INSERTED)
              .when(F.col("_before") == F.col("content_hash"), SKIPPED)
              .otherwise(UPDATED))
    return (rows.join(carried, ["url_hash", "_chunk"])
            .withColumn("_before", before)
            .withColumn("status", status)
            .drop("_chunk", "_carried", "_stored", "_before"))


def full_status(validated: DataFrame, current: DataFrame | None, span: int = 1_000_000) -> DataFrame:
    """(seq, url_hash, status) of every page of a batch, gated ones included.

    Reads only the narrow columns the decision needs.
    """
    narrow = validated.select(
        "seq", "status", tx.url_hash(F.col("location")).alias("url_hash"),
        tx.content_hash(F.col("title"), F.col("text")).alias("content_hash"))
    accepted = upsert_status(narrow.filter(F.col("status") == ACCEPTED), current, span)
    return accepted.select("seq", "url_hash", "status").union(
        narrow.filter(F.col("status") != ACCEPTED).select("seq", "url_hash", "status"))


def new_versions(pages: DataFrame, statuses: DataFrame) -> DataFrame:
    """The rows of a batch that change the table."""
    return pages.drop("status").join(
        statuses.filter(F.col("status").isin(INSERTED, UPDATED)).select("seq", "url_hash", "status"),
        ["seq", "url_hash"])


def latest_versions(versions: DataFrame, order: list[str]) -> DataFrame:
    """The last version of each URL, with the index time of its first one.

    The winner is found on narrow columns with map-side reduction; wide rows then meet
    it on the full version key, which no URL can make hot.
    """
    winners = versions.groupBy("url_hash").agg(
        F.max(F.struct(*order)).alias("_key"), F.min("indexed_at").alias("_first"))
    winners = winners.select("url_hash", *[F.col(f"_key.{c}").alias(c) for c in order], "_first")
    return (versions.join(winners, ["url_hash", *order])
            .withColumn("indexed_at", F.col("_first")).drop("_first"))


def apply_upsert(pages: DataFrame, statuses: DataFrame, current: DataFrame | None, as_of: Column
                 ) -> DataFrame:
    """The page table after a batch.

    current carries STORED_COLUMNS, indexed_at and updated_at. Stored rows that the batch
    replaces give only their first index time to the new row.
    """
    written = latest_versions(
        new_versions(pages, statuses).withColumns({"indexed_at": as_of, "updated_at": as_of}), ["seq"])
    columns = [*schemas.STORED_COLUMNS, "indexed_at", "updated_at"]
    if current is None:
        return written.select(*columns)
    old_times = current.select("url_hash", F.col("indexed_at").alias("_first"))
    changed = (written.join(old_times, "url_hash", "left")
               .withColumn("indexed_at", F.coalesce("_first", "indexed_at")))
    kept = current.join(written.select("url_hash"), "url_hash", "left_anti")
    return kept.select(*columns).union(changed.select(*columns))


def content_duplicates(pages: DataFrame) -> DataFrame:
    """(content_hash, pages, first_url): equal content under several URLs."""
    return (pages.groupBy("content_hash")
            .agg(F.count("*").alias("pages"), F.min("url").alias("first_url"))
            .filter("pages > 1"))
