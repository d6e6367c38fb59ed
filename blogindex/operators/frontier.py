"""Crawl frontier: admission, outlinks and crawl waves over a page snapshot."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blogindex.functions import urls
from blogindex.operators import domains as dom
from blogindex.plans.sizing import chunk_of, sums_before
from blogindex.session import new_work_dir
from blogindex.settings import DEFAULTS


def seed_frontier(frontier: DataFrame, seeds: DataFrame) -> DataFrame:
    """The frontier, or the seeds with retries 0 when the frontier is empty."""
    fresh = seeds.select("location", F.lit(0).alias("retries"))
    return fresh if frontier.isEmpty() else frontier.select("location", "retries")


def frontier_size(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count("*").alias("size"))


def requeue_failed(frontier: DataFrame) -> DataFrame:
    """Items whose visited check failed, with one retry more."""
    return (frontier.filter("check_failed")
            .select("location", (F.col("retries") + 1).alias("retries"), "seq"))


def admit(frontier: DataFrame, visited: DataFrame,
          max_retries: int = DEFAULTS.max_retries) -> tuple[DataFrame, DataFrame]:
    """(admitted, visited after): first item of each new location under the retry cap.

    The first one is an aggregate, not a window, so map tasks reduce a location that
    many pages link to before it is shuffled.
    """
    first = (frontier.filter(F.col("retries") <= max_retries)
             .groupBy("location")
             .agg(F.min(F.struct("seq", "retries")).alias("_first"))
             .select("location", "_first.retries", "_first.seq"))
    admitted = first.join(visited.select("location"), "location", "left_anti")
    return admitted, visited.select("location").union(admitted.select("location"))


def list_flags(items: DataFrame, blocked: DataFrame | None, blacklist: DataFrame | None, key: str = "exact") -> DataFrame:
    """The items with _blocked and _black, true where a domain list holds their host."""
    if blocked is None:
        flags = items.withColumn("_blocked", F.lit(None).cast("boolean"))
    else:
        flags = items.withColumn("_host", F.lower(urls.hostname(F.col("location")))) \
            .join(dom.blocked_hosts(items, blocked, "location")
                  .select(F.col("host").alias("_host"), F.lit(True).alias("_blocked")),
                  "_host", "left").drop("_host")
    if blacklist is None:
        return flags.withColumn("_black", F.lit(None).cast("boolean"))
    return flags.withColumn("_host", dom.blacklist_key("location", key)).join(
        dom.blacklist_entries(blacklist, key).withColumn("_black", F.lit(True)),
        "_host", "left").drop("_host")


def admission_report(frontier: DataFrame, visited: DataFrame, blocked: DataFrame,
                     blacklist: DataFrame | None = None, max_retries: int = DEFAULTS.max_retries,
                     key: str = "exact") -> DataFrame:
    """Each frontier item with the first reason it is dropped for, or 'admitted'.

    frontier: (location, retries, seq[, check_failed]). An item whose check failed goes
    back to the queue ('requeued') and does not mark its location as visited.
    """
    if "check_failed" not in frontier.columns:
        frontier = frontier.withColumn("check_failed", F.lit(False))
    items = frontier.withColumn("_live", (F.col("retries") <= max_retries) & ~F.col("check_failed"))
    firsts = items.filter("_live").groupBy("location").agg(F.min("seq").alias("_first"))
    firsts = firsts.join(visited.select("location", F.lit(True).alias("_seen")).distinct(),
                         "location", "left")
    flags = list_flags(firsts, blocked, blacklist, key)
    joined = items.join(flags, "location", "left")
    reason = (F.when(F.col("retries") > max_retries, "retries")
              .when(F.col("check_failed"), "requeued")
              .when(F.col("_seen") | (F.col("seq") > F.col("_first")), "visited")
              .when(~urls.parses(F.col("location")), "malformed")
              .when(F.col("_blocked"), "blocked")
              .when(F.col("_black"), "blacklisted")
              .otherwise("admitted"))
    return joined.select("seq", "location", "retries", reason.alias("reason"))


def expand_links(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep..., pos, location, retries): one frontier item per link, duplicates kept."""
    return _each_link(pages.select(*keep, F.posexplode_outer("links").alias("pos", "location"))) \
        .withColumn("retries", F.lit(0))


def _each_link(exploded: DataFrame) -> DataFrame:
    """Without the row of an empty list; the inner form would compute the list twice."""
    return exploded.filter("pos IS NOT NULL")


def _numbered(df: DataFrame, parent: str, order: list[str], start: int, span: int) -> DataFrame:
    """Dense numbers in the given order, without one task that sees all rows.

    Rows are numbered inside chunks of parents; only the chunk sizes, one row per
    span of parents, are summed in order, again in runs.
    """
    chunked = df.withColumn("_chunk", chunk_of(F.col(parent), span))
    sizes = chunked.groupBy("_chunk").agg(F.count("*").alias("_size"))
    offsets = sums_before(sizes, "_chunk", ["_size"]).withColumnRenamed("_o__size", "_offset")
    inside = Window.partitionBy("_chunk").orderBy(*order)
    return (chunked.withColumn("_row", F.row_number().over(inside))
            .join(offsets, "_chunk")
            .withColumn("seq", F.col("_offset") + F.col("_row") + (start - 1))
            .drop("_chunk", "_offset", "_row"))


class VisitedTable:
    """What a crawl has admitted, dealt into buckets of the location's hash.

    The table is bucketed on disk as a shuffle deals rows out, so the join of a wave to it
    moves the wave only. A wave is appended as a partition of its own.
    """

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.path = new_work_dir(spark, "visited")
        self.name = "visited_" + self.path.rsplit("-", 1)[-1]
        self.empty = True

    def append(self, rows: DataFrame, wave: int) -> None:
        (rows.withColumn("wave", F.lit(wave)).repartition(self.buckets, "location")
         .write.format("parquet").mode("append").partitionBy("wave").bucketBy(self.buckets, "location")
         .option("path", self.path).saveAsTable(self.name))
        self.empty = False

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, rows: DataFrame) -> DataFrame:
        return rows if self.empty else rows.join(self.rows().select("location"), "location", "left_anti")

    def close(self) -> DataFrame:
        """All rows, read from the files; the name is given up."""
        schema = self.rows().schema
        self.spark.sql(f"DROP TABLE {self.name}")  # external: the files stay
        return self.spark.read.schema(schema).parquet(self.path)


def crawl_waves(seeds: DataFrame, pages: DataFrame, max_waves: int | None = None,
                blocked: DataFrame | None = None,
                route: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
                key: str = "exact", span: int = 10_000, buckets: int | None = None) -> DataFrame:
    """(location, wave, seq): what a crawl of the snapshot admits, in queue order.

    seeds: (location, seq); pages: (location, links, ...). Each wave admits the new
    locations, looks up their pages and queues the links. route(pages) may return
    (pages to follow, domains to blacklist); the set applies from the next wave on.
    Each wave is written to the visited table in the shared folder, so lineage stays short,
    an executor's loss costs no earlier wave, and a wave's shuffle depends on the wave only
    (buckets: as many as a shuffle has partitions). The crawl ends when the frontier is
    empty; with max_waves, a crawl that is not done by then is an error.
    """
    spark = seeds.sparkSession
    frontier = seeds.select("location", "seq")
    done = VisitedTable(spark, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    black: DataFrame | None = None
    start = 0
    for wave in itertools.count():
        new = done.unseen(frontier.groupBy("location").agg(F.min("seq").alias("_order")))
        parent = F.col("_order") if wave == 0 else F.col("_order.parent")
        new = _numbered(new.withColumn("_parent", parent), "_parent", ["_order", "location"],
                        start, span)
        done.append(new.select("location", F.col("seq").cast("bigint").alias("seq")), wave)
        new = done.rows().filter(F.col("wave") == wave)
        count = new.count()
        if count == 0:
            break
        if max_waves is not None and wave >= max_waves:
            raise RuntimeError(f"{count} locations are left after {max_waves} waves")
        start += count
        live = new.filter(urls.parses(F.col("location")))
        if blocked is not None:
            live = dom.block_domains(live, blocked, "location")
        live = dom.drop_blacklisted(live, black, "location", key)
        fetched = pages.join(live.select("location", "seq"), "location")
        if route is not None:
            fetched, more = route(fetched)
            black = more.select("domain") if black is None else black.union(more.select("domain"))
            black = black.distinct().checkpoint()
        frontier = (_each_link(fetched.select(F.col("seq").alias("_parent"), F.posexplode_outer("links")
                                              .alias("pos", "location")))
                    .select("location", F.struct(F.col("_parent").alias("parent"), "pos").alias("seq")))
    return done.close().select("location", "wave", "seq")
