"""Batch counts, daily statistics, running totals and the corpus summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blogindex.plans.sizing import chunk_of, sums_before
from blogindex.schemas import STATS_COUNTERS

COUNTS = ["processed", "inserted", "updated", "skipped", "errors"]
_MS = "decimal(10,2)"
# Largest value of the mean column in hundredths; that many halvings close any gap.
_MAX_CENTS = 9_999_999_999
_SETTLED = 64


def batch_counts(statuses: DataFrame, *keys: str) -> DataFrame:
    """Counts per batch. An error is also a processed page."""
    def of(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    return statuses.groupBy(*keys).agg(
        F.count("*").alias("processed"), of("inserted").alias("inserted"),
        of("updated").alias("updated"), of("skipped").alias("skipped"),
        of("error").alias("errors"))


def _step(value: Column, cents: Column) -> Column:
    """One update of the running mean: half of the sum, rounded half up, in hundredths."""
    return F.floor((value + cents + 1) / 2).cast("bigint")


def _fold(start: Column, steps: Column) -> Column:
    return F.aggregate(steps, start.cast("bigint"), _step)


def running_mean(batches: DataFrame, start: DataFrame | None = None, span: int = 100_000
                 ) -> DataFrame:
    """(date, mean): the ordered fold mean := round((mean + ms) / 2, 2) over a day's batches.

    The first batch sets the mean; a null time keeps it; a null mean counts as 0 once a
    time arrives. Rounding at each step makes the fold depend on the order, yet it splits:
    a chunk of batches maps the incoming mean to the outgoing one by a rising function
    that, after enough halvings, takes two neighbouring values at most, so two results and
    the threshold between them describe the chunk exactly. Short chunks keep their times.
    Times are not negative. start is the stored state (date, mean), if any.
    """
    rows = batches.select("date", "batch", F.round(F.col("ms") * 100).cast("bigint").alias("_x"))
    firsts = rows.groupBy("date").agg(
        F.min("batch").alias("_first"), F.min_by("_x", "batch").alias("_x0"))
    firsts = firsts.withColumn("_insert", F.lit(True))
    if start is not None:
        stored = start.select("date", F.round(F.col("mean") * 100).cast("bigint").alias("_s"),
                              F.lit(True).alias("_known"))
        # A known day starts from its stored mean and also folds the first batch.
        firsts = firsts.join(stored, "date", "full").select(
            "date", F.when(F.col("_known"), F.lit(None)).otherwise(F.col("_first")).alias("_first"),
            F.when(F.col("_known"), F.col("_s")).otherwise(F.col("_x0")).alias("_x0"))
    else:
        firsts = firsts.select("date", "_first", "_x0")
    steps = (rows.join(firsts.select("date", "_first"), "date")
             .filter("_x IS NOT NULL AND (_first IS NULL OR batch > _first)")
             .groupBy("date", chunk_of(F.col("batch"), span).alias("_chunk"))
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("batch", "_x"))),
                              lambda s: s["_x"]).alias("_xs")))
    low, high = _fold(F.lit(0), F.col("_xs")), _fold(F.lit(_MAX_CENTS), F.col("_xs"))
    steps = steps.withColumns({"_low": low, "_high": high})
    threshold = F.when(F.col("_low") == F.col("_high"), F.lit(0).cast("bigint")).otherwise(
        F.aggregate(F.reverse("_xs"), F.col("_high"), lambda t, x: 2 * t - 1 - x))
    settled = F.size("_xs") >= _SETTLED
    parts = steps.select(
        "date", F.struct(
            "_chunk",
            F.when(~settled, F.col("_xs")).alias("xs"),
            F.col("_low").alias("low"), F.col("_high").alias("high"),
            F.when(settled, threshold).alias("cut")).alias("_part"))
    chains = parts.groupBy("date").agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    folded = F.aggregate(
        F.col("_parts"), F.coalesce(F.col("_x0"), F.lit(0)).cast("bigint"),
        lambda v, p: F.when(p["xs"].isNotNull(), _fold(v, p["xs"]))
        .when(v >= p["cut"], p["high"]).otherwise(p["low"]))
    mean = F.when(F.col("_parts").isNull(), F.col("_x0")).otherwise(folded)
    return (firsts.join(chains, "date", "left")
            .select("date", (mean.cast("decimal(12,0)") / 100).cast(_MS).alias("mean")))


def update_daily_stats(stats: DataFrame | None, batches: DataFrame, as_of: Column | None = None,
                       span: int = 100_000) -> DataFrame:
    """Statistics per day after more batches (batch, date, counts, ms)."""
    new = batches.groupBy("date").agg(
        *[F.sum(c).cast("bigint").alias(s) for s, c in STATS_COUNTERS.items()])
    start = None
    if stats is not None:
        new = (stats.select("date", *STATS_COUNTERS).union(new)
               .groupBy("date").agg(*[F.sum(s).cast("bigint").alias(s) for s in STATS_COUNTERS]))
        start = stats.select("date", F.col("avg_processing_time_ms").alias("mean"))
    out = new.join(running_mean(batches, start, span)
                   .withColumnRenamed("mean", "avg_processing_time_ms"), "date", "left")
    if stats is not None:
        old = stats.select("date", F.col("avg_processing_time_ms").alias("_old"))
        out = out.join(old, "date", "left").withColumn(
            "avg_processing_time_ms", F.coalesce("avg_processing_time_ms", "_old")).drop("_old")
    return out if as_of is None else out.withColumn("last_updated", as_of)


def stats_for(stats: DataFrame, date: dt.date) -> DataFrame:
    """The row of one day, or zeros and no mean."""
    day = stats.sparkSession.range(1).select(F.lit(date).alias("date"))
    found = stats.filter(F.col("date") == F.lit(date))
    return day.join(found, "date", "left").select(
        "date", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in STATS_COUNTERS],
        F.col("avg_processing_time_ms").cast(_MS).alias("avg_processing_time_ms"))


def page_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"))


def running_totals(df: DataFrame, order: str, columns: list[str], span: int = 100_000) -> DataFrame:
    """Sums of the columns over all rows up to each one, in order of a dense number.

    Chunks are summed in parallel, then runs of their totals, one row each; only one row
    per run passes through an ordering of the whole.
    """
    rows = df.withColumn("_chunk", chunk_of(F.col(order), span))
    totals = rows.groupBy("_chunk").agg(*[F.sum(c).alias(c) for c in columns])
    offsets = sums_before(totals, "_chunk", columns)
    inside = Window.partitionBy("_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({f"_r_{c}": F.sum(c).over(inside) for c in columns})
    others = [c for c in df.columns if c not in columns]
    return summed.join(offsets, "_chunk").select(
        *others, *[(F.col(f"_r_{c}") + F.col(f"_o_{c}")).cast("bigint").alias(c) for c in columns])


def session_totals(batches: DataFrame, span: int = 100_000) -> DataFrame:
    return running_totals(batches.select("batch", *COUNTS), "batch", COUNTS, span)


def corpus_summary(pages: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: pages, mean words, distinct domains, newest page."""
    distinct = F.approx_count_distinct("domain") if approximate else F.countDistinct("domain")
    mean = F.round(F.coalesce(F.avg("word_count"), F.lit(0.0)), 2)
    return pages.agg(
        F.count("*").alias("total_pages"), mean.alias("average_word_count"),
        distinct.alias("unique_domains"), F.max("created_at").alias("latest_page_timestamp"))


def whole_words(mean: Column) -> Column:
    return F.floor(mean + 0.5).cast("bigint")


def summary_change(snapshots: DataFrame) -> DataFrame:
    """Growth of the counters since the snapshot before; no growth shows as 0.

    Snapshots are numbered one by one, so the one before is an equi-join away.
    """
    counters = ["total_pages", "unique_domains"]
    before = snapshots.select((F.col("snapshot") + 1).alias("snapshot"),
                              *[F.col(c).alias(f"_{c}") for c in counters])
    return snapshots.join(before, "snapshot", "left").select(
        "snapshot", *counters,
        *[F.greatest(F.coalesce(F.col(c) - F.col(f"_{c}"), F.lit(0)), F.lit(0))
          .cast("bigint").alias(f"{c}_growth") for c in counters])
