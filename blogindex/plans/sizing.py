"""Where data size decides the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key when the input has fewer tasks than there are cores.

    A large scan already has more, and is left alone: it needs no shuffle. For scans only:
    counting the tasks of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


# Characters of text whose postings a task sorts in memory.
SORTED_CHARS = 4_000_000


def spread_text(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """Hash-partition by key so that a task has about SORTED_CHARS characters of text and no core is without one.

    A task that sorts the words of its rows then never spills: the texts move once, and they
    are a small part of what their words take in a sort. For scans only, as spread.
    """
    held = df.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(-(-held // SORTED_CHARS), df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, *keys)


def chunk_of(seq: Column, span: int) -> Column:
    """Number of the run of arrival numbers a row belongs to.

    Arrival numbers are queue offsets, so a chunk holds about span rows whatever
    the keys are; ordered work on a hot key then splits by chunk.
    """
    return F.floor(seq / F.lit(span)).cast("bigint")


def sums_before(totals: DataFrame, chunk: str, columns: list[str]) -> DataFrame:
    """(chunk, _o_<column>...): sums over all chunks before each one, of one row per chunk.

    Runs of 1,024 chunks are summed apart; only one row per run meets in one task.
    """
    runs = totals.withColumn("_run", F.floor(F.col(chunk) / 1024))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    whole = runs.groupBy("_run").agg(*[F.sum(c).alias(c) for c in columns])
    base = whole.select("_run", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy("_run").orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    summed = runs.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in columns})
    return summed.join(base, "_run").select(chunk, *[(F.col(f"_i_{c}") + F.col(f"_b_{c}")).alias(f"_o_{c}") for c in columns])
