"""First sightings of locations as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ITEM = Row("seq", "location", "retries", "reason")
ITEM_DDL = "seq bigint, location string, retries int, reason string"


def require_rocksdb(spark: SparkSession) -> None:
    """The visited set outgrows the heap, so the state has to lie in RocksDB."""
    if not (spark.conf.get(_PROVIDER, None) or "").endswith(".RocksDBStateStoreProvider"):
        raise ValueError(f"set {_PROVIDER} to Spark's RocksDBStateStoreProvider")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session beside this one, on the same cluster, whose streams keep state in RocksDB."""
    new = spark.newSession()
    new.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return new


class FirstSighting(StatefulProcessor):
    """Marks the first item of a location, in order of seq, and the others as visited.

    The state of a location is the place and the retries of the item that was first. Of the
    rows of one micro-batch only the best so far is held, so a location that much of the web
    links to takes no more memory than any other.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seq BIGINT, retries INT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        open_, best = not self.seen.exists(), None
        for row in rows:
            if not open_:
                late = row
            elif best is None or row.seq < best.seq:
                late, best = best, row
            else:
                late = row
            if late is not None:
                yield _ITEM(late.seq, late.location, late.retries, "visited")
        if best is not None:
            self.seen.update((best.seq, best.retries))
            yield _ITEM(best.seq, best.location, best.retries, "first")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((-1, 0))

    def close(self) -> None:
        pass


def sightings(items: DataFrame, max_retries: int, visited: DataFrame | None = None) -> DataFrame:
    """(seq, location, retries, reason) of a stream of (location, retries, seq, check_failed).

    reason is 'retries' or 'requeued' for items that leave no mark, else 'first' or
    'visited'. visited (location) is known before the stream starts. Items without a
    location never reach the state: their reason is 'first', as no two of them are the same.
    """
    require_rocksdb(items.sparkSession)
    dead = F.when(F.col("retries") > max_retries, "retries").when(F.col("check_failed"), "requeued") \
        .when(F.col("location").isNull(), "first")
    marked = items.withColumn("_dead", dead)
    columns = [F.col("seq").cast("bigint"), "location", F.col("retries").cast("int")]
    live = marked.filter("_dead IS NULL").select(*columns)
    known = visited.filter("location IS NOT NULL").select("location").distinct().groupBy("location") if visited is not None else None
    kept = live.groupBy("location").transformWithState(
        FirstSighting(), ITEM_DDL, outputMode="Append", timeMode="None", initialState=known)
    return kept.unionByName(marked.filter("_dead IS NOT NULL").select(*columns, F.col("_dead").alias("reason")))
