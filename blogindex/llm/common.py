"""Helpers shared by the operators: words, stored tables, ordered blocks, prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blogindex.session import new_work_dir


def words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Runs of bytes other than space and 0x09 to 0x0D; A to Z lower-cased, nothing else."""
    if not text:
        return []
    return text.lower().split() if lower else text.split()


def coded_words(texts: list[bytes | None], lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, numbers, ends): the words of all texts as numbers into the distinct ones, in the order in
    which these first occur, and how many words the texts up to each one have. The same words as words().
    """
    given = pa.array(texts, pa.large_binary()).view(pa.large_string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(given) if lower else given)
    coded = lists.values.dictionary_encode()
    # By way of numpy, as to_pylist takes a microsecond for each word.
    distinct, numbers = coded.dictionary.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    ends = lists.offsets.to_numpy()[1:]
    if b"" in distinct:  # beside blanks at the ends of a text
        none = distinct.index(b"")
        kept = numbers != none
        ends = np.r_[0, np.cumsum(kept)][ends]
        numbers = numbers[kept]
        numbers = numbers - (numbers > none)
        del distinct[none]
    return distinct, numbers, ends


def as_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes: what Python reads without decoding it."""
    return F.col(column).cast("string").cast("binary")


def text_rows(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[list, ...]]:
    """The columns of Arrow batches as lists, so few rows at a time that their words fit as well."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield tuple(c.to_pylist() for c in batch.slice(i, rows).columns)


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared work folder and read from there.

    Cuts the lineage: what follows survives the loss of an executor without computing
    anything before it again.
    """
    path = new_work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def block_starts(docs: DataFrame, key: str, rows: int) -> list[int]:
    """First key of each block of about so many rows, in order.

    Only keys are shuffled; one number per block comes to the driver.
    """
    keys = docs.select(F.col(key).cast("bigint").alias("k")).filter("k IS NOT NULL")
    blocks = max(1, -(-keys.count() // rows))
    ranged = keys.repartitionByRange(blocks, "k")
    firsts = ranged.groupBy(F.spark_partition_id().alias("b")).agg(F.min("k").alias("k")).collect()
    return sorted(r["k"] for r in firsts)


def in_blocks(docs: DataFrame, key: str, starts: list[int], and_next: bool = False) -> DataFrame:
    """The rows with block and borrowed, each block whole and sorted by key in one task.

    and_next also gives each block the first row of the block after it (the last block
    that of the first one), marked as borrowed. Rows without a key sort first.
    """
    firsts = np.array(starts or [0], dtype=np.int64)
    last = len(firsts) - 1

    @F.pandas_udf("array<int>")
    def places(k: pd.Series) -> pd.Series:
        missing = k.isna().to_numpy()
        value = k.fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64)
        at = np.clip(np.searchsorted(firsts, value, side="right") - 1, 0, last)
        edge = and_next & ~missing & (firsts[at] == value)
        return pd.Series([[b, -1 - (b - 1 if b else last)] if e else [b] for b, e in zip(at.tolist(), edge)])

    placed = docs.withColumn("_place", F.explode(places(F.col(key).cast("bigint"))))
    block = F.when(F.col("_place") < 0, -1 - F.col("_place")).otherwise(F.col("_place"))
    # A borrowed row sorts behind the block's own ones, also behind those of a wrapped key.
    return (placed.withColumn("block", block).withColumn("borrowed", F.col("_place") < 0).drop("_place")
            .repartition(last + 1, "block").sortWithinPartitions("block", "borrowed", key))


def sums_before(parts: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """parts with the sum of value over all rows before each one.

    order starts with a block number. Runs of 1,024 blocks are summed apart and only one
    row per run meets in one task.
    """
    runs = parts.withColumn("_run", F.floor(F.col(order[0]) / 1024))
    inside = Window.partitionBy("_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    totals = runs.groupBy("_run").agg(F.sum(value).alias("_sum"))
    totals = totals.select("_run", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return (runs.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(totals, "_run")
            .withColumn(name, F.col("_base") + F.col("_in")).drop("_run", "_in", "_base"))


def rows_of(columns: dict[str, pa.Array | np.ndarray | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
