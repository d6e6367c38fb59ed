"""Line lists: crawl seeds and blocked domains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blogindex.functions import urls


def read_seeds(spark: SparkSession, path: str, on_bad: str = "fail") -> DataFrame:
    """(seq, location): one URL per line, numbered by file path and place in the file, blank lines kept.

    A line that is no URL fails the job, whichever columns are used, or is left out with
    on_bad='drop' (its number too is left out). Lines are numbered inside their file block;
    only the sizes of the blocks are summed in order.
    """
    if on_bad not in ("fail", "drop"):
        raise ValueError(f"unknown on_bad: {on_bad}")
    block = ["_file", "_start"]
    lines = spark.read.text(path).select(
        F.col("value").alias("location"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy(*block).agg(F.count("*").alias("_n")).select(
        *block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(*block).orderBy("_row")) - 1
    numbered = lines.withColumn("_place", place).join(offsets, block) \
        .select((F.col("_offset") + F.col("_place")).alias("seq"), "location")
    good = urls.parses(F.col("location"))
    if on_bad == "drop":
        return numbered.filter(good)
    message = F.concat(F.lit("seed line is no URL: "), F.col("location"))
    return numbered.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """(domain): lower-cased, otherwise as written; an empty path is an empty list."""
    if not path:
        return spark.createDataFrame([], "domain STRING")
    return spark.read.text(path).select(F.lower("value").alias("domain")).distinct()


def domain_table(spark: SparkSession, domains: list[str]) -> DataFrame:
    return spark.createDataFrame([(d.lower(),) for d in domains], "domain STRING").distinct()
