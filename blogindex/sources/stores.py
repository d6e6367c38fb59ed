"""Page files on disk: JSON writer, host-partitioned store, lookup, stage append."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blogindex import schemas
from blogindex.functions import urls
from blogindex.functions.ids import uuid_from_hash


def page_json(df: DataFrame, created_at_unit: str = "s") -> DataFrame:
    """(value): one JSON text per page, all fields present, created_at in milliseconds."""
    created = (F.col("created_at") * (1000 if created_at_unit == "s" else 1)).alias("created_at")
    record = F.struct(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in schemas.TEXT_COLUMNS
                        else F.col(c) for c in schemas.PAGE_COLUMNS[:-1]], created)
    return df.select(F.to_json(record, {"ignoreNullFields": "false"}).alias("value"))


def write_pages_json(df: DataFrame, path: str, created_at_unit: str = "s") -> None:
    page_json(df, created_at_unit).write.mode("append").text(path)


# Folders of a lookup that go into the scan as a filter; more are left to the join.
_FOLDERS = 10_000


def store_pages(df: DataFrame, root: str, rows_per_file: int = 10_000) -> None:
    """Append pages under host=<hostname>/slot=<n>, each with an id, and (id, host, slot) to a directory.

    A host has as many slots as its pages of this call need, so one that holds much of the
    crawl is written by many tasks, and a small one has one file.
    """
    named = df.withColumn("host", urls.hostname(F.col("location"))) \
        .withColumn("id", uuid_from_hash(F.sha2("location", 256)))
    slots = named.groupBy("host").agg(F.ceil(F.count("*") / rows_per_file).alias("_slots"))
    # A null host has a folder as well, but matches nothing in a plain join.
    placed = named.join(slots.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))) \
        .withColumn("slot", F.pmod(F.xxhash64("location"), "_slots").cast("int")).drop("_slots", "_host")
    placed.repartition("host", "slot") \
        .write.mode("append").option("ignoreNullFields", "false").partitionBy("host", "slot").json(root)
    placed.select("id", "host", "slot").distinct().write.mode("append").parquet(f"{root}/_directory")


def lookup_pages(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """Stored pages by id; opens only the folders that the directory names for them."""
    wanted = ids.select("id").distinct()
    stored = spark.read.schema(f"id STRING, host STRING, slot INT, {schemas.PAGE}").json(root)
    folder = F.concat_ws("/", F.coalesce("host", F.lit("")), F.col("slot").cast("string"))
    directory = spark.read.schema("id STRING, host STRING, slot INT").parquet(f"{root}/_directory")
    folders = [r["folder"] for r in directory.join(wanted, "id", "left_semi").select(folder.alias("folder"))
               .distinct().limit(_FOLDERS + 1).collect()]
    if len(folders) <= _FOLDERS:
        stored = stored.filter(folder.isin(folders))
    return stored.drop("slot").join(wanted, "id", "left_semi")


def append_stage(df: DataFrame, path: str) -> None:
    """Append records as JSON lines to the next stage's folder."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)
