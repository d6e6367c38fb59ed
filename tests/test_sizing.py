"""Sorts get parts whose size follows the text, not the number of files."""

from pyspark.sql import functions as F

from blogindex.plans import catalog, sizing
from tests.conftest import DATA


def test_parts_follow_the_text(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "texts")
    rows = [(i if i % 9 else None, None if i % 7 == 0 else "x" * 100) for i in range(700)]
    spark.createDataFrame(rows, "k INT, text STRING").coalesce(1).write.parquet(path)
    texts = spark.read.parquet(path)
    monkeypatch.setattr(sizing, "SORTED_CHARS", 1500)
    spread = sizing.spread_text(texts, "text", "k")
    assert spread.rdd.getNumPartitions() == 40
    assert sorted(map(repr, spread.collect())) == sorted(map(repr, texts.collect()))
    assert sizing.spread_text(texts.limit(0), "text", "k").count() == 0


def test_postings_are_sorted_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(sizing, "SORTED_CHARS", 10_000)
    files = catalog._postings(spark, DATA).select(F.input_file_name()).distinct().count()
    assert files > 2 * spark.sparkContext.defaultParallelism
