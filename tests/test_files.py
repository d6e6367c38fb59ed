"""Files that jobs leave or look up."""

import json

from pyspark.sql import functions as F

from blogindex.operators import index
from blogindex.session import dropped_shuffles
from blogindex.sources import records


def test_corpus_lists_folders(spark, tmp_path):
    """Each folder is listed once, no page file is looked up on its own; only files right in a folder count."""
    for root in ("pos", "neg"):
        for folder in ("a", "site=b c", "a/deeper"):
            (tmp_path / root / folder).mkdir(parents=True, exist_ok=True)
            for k in range(3):
                (tmp_path / root / folder / f"{k}.json").write_text(json.dumps({"title": f"{folder} {k}", "content": ["x"]}, indent=1))
        (tmp_path / root / "stray.json").write_text(json.dumps({"title": "stray", "content": ["x"]}))
        (tmp_path / root / "a" / "note.txt").write_text("no")
    got = records.read_corpus(spark, str(tmp_path / "pos"), str(tmp_path / "neg"))
    want = sorted((f"{folder} {k}", label) for folder in ("a", "site=b c") for k in range(3) for label in (0.0, 1.0))
    assert sorted((r["title"], r["label"]) for r in got.collect()) == want
    scans = got._jdf.queryExecution().analyzed().collectLeaves()
    paths = [scans.apply(i).relation().location().rootPaths().size() for i in range(scans.size())]
    assert max(paths) <= 3


def test_shuffles_of_written_postings_are_dropped(spark, tmp_path):
    """The rest of a job's shuffle is gone once the postings are there, and the setting is as before."""
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    held = tracker.shuffleStatuses().size()
    rows = spark.range(1000).select(F.col("id").cast("string").alias("lexeme"), "id", F.array(F.struct(
        F.col("id").cast("int").alias("pos"), F.lit("A").alias("w"))).alias("positions")).repartition(7, "id")
    index.write_postings(rows, str(tmp_path / "postings"))
    assert spark.read.parquet(str(tmp_path / "postings")).count() == 1000
    assert tracker.shuffleStatuses().size() <= held + 1  # that of the count
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == before
    with dropped_shuffles(spark):
        assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
