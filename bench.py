"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the number of cores.
"""

from __future__ import annotations

import json
import os
import time

from blogindex.plans import adapters, catalog
from blogindex.session import build_session

QUERIES = [
    "assemble_page", "extract_links", "block_domains", "admission_report", "tokens", "vocabulary", "tfidf",
    "score_linear", "validate", "upsert_status", "apply_upsert", "daily_stats", "content_duplicates",
    "postings", "search_ranked", "search_filtered", "search_totals", "corpus_summary", "stream_index",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    # Start the Python workers and let the JVM compile before anything is timed.
    for name in ("assemble_page", "search_ranked"):
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in QUERIES:
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    # A search on an index that is there already: the build is not timed.
    store = catalog._stream_store(spark, folder)
    start = time.time()
    store.search(adapters.queries(spark, folder)).write.format("noop").mode("overwrite").save()
    times["stored_search"] = round(time.time() - start, 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "ingest_pages_per_sec": round(docs / times["stream_index"], 1),
        "extract_pages_per_sec": round(pages / times["assemble_page"], 1)}))


if __name__ == "__main__":
    main()
