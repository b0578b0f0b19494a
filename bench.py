"""Headline queries timed on one machine. Prints one JSON line.

Each query is planned and run to the end into a sink that drops the rows: once cold, then warm.
``value`` is the sum of the warm times. ``BENCH_QUERIES=all`` times every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "folder_structure_of_pages", "catalog_feed", "natural_order", "books_by_author", "changed_items", "orphan_items",
    "plan_events", "dataset_fingerprint", "book_entry_rows", "feed_documents", "parse_feed_entries", "safe_links",
    "broken_links", "section_progress", "section_at_fraction", "toc_at_section", "dictionary_lookup", "text_search",
    "hits_by_document", "phrase_search", "text_words", "text_blocks", "classify_events", "suppress_events",
    "suppress_one_key", "apply_events", "sample_every_n", "trend_slope", "vector_rmse", "epub_metadata",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from shelfspark.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    cold, warm = {}, {}
    for name in names:
        for i in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = round(time.perf_counter() - start, 3)
            cold.setdefault(name, took)
            warm[name] = took
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr)
    total = round(sum(warm.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "warm total", "value": total, "unit": "sec", "queries": warm, "cold": cold, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
