"""The source of change logs: ranges, whole lines, a stream that is stopped and started again."""

import json
import os
import tempfile

from shelfspark.sources import event_source
from shelfspark.sinks.buckets import BucketedTable
from shelfspark.streaming.catalog import CatalogStream, default_entries


def line(i, size=0):
    return json.dumps({"parent": "/books/", "name": f"é{i}{'x' * size}.epub", "events": "CLOSE_WRITE"}, ensure_ascii=False)


def test_ranges_have_every_line_once(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    lines = [[line(i, i * 7 % 50) for i in range(60)], [], [line(100), "", "x", line(101)], [line(i) for i in range(200, 240)]]
    for n, part in enumerate(lines):
        with open(f"{base}/{n:03d}.jsonl", "w") as file:
            file.write("\n".join(part) + ("\n" if part and n != 2 else ""))
    with open(f"{base}/.hidden", "w") as file:
        file.write("no\n")
    wanted = [x for part in lines for x in part if x]
    for size in (1, 7, 100, 1 << 20):
        rows = [r for p in event_source.ranges(base, 0, 1 << 40, size) for r in event_source.read_range(p)]
        assert [r[2] for r in rows] == wanted and [r[0] for r in rows] == sorted({r[0] for r in rows})
    got = event_source.read_events(spark, base, partBytes=500)
    assert got.rdd.getNumPartitions() > 5
    assert [r.value for r in got.orderBy("seq").collect()] == wanted


def test_positions_lie_at_ends_of_lines():
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert event_source.log_end(base) == 0
    with open(f"{base}/a", "w") as file:
        file.write("one\ntwo\nthr")
    assert event_source.log_end(base) == 8
    with open(f"{base}/b", "w") as file:
        file.write("x" * 200_000)
    assert event_source.log_end(base) == 11


def test_stream_goes_on_where_it_stopped(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{base}/log")
    job = CatalogStream("/books", f"{base}/tables", buckets=4)
    job.register("BookCreated", default_entries)
    entries = BucketedTable(spark, f"{base}/tables/entries", buckets=4)

    def run(**options):
        job.start(event_source.read_events(spark, f"{base}/log", stream=True, **options), f"{base}/checkpoint").awaitTermination()
        return sorted(r.path for r in entries.read().collect())

    with open(f"{base}/log/1.jsonl", "w") as file:
        file.write(f"{line(1)}\n{line(2)}\n{line(3)}")
    assert run(partBytes=10) == ["é1.epub", "é2.epub"]
    with open(f"{base}/log/1.jsonl", "a") as file:
        file.write("\n")
    with open(f"{base}/log/2.jsonl", "w") as file:
        file.write(f"{line(4)}\nnot json\n")
    assert run() == ["é1.epub", "é2.epub", "é3.epub", "é4.epub"]
    log = spark.read.parquet(f"{base}/tables/event_log").collect()
    assert len(log) == len({r.seq for r in log}) == 4
    assert spark.read.parquet(f"{base}/tables/rejected").count() == 1
