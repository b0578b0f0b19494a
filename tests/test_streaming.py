"""Stream jobs: state over batches, catalog kept up to date, failures set aside."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from shelfspark.operators.events import handler_log, handler_statistics
from shelfspark.sinks.buckets import BucketedTable, apply_to_buckets
from shelfspark.streaming import catalog
from shelfspark.streaming.catalog import CatalogStream, default_entries
from shelfspark.streaming.suppress import STATE_PROVIDER, suppress_live

SCHEMA = "seq long, ms long, value string"


def raw(parent, name, events):
    return json.dumps({"parent": parent, "name": name, "events": events})


def stream_of(spark, base, batches):
    """A stream that reads one JSON file per batch, in order."""
    os.makedirs(f"{base}/in")
    for i, rows in enumerate(batches):
        path = f"{base}/in/{i:03d}.json"
        with open(path, "w") as file:
            file.writelines(json.dumps(dict(zip(("seq", "ms", "value"), r))) + "\n" for r in rows)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{base}/in")


def test_catalog_stream(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    job = CatalogStream("/books", f"{base}/tables")
    for tag in ("BookCreated", "BookDeleted", "FolderCreated", "FolderDeleted"):
        job.register(tag, default_entries)
    batches = [
        [
            (1, 1000, raw("/books/", "SciFi", "CREATE,ISDIR")),
            (2, 1010, raw("/books/SciFi/", "item10.epub", "CLOSE_WRITE")),
            (3, 1020, raw("/books/SciFi/", "item2.epub", "CLOSE_WRITE")),
            (4, 1100, raw("/books/SciFi/", "item2.epub", "CLOSE_WRITE")),
            (5, 1110, raw("/books/SciFi/", "notes.md", "CLOSE_WRITE")),
            (6, 1120, '{"parent": 1}'),
        ],
        [
            (7, 1300, raw("/books/SciFi/", "item2.epub", "CLOSE_WRITE")),
            (8, 2000, raw("/books/", "Old", "CREATE,ISDIR")),
            (9, 2010, raw("/books/Old/", "a.pdf", "MOVED_TO")),
        ],
        [(10, 9000, raw("/books/", "Old", "DELETE,ISDIR")), (11, 9001, raw("/books/SciFi/", "item10.epub", "DELETE"))],
    ]
    query = job.start(stream_of(spark, base, batches), f"{base}/checkpoint")
    query.awaitTermination()
    feeds = BucketedTable(spark, f"{base}/tables/feeds").read()
    got = [tuple(r) for r in feeds.orderBy("folder", "pos").select("folder", "pos", "kind", "title").collect()]
    assert got == [("", 1, "folder", "Sci Fi"), ("SciFi", 1, "book", "Item2")]
    log = spark.read.parquet(f"{base}/tables/event_log")
    assert sorted(r.seq for r in log.collect()) == [1, 2, 3, 8, 9, 10, 11]
    assert spark.read.parquet(f"{base}/tables/rejected").count() == 1
    assert not os.path.exists(f"{base}/tables/dead_letters")
    steps = spark.read.parquet(f"{base}/tables/handler_log")
    assert {r.event_id for r in steps.filter("event_type = 'handler_start'").collect()} == {"1", "2", "3", "8", "9", "10", "11"}
    assert steps.filter("event_type = 'handler_complete' AND duration_ms >= 0 AND cascade_count = 1").count() == 7
    stats = {r.event_tag: (r.started, r.completed, r.failed, r.cascades) for r in handler_statistics(steps).collect()}
    assert stats == {"BookCreated": (3, 3, 0, 3), "BookDeleted": (1, 1, 0, 1), "FolderCreated": (2, 2, 0, 2), "FolderDeleted": (1, 1, 0, 1)}


def test_log_of_handlers(spark):
    rows = [("A", "FolderDeleted", 1, None), ("a.epub", "BookCreated", 2, "bad"), ("b.epub", "BookCreated", 3, None), ("x", "Other", 4, None), (None, None, 5, None)]
    df = spark.createDataFrame(rows, "path string, tag string, seq long, error string")
    log = handler_log(df, {"BookCreated": 7, "FolderDeleted": 9}, compat=True)
    got = [(r.event_id, r.event_type, r.duration_ms, r.cascade_count, r.error) for r in log.orderBy("event_id", "step").collect()]
    assert got == [
        ("1", "handler_start", None, None, None), ("1", "handler_complete", 9, 0, None),
        ("2", "handler_start", None, None, None), ("2", "handler_error", 7, None, "bad"),
        ("3", "handler_start", None, None, None), ("3", "handler_complete", 7, 1, None), ("3", "cascades_generated", None, 1, None),
        ("4", "handler_start", None, None, None), ("5", "handler_start", None, None, None),
    ]
    assert handler_log(df.limit(0).drop("error"), {}).count() == 0


def test_a_message_about_files_or_connections_is_no_reason_to_stop(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    job = CatalogStream("/books", f"{base}/tables")
    bad = F.when(F.col("path") == "a.epub", F.raise_error(F.lit("FileNotFound: Connection"))).otherwise(F.lit("fine"))
    job.register("BookCreated", lambda df: default_entries(df).withColumn("title", bad))
    batch = [(i, i, raw("/books/", f"{n}.epub", "CLOSE_WRITE")) for i, n in enumerate("ab")]
    job.start(stream_of(spark, base, [batch]), f"{base}/checkpoint").awaitTermination()
    assert [r.path for r in BucketedTable(spark, f"{base}/tables/entries").read().collect()] == ["b.epub"]
    errors = spark.read.parquet(f"{base}/tables/handler_log").filter("event_type = 'handler_error'").collect()
    assert [r.path for r in errors] == ["a.epub"] and "FileNotFound" in errors[0].error


def test_overflow_rebuilds_from_listing(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def listing(session):
        rows = session.createDataFrame([("x.epub", "BookCreated", 1)], "path string, tag string, seq long")
        return default_entries(rows).drop("tag", "seq")

    job = CatalogStream("/books", f"{base}/tables", resync=listing)
    job.start(stream_of(spark, base, [[(1, 1, "IN_Q_OVERFLOW")]]), f"{base}/checkpoint").awaitTermination()
    assert [r.path for r in BucketedTable(spark, f"{base}/tables/feeds").read().collect()] == ["x.epub"]


def test_failing_handler_does_not_stop_the_stream(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    job = CatalogStream("/books", f"{base}/tables")
    job.register("BookCreated", lambda df: default_entries(df).withColumn("title", F.raise_error(F.lit("bad book"))))
    batches = [[(1, 1, raw("/books/", "a.epub", "CLOSE_WRITE"))], [(2, 5, "{}")]]
    query = job.start(stream_of(spark, base, batches), f"{base}/checkpoint")
    query.awaitTermination()
    assert query.exception() is None
    dead = spark.read.parquet(f"{base}/tables/dead_letters").collect()
    assert [r.seq for r in dead] == [1] and "bad book" in dead[0].error


def test_bad_event_leaves_the_others_of_its_batch_alone(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    job = CatalogStream("/books", f"{base}/tables", keep_versions=2)
    bad = F.when(F.col("path").contains("bad"), F.raise_error(F.lit("bad book"))).otherwise(F.lit("fine"))
    job.register("BookCreated", lambda df: default_entries(df).withColumn("title", bad))
    names = ["a", "bad1", "b", "c", "bad2", "d", "e"]
    batches = [
        [(i, 10 * i, raw("/books/", f"{n}.epub", "CLOSE_WRITE")) for i, n in enumerate(names)],
        [(20, 5000, raw("/books/", "f.epub", "CLOSE_WRITE"))], [(21, 6000, raw("/books/", "g.epub", "CLOSE_WRITE"))],
    ]
    job.start(stream_of(spark, base, batches), f"{base}/checkpoint").awaitTermination()
    assert sorted(r.path for r in BucketedTable(spark, f"{base}/tables/entries").read().collect()) == [f"{n}.epub" for n in "abcdefg"]
    assert sorted(r.seq for r in spark.read.parquet(f"{base}/tables/dead_letters").collect()) == [1, 4]
    assert len([n for n in os.listdir(f"{base}/tables/state") if n.startswith("v")]) == 2


def test_state_outlives_a_batch_without_events(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    listing = lambda session: default_entries(session.createDataFrame([("x.epub", "BookCreated", 1)], "path string, tag string, seq long")).drop("tag", "seq")
    job = CatalogStream("/books", f"{base}/tables", resync=listing)
    job.register("BookCreated", default_entries)
    one = lambda seq, ms: [(seq, ms, raw("/books/", "a.epub", "CLOSE_WRITE"))]
    batches = [one(1, 1000), [(2, 1050, raw("", "", "IN_Q_OVERFLOW"))], one(3, 1100), one(4, 1600)]
    job.start(stream_of(spark, base, batches), f"{base}/checkpoint").awaitTermination()
    assert sorted(r.seq for r in spark.read.parquet(f"{base}/tables/event_log").collect()) == [1, 4]


def test_a_name_is_no_overflow_marker(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    job = CatalogStream("/books", f"{base}/tables", resync=lambda session: 1 / 0)
    job.register("BookCreated", default_entries)
    rows = [(1, 1, raw("/books/", "IN_Q_OVERFLOW.epub", "CLOSE_WRITE"))]
    job.start(stream_of(spark, base, [rows]), f"{base}/checkpoint").awaitTermination()
    assert [r.path for r in BucketedTable(spark, f"{base}/tables/entries").read().collect()] == ["IN_Q_OVERFLOW.epub"]
    kept = CatalogStream("/books", f"{base}/kept")
    kept.start(stream_of(spark, f"{base}/2", [[(1, 1, "IN_Q_OVERFLOW")]]), f"{base}/checkpoint2").awaitTermination()
    assert [r.seq for r in spark.read.parquet(f"{base}/kept/rejected").collect()] == [1]


def test_live_suppression_lets_one_event_per_key_through(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    # Without this a stateful query on processing time starts empty batches for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = [(i, i, f"k{i % 3}") for i in range(30)]
    events = stream_of(spark, base, [rows]).withColumnRenamed("value", "key")
    out = suppress_live(events)
    query = out.writeStream.format("memory").queryName("live_out").outputMode("append").option(
        "checkpointLocation", f"{base}/checkpoint"
    ).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r.seq, r.key) for r in spark.sql("select * from live_out").collect()) == [(0, "k0"), (1, "k1"), (2, "k2")]


def test_a_batch_rewrites_only_the_buckets_it_touches(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    table = BucketedTable(spark, f"{base}/entries", buckets=32)
    rows = [(f"f{i}", f"f{i}/b{j}", 1) for i in range(40) for j in range(3)] + [("f1/deep", "f1/deep/x", 1), ("", "f1", 1)]
    table.rewrite(spark.createDataFrame(rows, "folder string, path string, source long"))
    files = lambda: {name: sorted(os.listdir(f"{base}/entries/{name}")) for name in os.listdir(f"{base}/entries") if name.startswith("bucket=")}
    before = files()
    changes = [("f2", "f2/new", 2, "BookCreated", 1), ("", "f1", 2, "FolderDeleted", 2), ("f3", "f3/b0", 2, "BookDeleted", 3)]
    schema = "folder string, path string, source long, tag string, seq long"
    rewritten = apply_to_buckets(table, spark.createDataFrame(changes, schema))
    after = files()
    assert len(after) == len(before) == 32 and 0 < len(rewritten) <= 5
    assert {int(n.split("=")[1]) for n in after if after[n] != before[n]} == set(rewritten)
    wanted = {(p, s) for f, p, s in rows if not p.startswith("f1/") and p not in ("f1", "f3/b0")} | {("f2/new", 2)}
    assert {(r.path, r.source) for r in table.read().collect()} == wanted
    # A repeated batch changes nothing, nor does an empty one.
    apply_to_buckets(table, spark.createDataFrame(changes, schema))
    assert apply_to_buckets(table, spark.createDataFrame([], schema)) == []
    assert {(r.path, r.source) for r in table.read().collect()} == wanted
    # A bucket that loses its last row is empty, not as it was.
    gone = [("", f"f{i}", 3, "FolderDeleted", i) for i in range(40)]
    apply_to_buckets(table, spark.createDataFrame(gone, schema))
    assert table.read().collect() == []


def test_resync_follows_the_listing_and_passes_over_busy_times(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    job = CatalogStream("/books", f"{base}/tables", buckets=4)
    for tag in ("BookCreated", "FolderCreated"):
        job.register(tag, default_entries)
    listing = lambda *rows: spark.createDataFrame(list(rows), "path string, size long, mtime_ms double")
    entries = lambda: {(r.path, r.kind, r.entry_mtime_ms) for r in BucketedTable(spark, f"{base}/tables/entries", buckets=4).read().collect()}
    assert job.resynchronize(listing(("a/x.epub", 1, 10.0), ("a/b/y.pdf", 1, 10.0)), 0, now_ms=100)
    assert entries() == {("a", "folder", 100), ("a/b", "folder", 100), ("a/x.epub", "book", 100), ("a/b/y.pdf", "book", 100)}
    after = listing(("a/x.epub", 1, 100.5), ("c/z.epub", 1, 5.0))
    with job.busy:
        assert not job.resynchronize(after, 1, now_ms=200)
    assert job.resynchronize(after, 2, now_ms=200)
    wanted = {("a", "folder", 100), ("a/x.epub", "book", 200), ("c", "folder", 200), ("c/z.epub", "book", 200)}
    assert entries() == wanted
    assert job.resynchronize(after, 3, now_ms=300) and entries() == wanted
    feeds = BucketedTable(spark, f"{base}/tables/feeds", buckets=4).read()
    assert sorted((r.folder, r.name) for r in feeds.collect()) == [("", "a"), ("", "c"), ("a", "x.epub"), ("c", "z.epub")]


def test_resync_interval(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    job = CatalogStream("/books", f"{base}/tables", buckets=4)
    job.register("BookCreated", default_entries)
    rows = lambda session: session.createDataFrame([("x.epub", 1, 1.0)], "path string, size long, mtime_ms double")
    assert job.start_resync(spark, rows, 0, f"{base}/checkpoint") is None
    with pytest.raises(ValueError):
        job.start_resync(spark, rows, 59, f"{base}/checkpoint")
    monkeypatch.setattr(catalog, "LEAST_RESYNC", 1)
    query = job.start_resync(spark, rows, 1, f"{base}/checkpoint")
    entries = BucketedTable(spark, f"{base}/tables/feeds", buckets=4)
    end = time.time() + 90
    while not entries.exists() and query.isActive and time.time() < end:
        time.sleep(0.5)
    query.stop()
    assert [r.path for r in entries.read().collect()] == ["x.epub"]
