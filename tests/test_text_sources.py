"""Feeds and mirror events read from folders."""

import json
import os
import tempfile

from shelfspark.sources.text import read_feeds, read_mirror_events


def test_feeds_below_a_folder(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{root}/a/б в")
    for path, text in {"feed.xml": "<feed>\n1</feed>", "a/б в/feed.xml": "<feed>2</feed>", "a/index.html": "<p>", "a/empty.xml": ""}.items():
        with open(f"{root}/{path}", "w") as file:
            file.write(text)
    got = sorted(r.xml for r in read_feeds(spark, root).collect())
    assert got == ["<feed>\n1</feed>", "<feed>2</feed>"]


def test_mirror_events_leave_own_files_and_hidden_ones_out(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.makedirs(f"{base}/in")
    names = [("/data/a/", "entry.xml"), ("/data/", "events.jsonl"), ("/data/a/", "index.html"), ("/data/.x/", "entry.xml"), ("/data/", ".tmp"), ("/data/", "_entry.xml")]
    with open(f"{base}/in/0.jsonl", "w") as file:
        file.writelines(json.dumps({"parent": p, "name": n, "events": "CLOSE_WRITE"}) + "\n" for p, n in names)
        file.write("no json\n")
    query = (
        read_mirror_events(spark, f"{base}/in").writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    values = [r.value for r in spark.read.parquet(f"{base}/out").collect()]
    # Lines that are no events stay: validation sets them aside.
    assert sorted(json.loads(v)["name"] if v.startswith("{") else v for v in values) == ["_entry.xml", "entry.xml", "no json"]
