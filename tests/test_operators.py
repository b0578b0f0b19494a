"""Folders, plan, feeds, search, sources and formats on small fixtures."""

import gzip
import io
import os
import random
import tarfile
import tempfile
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.formats.common import metadata
from shelfspark.formats.html import html_elements
from shelfspark.formats.registry import extract_metadata
from shelfspark.functions.frames import map_rows
from shelfspark.operators import events as ev
from shelfspark.operators import links
from shelfspark.operators.feeds import feed_fragments, feed_headers, order_entries, parse_entries
from shelfspark.operators.folders import folder_edges, folder_structure, folders_of
from shelfspark.operators.links import choose_groups, reachable
from shelfspark.operators.search import search_segments, search_text
from shelfspark.plans.entries import book_entries, book_entry_xml
from shelfspark.plans.sync import changed_files, fingerprint, orphan_entries, plan, plan_events
from shelfspark.queries import library
from shelfspark.sinks.documents import feed_document_parts, folder_page_parts, join_parts
from shelfspark.sinks.tables import current_version, publish, read_table
from shelfspark.sources.archives import archive_members, read_members
from shelfspark.sources.files import scan_files, scan_mirror
from shelfspark.sources.text import parse_dictionary, parse_log


def files(spark, *names):
    return spark.createDataFrame([(p, 10, 1000.5) for p in names], "path string, size long, mtime_ms double")


def test_folders(spark):
    df = files(spark, "root.epub", "A/B/C/book.epub", "A/D/book.epub", "A/D/two.epub", "Авторы/Книга.epub")
    got = {r.folder: (r.name, r.folder_count, r.book_count) for r in folder_structure(df).collect()}
    assert got == {
        "": ("Catalog", 2, 1), "A": ("A", 2, 0), "A/B": ("B", 1, 0), "A/B/C": ("C", 0, 1), "A/D": ("D", 0, 2), "Авторы": ("Авторы", 0, 1),
    }
    assert {tuple(r) for r in folder_edges(folders_of(df)).collect()} >= {("", "A"), ("A", "A/B"), ("A/B", "A/B/C")}


def test_empty_listing_has_the_root(spark):
    assert [tuple(r) for r in folder_structure(files(spark).limit(0)).collect()] == [("", "Catalog", 0, 0)]


def test_plan(spark):
    listing = files(spark, "new.epub", "older.epub", "equal.epub", "A/newer.epub")
    state = spark.createDataFrame(
        [("older.epub", "book", 1000.0), ("equal.epub", "book", 1000.5), ("A/newer.epub", "book", 2000.0), ("gone.epub", "book", 1.0),
         ("Old", "folder", 1.0), ("A", "folder", 1.0)], "path string, kind string, entry_mtime_ms double")
    assert {r.path for r in changed_files(listing, state).collect()} == {"new.epub", "older.epub"}
    assert {r.path for r in orphan_entries(listing, state).collect()} == {"gone.epub", "Old"}
    events = {(r.tag, r.parent, r.name) for r in plan_events(plan(listing, state), "/books/").collect()}
    assert events == {
        ("BookDeleted", "/books/", "gone.epub"), ("BookDeleted", "/books/", "Old"), ("FolderCreated", "/books/", ""),
        ("FolderCreated", "/books/", "A"), ("BookCreated", "/books/", "new.epub"), ("BookCreated", "/books/", "older.epub"),
    }


def test_fingerprint_ignores_order_and_part_of_a_millisecond(spark):
    a = spark.createDataFrame([("a", 1, 1700000000000.5), ("b", 2, 5.0)], "path string, size long, mtime_ms double")
    b = spark.createDataFrame([("b", 2, 5.2), ("a", 1, 1700000000000.9)], "path string, size long, mtime_ms double")
    c = spark.createDataFrame([("b", 2, 6.2), ("a", 1, 1700000000000.9)], "path string, size long, mtime_ms double")
    assert fingerprint(a).first() == fingerprint(b).first() != fingerprint(c).first()


def test_feed_order(spark):
    rows = [
        ("", "d2", "folder", "Zoo", None), ("", "d1", "folder", "item10", None), ("", "d3", "folder", "Item2", None), ("", "_x", "folder", "A", None),
        ("", "b1", "book", "Beta", "Яков"), ("", "b2", "book", "Alpha", "Anna"), ("", "b3", "book", "Zeta", None), ("", "b4", "book", "Eta", ""),
        ("", "b5", "book", "alpha", "anna"),
    ]
    df = spark.createDataFrame(rows, "folder string, name string, kind string, title string, author string")
    got = [(r.name, r.pos, r.book_no) for r in order_entries(df).orderBy("pos").collect()]
    names = ["d3", "d1", "d2", "b4", "b3", "b2", "b5", "b1"]
    assert got == [(n, i + 1, i - 2 if i > 2 else None) for i, n in enumerate(names)]


FEED = """<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opds="http://opds-spec.org/2010/catalog" xmlns:dc="http://purl.org/dc/terms/">
  <id>urn:x</id>
  <title>A &amp; "B"</title>
  <updated>2026-01-01T00:00:00.000Z</updated>
  <link rel="self" href="/x/feed.xml" type="application/atom+xml;profile=opds-catalog;kind=acquisition"/>
  <link rel="start" href="/feed.xml" type="application/atom+xml;profile=opds-catalog;kind=navigation"/>
<entry>
  <title>Sub</title>
  <link rel="subsection" href="javascript:alert(1)" type="t"/>
</entry>
<entry><broken></entry>
<entry>
  <id>urn:b</id>
  <title>$&amp; &lt;b&gt;</title>
  <author><name>Ann</name></author>
  <dc:subject>x</dc:subject>
  <dc:subject>y</dc:subject>
  <link rel="http://opds-spec.org/acquisition/open-access" href="/x/b.epub" type="application/epub+zip"/>
  <link rel="http://opds-spec.org/acquisition" type="application/pdf"/>
</entry>
</feed>"""


def test_feed_parse_and_render(spark):
    df = spark.createDataFrame([("x", FEED)], "folder string, xml string")
    head, entries = feed_headers(df, "folder"), parse_entries(feed_fragments(df, "folder"))
    assert head.first()[1:] == ("urn:x", 'A & "B"', "2026-01-01T00:00:00.000Z", "acquisition", "/x/feed.xml", "/feed.xml")
    rows = entries.orderBy("pos").collect()
    assert [(r.kind, r.id, r.title) for r in rows] == [("folder", "", "Sub"), ("book", "", ""), ("book", "urn:b", "$& <b>")]
    assert rows[1].xml == "<entry><broken></entry>"
    assert rows[2].subjects == ["x", "y"] and rows[2].acquisitions == [("/x/b.epub", "application/epub+zip")]
    assert join_parts(feed_document_parts(head, entries)).first().document == FEED
    page = join_parts(folder_page_parts(head, entries.withColumn("book_no", F.col("pos") - 1))).first().document
    assert '<a href="#">Sub</a>' in page and "javascript" not in page and "$&amp; &lt;b&gt;" in page
    assert '<a href="/static/read.html#/x/b.epub" class="popup__view-btn">View</a>' in page


def test_search_overlaps_and_excerpts(spark):
    df = spark.createDataFrame([(1, "aXaxA"), (2, "none")], "id int, text string")
    assert [(r.start, r.match) for r in search_text(df, "text", "axa").orderBy("start").collect()] == [(0, "aXa"), (2, "axA")]
    assert search_text(df, "text", "axA", match_case=True).count() == 1
    long = "w " * 60 + "\n\n HIT \n" + " v" * 60
    row = search_text(spark.createDataFrame([(1, long)], "id int, text string"), "text", "hit").first()
    assert row.pre == "…" + ("w " * 60)[-50:] and row.post == (" v" * 60)[:50] + "…"
    blank = spark.createDataFrame([(1, "ab" + " " * 900 + "HIT" + " " * 900 + "cd")], "id int, text string")
    row = search_text(blank, "text", "hit").first()
    assert (row.pre, row.match, row.post) == ("ab ", "HIT", " cd")


def test_search_across_nodes(spark):
    df = spark.createDataFrame([(1, ["on", "e t", "wo three"])], "id int, s array<string>")
    row = search_segments(df, "s", "one two").first()
    assert (row.start_node, row.start_offset, row.end_node, row.end_offset) == (0, 0, 2, 2)
    assert (row.pre, row.match, row.post) == ("", "one two", " three")


def test_classification(spark):
    rows = [
        ("book.epub", "CLOSE_WRITE", "BookCreated"), ("book.fb2", "MOVED_TO", "BookCreated"), ("book.pdf", "DELETE", "BookDeleted"),
        ("book.mobi", "MOVED_FROM", "BookDeleted"), ("README.md", "CLOSE_WRITE", None), ("book.epub", "CREATE", None), ("F", "CREATE,ISDIR", "FolderCreated"),
        ("F", "ISDIR,CREATE", "FolderCreated"), ("S", "MOVED_TO,ISDIR", "FolderCreated"), ("O", "DELETE,ISDIR", "FolderDeleted"),
        ("M", "MOVED_FROM,ISDIR", "FolderDeleted"), (".book.epub", "CLOSE_WRITE", None), ("epub", "CLOSE_WRITE", "BookCreated"), ("x.epub", "OPEN", None),
    ]
    df = spark.createDataFrame([(i, "/b/", n, e) for i, (n, e, _) in enumerate(rows)], "i int, parent string, name string, events string")
    got = {r.i: r.tag for r in ev.classify(df).collect()}
    assert got == {i: tag for i, (_, _, tag) in enumerate(rows) if tag}


def test_cascade_and_its_quirk(spark):
    df = spark.createDataFrame([("Old", "FolderDeleted"), ("A/B/x.epub", "BookCreated")], "path string, tag string")
    assert {r.folder for r in ev.cascade(df).collect()} == {"", "A", "A/B"}
    only = df.filter("tag = 'FolderDeleted'")
    assert {r.folder for r in ev.cascade(only).collect()} == {""} and ev.cascade(only, compat=True).count() == 0


def test_group_choice_equals_reading_in_order(spark):
    entries = [(1, ["b", "a"]), (2, ["a"]), (3, ["c", "a"]), (4, ["d", "c", "b"]), (5, []), (6, ["d", "e"]), (7, ["e", "d"]), (8, ["f", "b"])]
    seen, want = {None}, []
    for pos, links in entries:
        pick = next((l for l in links if l in seen), links[0] if links else None)
        seen.add(pick)
        want.append((pos, pick))
    df = spark.createDataFrame([("f", p, l) for p, l in entries], "feed string, pos int, links array<string>")
    assert sorted((r.pos, r.group) for r in choose_groups(df).collect()) == want


def _choices_in_order(entries):
    """Each entry after those before it; entries at one position do not see each other."""
    opened, want = {}, []
    for feed, pos, links in sorted((e for e in entries if e[0] is not None and e[1] is not None), key=lambda e: e[:2]):
        at = opened.setdefault(feed, {})
        pick = next((l for l in links if at.get(l, pos) < pos), links[0] if links else None)
        if pick is not None:
            at.setdefault(pick, pos)
        want.append((feed, pos, pick))
    return want + [(f, p, l[0] if l else None) for f, p, l in entries if f is None or p is None]


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_group_choice_of_long_feeds_ends_soon(spark, block, monkeypatch):
    rng = random.Random(block)
    entries = [(f"f{rng.randrange(3)}", i, rng.sample("abcdefghijklmno", rng.randrange(5))) for i in range(12 if block == 1 else 300)]
    entries += [(None, 1, ["a", "b"]), ("f0", None, ["c", "b"]), ("f1", 5, ["z", "y"]), ("f1", 5, ["y", "z"]), ("f1", 6, ["z", "y"])]
    # Each entry turns on the choice of the one before it.
    entries += [("chain", i, [f"g{i}", f"g{i - 1}"]) for i in range(1, 9 if block == 1 else 40)]
    df = spark.createDataFrame(entries, "feed string, pos int, links array<string>")
    rounds, write = [], links.written
    monkeypatch.setattr(links, "written", lambda df, name: rounds.append(name) or write(df, name))
    got = links.choose_groups(df, block).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(_choices_in_order(entries), key=repr)
    assert rounds.count("step") <= {1: 12, 7: 20, 4096: 1}[block]
    assert links.choose_groups(df.limit(0), block).collect() == []


def test_group_choice_of_many_small_feeds_reads_them_together(spark, monkeypatch):
    entries = [(f"f{i}", pos, found) for i in range(2000) for pos, found in ((1, ["a"]), (2, ["b", "a"]), (3, ["c", "b"]))]
    df = spark.createDataFrame(entries, "feed string, pos int, links array<string>")
    plans, write = [], links.written
    explained = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(links, "written", lambda df, name: plans.append((name, explained(df))) or write(df, name))
    got = links.choose_groups(df).collect()
    assert sorted(map(tuple, got)) == sorted(_choices_in_order(entries))
    # No call of Python for each feed.
    assert not [plan for name, plan in plans if name == "step" and "Groups" in plan]


def test_reachable_with_loop(spark):
    edges = spark.createDataFrame([("", "a"), ("a", "b"), ("b", "a"), ("b", ""), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("",)], "node string")
    assert {r.node for r in reachable(edges, start).collect()} == {"", "a", "b"}


def test_scan_and_extract(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for d in ("A/_deep", ".hidden", "empty"):
        os.makedirs(f"{root}/{d}")
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("b.FB2", "<FictionBook><description><title-info><book-title>Zipped</book-title></title-info></description></FictionBook>")
    for name, data in {
        "A/_deep/my_notes.txt": b"x", "A/empty.epub": b"", "A/.x.epub": b"x", ".hidden/a.epub": b"x", "B.FB2.zip": archive.getvalue(), "note.md": b"x",
        "broken.mobi": b"xx", "epub": b"x",
    }.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(data)
    listed = scan_files(spark, root)
    assert {(r.path, r.extension, r.size) for r in listed.collect()} == {
        ("A/_deep/my_notes.txt", "txt", 1), ("A/empty.epub", "epub", 0), ("B.FB2.zip", "zip", len(archive.getvalue())), ("broken.mobi", "mobi", 2),
    }
    entries = book_entries(extract_metadata(listed).withColumn("has_cover", F.col("cover").isNotNull()))
    assert {r.path: r.title for r in entries.collect()} == {
        "A/_deep/my_notes.txt": "My notes", "A/empty.epub": "Empty", "B.FB2.zip": "Zipped", "broken.mobi": "Broken",
    }
    assert "<title>Zipped</title>" in entries.filter("path = 'B.FB2.zip'").select(book_entry_xml(F.lit("u"))).first()[0]


def test_archives_by_content(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as a:
        a.writestr("d/", "")
        a.writestr("d/x.png", "1")
        a.writestr("empty", "")
    with tarfile.open(fileobj=t, mode="w") as a:
        info = tarfile.TarInfo("y.png")
        info.size = 1
        a.addfile(info, io.BytesIO(b"2"))
    rows = [("z.cbt", z.getvalue()), ("t.zip", t.getvalue()), ("bad.zip", b"PK\x03\x04broken"), ("g.zip", gzip.compress(b"x")), ("e.zip", b"")]
    df = spark.createDataFrame(rows, "path string, content binary")
    assert {(r.path, r.member) for r in archive_members(df).collect()} == {("z.cbt", "d/x.png"), ("z.cbt", "empty"), ("t.zip", "y.png")}
    wanted = df.withColumn("wanted", F.array(F.lit("d/x.png"), F.lit("empty"), F.lit("y.png")))
    got = {(r.path, r.member): r.data for r in read_members(wanted).filter("data is not null").collect()}
    assert got == {("z.cbt", "d/x.png"): b"1", ("t.zip", "y.png"): b"2"}


def test_mirror_listing(spark):
    rows = [("A", "folder", 1.0), ("A/b.epub", "book", 2.0), ("A/b.epub/c", "book", 3.0), ("_x", "folder", 1.0), ("A/.h/y", "book", 1.0), ("", "folder", 0.0)]
    df = spark.createDataFrame(rows, "path string, kind string, entry_mtime_ms double")
    assert {(r.path, r.kind) for r in scan_mirror(df).collect()} == {("A", "folder"), ("A/b.epub", "book")}


def test_log_and_dictionary(spark):
    lines = ['\x1b[32m{"ts":"1","event_tag":"x","duration_ms":5}\x1b[0m', "plain", '{"ts":"2","even', '{"ts":"3"}']
    log = parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.ts, r.event_tag, r.duration_ms) for r in log.orderBy("ts").collect()] == [("1", "x", 5), ("3", None, None)]
    words = parse_dictionary(spark.createDataFrame([("word\tBA\t/",), ("",)], "value string"))
    assert [tuple(r) for r in words.collect()] == [("word", 64, 63)]


def test_book_tasks_unpack_pieces_of_a_batch(spark, monkeypatch):
    """Of a batch of 10,000 rows only a piece is in memory as books when the first ones leave the task."""
    tasks, seen = [], []
    frame = type(spark.range(1))
    for name in ("mapInPandas", "mapInArrow"):
        monkeypatch.setattr(frame, name, lambda df, task, schema, _name=name: tasks.append((_name, task)) or df)
    make = lambda n, text, lang, source: seen.append(n) or text.encode()
    library.books(spark, "/root/testdata/sf0.001", "txt", make)
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": "x" * 2000, "lang": "en", "source": "s"} for i in range(10000)])
    (name, task), = tasks
    out = task(iter([batch if name == "mapInArrow" else batch.to_pandas()]))
    first = next(out)
    assert len(seen) <= 256 and len(first) + sum(len(b) for b in out) == 10000


def test_files_are_made_once_for_all_formats(spark):
    made = spark.sparkContext.accumulator(0)

    def make(rows):
        for row in rows:
            made.add(1)
            yield row.path, b"no book"

    names = [(f"a/b{i}.{kind}",) for i in range(10) for kind in ("epub", "cbz", "fb2", "mobi", "txt")]
    books = map_rows(spark.createDataFrame(names, "path string"), make, "path string, content binary")
    rows = extract_metadata(books).collect()
    assert len(rows) == 50 and made.value == 50


def test_table_versions(spark):
    table = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/t"
    assert read_table(spark, table) is None
    for version, n in (("v0", 3), ("v1", 5), ("v1", 4)):
        publish(spark.range(n), table, version)
    assert current_version(spark, table) == "v1" and read_table(spark, table).count() == 4


def test_html_elements(spark):
    df = spark.createDataFrame([(1, '<div class="a">x<br>y <b title="&amp;">z</b></div><p>q')], "id int, html string")
    rows = html_elements(df, "id", "html").orderBy("pos").collect()
    assert [(r.depth, r.tag, r.text) for r in rows] == [(0, "div", "xy z"), (1, "br", ""), (1, "b", "z"), (0, "p", "q")]
    assert rows[2].attributes == {"title": "&"}


def test_metadata_defaults(spark):
    assert spark.range(1).select(metadata().alias("m")).first().m.title == ""
