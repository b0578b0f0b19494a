"""Scalar functions against input and output tables."""

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import links, locations, markup, natural, paths
from shelfspark.functions import text as t


def run(spark, function, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    rows = df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


CASES = [
    (t.encode_url_path, {
        "path/with spaces/file": "path/with%20spaces/file", "path/file[1].epub": "path/file%5B1%5D.epub",
        "path/file#hash.pdf": "path/file%23hash.pdf", "a/b/c/d": "a/b/c/d", "Author (2024)/Book.epub": "Author%20(2024)/Book.epub",
        "книга": "%D0%BA%D0%BD%D0%B8%D0%B3%D0%B0", "a~b!c'*": "a~b!c'*", "a+b": "a%2Bb",
    }),
    (lambda c: t.format_file_size(c.cast("long")), {
        "0": "0 B", "1023": "1023 B", "1024": "1.0 KB", "1536": "1.5 KB", "1280": "1.3 KB", "1048575": "1024.0 KB",
        "1572864": "1.5 MB", "104857600": "100.0 MB",
    }),
    (t.normalize_title, {
        "Hello_World": "Hello World", "multiple__underscores": "Multiple underscores", "my-awesome-book": "My awesome book",
        "sci-fi_books_2024": "Sci-fi books 2024", "test-very-long_title": "Test very long_title", "e-book_collection": "E-book collection",
        "camelCase": "Camel Case", "TheLordOfTheRings": "The Lord Of The Rings", "XMLParser": "XML Parser", "  Hello   World ": "Hello World",
        "_Hello_": "Hello", "---my-book---": "My book", "Book #1": "Book #1", "Книга_автора": "Книга автора", "test": "Test",
    }),
    (t.strip_xml_declaration, {
        '<?xml version="1.0"?>\n<a/>': "<a/>", "<a/>": "<a/>", '  <?xml version="1.0" encoding="utf-8"?>  <a/> ': "<a/>",
    }),
    (t.decode_entities, {
        "&lt;tag&gt;": "<tag>", "&apos;x&apos;": "'x'", "&#65;": "A", "&#1040;": "А", "&#x41;": "A", "&#XA9;": "©",
        "&lt;a&gt;&amp;&lt;b&gt;": "<a>&<b>", "Price: &lt;$100 &amp; &#x3E;$50": "Price: <$100 & >$50", "&unknown; & x": "&unknown; & x",
        "&amp;#65;": "A", "&amp;amp;": "&amp;", "&#65601;": "A", "&#55357;&#56832;": "😀", "&dagger;&Dagger;&nbsp;": "†‡ ",
    }),
    (t.clean_description, {
        "Line<br/>break": "Linebreak", "  a \n\t b  c ": "a b c", "<p></p>": None, "": None, "<p>x</p>": "x",
    }),
    (t.parse_date, {"2021-09-12T00:00": "2021-09", "2021": "2021", "2021/09": "2021", "x 2021": None, "": None}),
    (t.year_of_text, {"Mon May 5 10:00:00 2025 UTC": "2025", "12025 1899": None, "in 1999 or 2001": "1999"}),
    (lambda c: F.array_join(t.split_keywords(c), "|"), {"a, b;c ;; ": "a|b|c", " , ;": None}),
    (t.strip_source_extension, {"a.indd": "a", "a.DOCX": "a", "a.doc": "a", "a.epub": "a.epub", "a.tex.pub": "a.tex"}),
    (t.parse_clock, {"1:02:03": 3723.0, "2:03.5": 123.5, "1.5h": 5400.0, "2min": 120.0, "30ms": 0.03, "7s": 7.0, "9": 9.0}),
    (t.camel_case, {"page-spread-left": "pageSpreadLeft", "Media:Duration": "mediaDuration", "a-": "a-"}),
    (t.collapse_ascii_space, {"  a \n b  ": "a b "}),
    (markup.extract_title, {
        "<title>A &amp; B</title>": "A & B", '<title type="text"> x\n</title><title>y</title>': "x", "<x/>": "", "<title></title>": "",
    }),
    (markup.extract_author, {
        "<author>\n <name>Ann &lt;x&gt;</name>\n</author>": "Ann <x>", "<author></author>": None, "<author><name></name></author>": None,
    }),
    (links.safe_link, {
        "/a": "/a", "#x": "#x", "http://a": "http://a", "HTTPS://a": "HTTPS://a", "javascript:alert(1)": "#", "java\tscript:x": "#",
        " \x01javascript:x": "#", "data:text/html,x": "#", "rel/a:b": "rel/a:b", "a:b": "#", "x.html": "x.html",
    }),
    (links.format_from_mime, {
        "application/epub+zip": "EPUB", "application/pdf": "PDF", "application/x-fictionbook+xml": "FB2", "application/x-mobi8-ebook": "MOBI",
        "application/vnd.amazon.azw": "AZW3", "image/vnd.djvu": "DJVU", "application/vnd.comicbook+zip": "Comic", "text/plain": "TXT",
        "application/octet-stream": "Download", "APPLICATION/X-TAR": "Comic",
    }),
    (links.browser_href, {"/a/feed.xml": "/a/", "feed.xml": "/", "/a": "/a"}),
    (paths.parent_path, {"a/b/c": "a/b", "a": "", "": "", "a/b/": "a"}),
    (paths.file_extension, {"a.EPUB": "epub", ".epub": "", "epub": "", "a.b.pdf": "pdf", "d.x/a": ""}),
    (paths.loose_extension, {"a.EPUB": "epub", ".epub": "epub", "epub": "epub"}),
    (paths.format_extension, {"a/b.fb2.zip": "fb2.zip", "a.FB2.ZIP": "fb2.zip", "a.zip": "zip"}),
    (lambda c: F.array_join(paths.ancestor_paths(c), "|"), {"": "", "a": "|a", "a/b/c": "|a|a/b|a/b/c"}),
    (paths.url_to_path, {"https://h.x/en/1/?a=b#c": "h.x/en/1", "http://h": "h"}),
    (lambda c: links.relative_path(F.lit("a/b/"), c), {"a/b/c": "c", "a/c": "../c", "x": "../../x", "a/b": ""}),
    (lambda c: links.resolve_url(c, F.lit("OPS/nav/toc.xhtml")), {
        "../text/a%20b.html?x=1#f": "OPS/text/a b.html#f", "c.html": "OPS/nav/c.html", "../../../z": "z", "/r": "r",
        "../x/../": "OPS/", "#top": "OPS/nav/toc.xhtml#top", "a%2Fb%zz": "a%2Fb%zz", "a%2Fb%20c": "OPS/nav/a%2Fb c", "http://o.x/é": "http://o.x/%C3%A9",
    }),
    (lambda c: links.resolve_url(c, F.lit("http://h.x/a/b")), {
        "../c?x=1": "http://h.x/c?x=1", "": "http://h.x/a/b", "//o.y/d/./e": "http://o.y/d/e", "é f": "http://h.x/a/%C3%A9%20f", "?q": "http://h.x/a/b?q",
        "/r/../s/..": "http://h.x/",
    }),
    (links.is_external, {"http://a": True, "blob:x": False, "a/b": False, "mailto:x": True}),
]


@pytest.mark.parametrize("function,table", CASES, ids=[str(i) for i in range(len(CASES))])
def test_tables(spark, function, table):
    assert dict(zip(table, run(spark, function, table))) == table


LINKS = {
    "#/Fiction/Book.epub/Book.epub": ("ok", "/Fiction/Book.epub/Book.epub", "/Fiction/", "Book.epub", "epub"),
    "/Fiction/My%20Book.PDF": ("ok", "/Fiction/My%20Book.PDF", "/Fiction/", "My Book.PDF", "pdf"),
    "/Book.epub/Book.epub": ("ok", "/Book.epub/Book.epub", "/", "Book.epub", "epub"),
    "/a/Book.epub/file": ("ok", "/a/Book.epub/file", "/a/", "Book.epub", "epub"),
    "/a/x.fb2": ("unsupported", None, "/a/", None, "fb2"),
    "/a+b/c.epub": ("ok", "/a%2Bb/c.epub", "/a%2Bb/", "c.epub", "epub"),
    **{bad: ("invalid", None, None, None, None) for bad in [
        "", "a/b.epub", "//evil/a.epub", "/a\\b/c.epub", "/a/%5Cb.epub", "/a/%zz.epub", "/a/%ff.epub", "/one.epub", "/a//b.epub", "/a/../b.epub",
        "/a/%2e%2e/b.epub", "/a/%252e%252e/b.epub", "/a/.%2e/b.epub", "/a/noext", "/a/.epub", "/a/b.", "/x/file",
    ]},
}


def test_book_links(spark):
    got = run(spark, links.book_link, LINKS)
    assert {k: tuple(v) for k, v in zip(LINKS, got)} == LINKS


@pytest.mark.parametrize("names", [
    ["item1", "item2", "item10", "item20"], ["Apple", "banana", "CHERRY"], ["Апельсин", "Банан", "Яблоко"],
    ["book1.epub", "book2.epub", "book10.epub"], ["a 9", "a 10", "a b"], ["x007", "x8", "x0100"],
])
def test_natural_order(spark, names):
    df = spark.createDataFrame([(n,) for n in reversed(names)], "n string")
    assert [r.n for r in df.orderBy(natural.natural_key("n")).collect()] == names


def test_natural_order_ignores_case_and_accents(spark):
    same = spark.range(1).select(natural.natural_key(F.lit("Éa01")) == natural.natural_key(F.lit("eA1")))
    assert same.first()[0]


def test_folder_summary(spark):
    df = spark.createDataFrame([(0, 0), (0, 502), (5, 0), (5, 502)], "f int, b int")
    assert [r[0] for r in df.select(t.folder_summary("f", "b")).collect()] == [None, "📚 502", "🗂 5", "🗂 5 · 📚 502"]


def test_location_order(spark):
    order = [
        "epubcfi(/6/2!/4)", "epubcfi(/6/4[ch^]1;s=b]!/4)", "epubcfi(/6/4!/4/2)", "epubcfi(/6/4!/4/2:3)", "epubcfi(/6/4!/4/2,/1:4,/1:5)",
        "epubcfi(/6/4!/4/2,/1:4,/3:0)", "epubcfi(/6/4!/4/10~1.5@1:2)", "epubcfi(/6/10)",
    ]
    df = spark.createDataFrame([(c,) for c in reversed(order)], "c string")
    assert [r.c for r in df.orderBy(locations.cfi_sort_key("c")).collect()] == order


def test_html_units(spark):
    html = "<html><head><title>x</title><style>p{}</style></head><body>lead<div>one <b>two</b><script>'</p>'</script></div><p> </p><p class='a'>three<br/>four</p></body></html>"
    df = spark.createDataFrame([(html,)], "h string")
    row = df.select(markup.text_segments("h").alias("s"), markup.block_texts("h").alias("b")).first()
    assert row.s == ["lead", "one ", "two", " ", "three", "four"]
    assert row.b == ["one two", "threefour"]
