"""Feeds: parsing entry fragments and feed documents, ordering entries, numbering, profiles, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import FEED_FILE, REL_IMAGE, REL_SUBSECTION, REL_THUMBNAIL
from shelfspark.functions.natural import natural_key
from shelfspark.functions.text import empty_to_null, get_string, string_array
from shelfspark.operators.ordered import number_rows, ordered, running_sum

XML_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
LINK = "array<struct<_rel:string,_href:string,_type:string>>"
ENTRY_XML = (
    "id string, title string, summary string, content string, author array<struct<name:string>>, "
    f"subject array<string>, format string, issued string, language string, isPartOf string, link {LINK}"
)
FEED_XML = f"id string, title string, updated string, link {LINK}"
ENTRY_PATTERN = r"(?s)<entry(?:\s[^>]*)?>.*?</entry>"


def _href(links: Column, rel: str) -> Column:
    return F.try_element_at(F.filter(links, lambda l: l["_rel"] == rel), F.lit(1))["_href"]


def parse_entries(fragments: DataFrame, xml: str = "xml") -> DataFrame:
    """Entry fragments to rows; all other columns are kept.

    Total: a fragment that is not XML gives an empty book row that keeps its text.
    """
    rows = fragments.withColumn("__e", F.from_xml(xml, ENTRY_XML, XML_OPTIONS))
    e = lambda name: F.col(f"__e.{name}")
    links = e("link")
    acquisitions = F.filter(
        F.transform(
            F.filter(links, lambda l: l["_rel"].contains("acquisition")),
            lambda l: F.struct(l["_href"].alias("href"), F.coalesce(l["_type"], F.lit("")).alias("type")),
        ),
        lambda a: a["href"] != "",
    )
    folder_href = empty_to_null(_href(links, REL_SUBSECTION))
    fields = {
        "kind": F.when(folder_href.isNotNull(), "folder").otherwise("book"),
        "id": F.coalesce(get_string(e("id")), F.lit("")),
        "title": F.coalesce(get_string(e("title")), F.lit("")),
        "author": F.when(F.size(e("author")) == 1, get_string(F.element_at(e("author"), 1)["name"])),
        "summary": get_string(e("summary")),
        "href": folder_href,
        "cover": _href(links, REL_IMAGE),
        "thumbnail": _href(links, REL_THUMBNAIL),
        "subjects": string_array(e("subject")),
        "format": get_string(e("format")),
        "content": get_string(e("content")),
        "issued": get_string(e("issued")),
        "language": get_string(e("language")),
        "is_part_of": get_string(e("isPartOf")),
        "acquisitions": F.when(F.size(acquisitions) > 0, acquisitions),
    }
    return rows.select(*fragments.columns, *[c.alias(n) for n, c in fields.items()])


def feed_headers(documents: DataFrame, key: str = "path", xml: str = "xml") -> DataFrame:
    """Feed documents to header rows: id, title, updated, kind, self and start address."""
    shell = F.from_xml(F.regexp_replace(xml, ENTRY_PATTERN, ""), FEED_XML, XML_OPTIONS)
    rows = documents.select(key, shell.alias("f"))
    links = F.col("f.link")
    own = F.try_element_at(F.filter(links, lambda l: l["_rel"] == "self"), F.lit(1))
    return rows.select(
        key,
        F.coalesce(get_string("f.id"), F.lit("")).alias("id"),
        F.coalesce(get_string("f.title"), F.lit("")).alias("title"),
        F.coalesce(get_string("f.updated"), F.lit("")).alias("updated"),
        F.when(own["_type"].contains("kind=acquisition"), "acquisition").otherwise("navigation").alias("kind"),
        F.coalesce(own["_href"], F.lit(f"/{FEED_FILE}")).alias("self_href"),
        F.coalesce(_href(links, "start"), F.lit(f"/{FEED_FILE}")).alias("start_href"),
    )


def feed_fragments(documents: DataFrame, key: str = "path", xml: str = "xml") -> DataFrame:
    """Feed documents to rows (key, pos, xml): the entry fragments, unchanged, in document order."""
    found = F.regexp_extract_all(xml, F.lit(f"({ENTRY_PATTERN})"), F.lit(1))
    return documents.select(key, F.posexplode(found).alias("pos", "xml")).withColumn("pos", F.col("pos") + 1)


def entry_order() -> list[Column]:
    """Folders by title, then books by author (none first) and title; directory names last."""
    is_book = F.col("kind") == "book"
    author = F.when(is_book, empty_to_null("author"))
    return [is_book, author.isNotNull(), natural_key(author), natural_key("title"), natural_key("name"), F.col("name")]


def order_entries(entries: DataFrame) -> DataFrame:
    """Position of each entry in the feed of its folder, and the number of each book among the books.

    Input columns: folder, name, kind, title, author. Names starting with ``_`` are not listed.
    """
    listed = entries.filter(~F.col("name").startswith("_"))
    keys = {f"__k{i}": c for i, c in enumerate(entry_order())}
    rows = ordered(listed.withColumns(keys), ["folder"], [F.col(k) for k in keys])
    rows = number_rows(rows, "pos")
    rows = running_sum(rows, (F.col("kind") == "book").cast("long"), "book_no")
    is_book = F.col("kind") == "book"
    return rows.plain().drop(*keys).withColumn("book_no", F.when(is_book, F.col("book_no")))


def feed_kinds(entries: DataFrame) -> DataFrame:
    """Kind of each feed: acquisition as soon as it lists a book."""
    return entries.groupBy("folder").agg(
        F.when(F.bool_or(F.col("kind") == "book"), "acquisition").otherwise("navigation").alias("feed_kind")
    )


def profile_feeds(documents: DataFrame, path: str = "path", xml: str = "xml") -> DataFrame:
    """Per feed: entries, depth, Cyrillic letters, a book without cover, longest title.

    A document may come in several rows (parts cut between entries); they are combined per path.
    """
    titles = F.regexp_extract_all(xml, F.lit("(?s)<title>(.*?)</title>"), F.lit(1))
    books = F.regexp_extract_all(xml, F.lit("(?s)(<entry>.*?</entry>)"), F.lit(1))
    bare = lambda b: b.contains("acquisition") & ~b.contains("opds-spec.org/image")
    parts = documents.select(
        path,
        F.regexp_count(xml, F.lit("<entry>")).alias("entries"),
        F.col(xml).rlike("[А-Яа-я]").alias("cyrillic"),
        F.exists(books, bare).alias("bare"),
        F.coalesce(F.array_max(F.transform(titles, F.length)), F.lit(0)).alias("title_length"),
    )
    return parts.groupBy(path).agg(
        F.sum("entries").cast("int").alias("entries"),
        F.size(F.split(path, "/")).alias("depth"),
        F.bool_or("cyrillic").alias("cyrillic"),
        F.bool_or("bare").alias("book_without_cover"),
        F.max("title_length").alias("max_title_length"),
    )


def pick_feeds(profiles: DataFrame, path: str = "path") -> DataFrame:
    """Named picks from feed profiles: the highest rank wins, ties go to the first path."""
    p = profiles
    picks = {
        "root": (F.col(path) == FEED_FILE, F.lit(0)),
        "largest_cyrillic": (F.col("cyrillic") & (F.col("entries") > 1), F.col("entries")),
        "longest_cyrillic_book": (F.col("cyrillic") & (F.col("entries") == 1), F.col("max_title_length")),
        "largest": (F.lit(True), F.col("entries")),
        "deepest": (F.col("depth") > 2, F.col("depth")),
    }
    # One pass: each pick is a conditional minimum of (-rank, path).
    best = p.agg(
        *[
            F.min(F.when(cond, F.struct((-rank).alias("rank"), F.col(path).alias("path")))).alias(name)
            for name, (cond, rank) in picks.items()
        ]
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(n).alias("pick"), F.col(f"{n}.path").alias("path"),
                           (-F.col(f"{n}.rank")).alias("rank")) for n in picks])
    )
    return best.select(rows.alias("r")).select("r.*").filter(F.col("path").isNotNull())
