"""Feed documents and folder pages as ordered parts.

A document is written as rows (folder, part, text): part 0 opens it, then come parts of at most
``PART_ENTRIES`` entries, the last one closes it. Joining the texts of a folder in the order of the
parts, with nothing between them, gives the document. A folder of any size is thus rendered by many
tasks and never gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions.links import browser_href, format_from_mime, is_viewable, safe_link
from shelfspark.functions.text import col, empty_to_null, html_escape, xml_attribute, xml_text
from shelfspark.operators.feeds import ENTRY_PATTERN, feed_headers
from shelfspark.plans.entries import feed_type

PART_ENTRIES = 1000
LAST_PART = 2**31 - 1

# Markup of a feed document (fixed values).
FEED_OPEN = (
    '<?xml version="1.0" encoding="utf-8"?>\n'
    '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opds="http://opds-spec.org/2010/catalog"'
    ' xmlns:dc="http://purl.org/dc/terms/">\n'
)
NAVIGATION_LINK_TYPE = "application/atom+xml;profile=opds-catalog;kind=navigation"

# Markup of a folder page (fixed values). {name} marks an escaped value or a nested piece.
PAGE_OPEN = """<!DOCTYPE html>
<html lang="en">
  <head>
    <meta charset="UTF-8" />
    <meta name="viewport" content="width=device-width, initial-scale=1.0" />
    <title>{title}</title>
    <link rel="stylesheet" href="/static/style.css" />
    <link rel="icon" type="image/png" href="/static/favicon/favicon-96x96.png" sizes="96x96" />
    <link rel="icon" type="image/svg+xml" href="/static/favicon/favicon.svg" />
    <link rel="shortcut icon" href="/static/favicon/favicon.ico" />
    <link rel="apple-touch-icon" sizes="180x180" href="/static/favicon/apple-touch-icon.png" />
    <link rel="manifest" href="/static/favicon/site.webmanifest" />
  </head>
  <body>
    <header class="header">
      <div class="header__left">
        <nav class="header__breadcrumb">{home}
        </nav>
        <h1 class="header__title">{title}</h1>
      </div>
    </header>
    <main class="books-grid" data-element=".card__title a">
"""
PAGE_HOME = """
        <a class="header__home" href="{start}" aria-label="Home">
          <svg xmlns="http://www.w3.org/2000/svg" class="header__icon" viewBox="0 0 24 24" fill="currentColor" aria-hidden="true">
            <path d="M10 20v-6h4v6h5v-8h3L12 3 2 12h3v8z" />
          </svg>
        </a>"""
PAGE_CLOSE = """
    </main>
    <script src="/static/main.js"></script>
  </body>
</html>
"""
FOLDER_SHELF = """<div class="book" aria-hidden="true"><div class="book__cover"><span>{title}</span></div></div>"""
FOLDER_CARD = """      <div>
        <article class="card card--folder">
        {shelf}
        {shelf}
        {shelf}
        <div class="card__info">
          <h3 class="card__title"><a href="{href}">{title}</a></h3>{summary}
        </div>
        </article>
      </div>"""
CARD_TEXT = """
          <p class="card__description">{value}</p>"""
BOOK_CARD = """      <div>
        <article class="card card--book">
          <div class="book" aria-hidden="true">
            <div class="book__cover">{card_cover}</div>
          </div>
          <div class="card__info">
            <h3 class="card__title"><a href="#book-{number}">{title}</a></h3>{card_author}
          </div>
        </article>
        <dialog class="popup" id="book-{number}" aria-labelledby="book-{number}-title">
          <div class="popup__content">
            <div class="popup__cover" aria-hidden="true">
              <div class="book"><div class="book__cover">{popup_cover}</div></div>
            </div>
            <div class="popup__info">
              <a class="popup__close-button" href="#"><span>Close</span></a>
              <hgroup>
                <h2 class="popup__title" id="book-{number}-title">{title}</h2>{popup_author}
              </hgroup>{popup_summary}
              <div class="popup__footer">{meta}{downloads}
              </div>
            </div>
          </div>
        </dialog>
      </div>"""
POPUP_AUTHOR = """
                <p class="popup__author">{value}</p>"""
POPUP_SUMMARY = """
              <p class="popup__description">{value}</p>"""
POPUP_META = """
                <div class="popup__meta">
                  {value}
                </div>"""
POPUP_DOWNLOADS = """
                <div class="popup__downloads">
                  {value}
                </div>"""
COVER_IMAGE = '<img src="{src}" alt="{title}"{loading} />'
COVER_TEXT = "<span>{title}</span>"
DOWNLOAD = '<a href="{href}" class="popup__download-btn">{label}</a>'
VIEW = ' <a href="/static/read.html#{href}" class="popup__view-btn">View</a>'
ITEM_BREAK = "\n                  "


def fill(template: str, **values: Column) -> Column:
    """Template text with each ``{name}`` replaced by a column; null when a value is null."""
    pieces, rest = [], template
    while rest:
        start, stop = rest.find("{"), rest.find("}")
        if start < 0:
            pieces.append(F.lit(rest))
            break
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(values[rest[start + 1 : stop]])
        rest = rest[stop + 1 :]
    return F.concat(*pieces)


def _optional(template: str, value: Column) -> Column:
    """Filled template, or '' for a null or empty value. The value is escaped already."""
    return F.coalesce(fill(template, value=empty_to_null(value)), F.lit(""))


def meta_line(escaped: bool = True) -> Column:
    """array of the texts under a book: subjects, format and size, date and language, series."""
    parts = F.array(
        F.array_join("subjects", ", "),
        F.concat_ws(" · ", empty_to_null("format"), empty_to_null("content")),
        F.concat_ws(" · ", empty_to_null("issued"), empty_to_null("language")),
        F.col("is_part_of"),
    )
    kept = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
    return F.transform(kept, html_escape) if escaped else kept


def _cover(src: Column, loading: str) -> Column:
    title = html_escape("title")
    image = fill(COVER_IMAGE, src=html_escape(safe_link(src)), title=title, loading=F.lit(loading))
    return F.coalesce(F.when(empty_to_null(src).isNotNull(), image), fill(COVER_TEXT, title=title))


def _downloads() -> Column:
    def button(a: Column) -> Column:
        href, label = safe_link(a["href"]), format_from_mime(a["type"])
        download = fill(DOWNLOAD, href=html_escape(href), label=label)
        view = F.when(is_viewable(label, href), fill(VIEW, href=html_escape(href))).otherwise("")
        return F.concat(download, view)

    return _optional(POPUP_DOWNLOADS, F.array_join(F.transform("acquisitions", button), ITEM_BREAK))


def entry_card() -> Column:
    """Card of one entry on the page of its folder."""
    title = html_escape("title")
    href = html_escape(F.coalesce(safe_link(browser_href("href")), F.lit("#")))
    folder = fill(
        FOLDER_CARD, shelf=fill(FOLDER_SHELF, title=title), href=href, title=title,
        summary=_optional(CARD_TEXT, html_escape("summary")),
    )
    spans = F.array_join(F.transform(meta_line(), lambda v: F.concat(F.lit("<span>"), v, F.lit("</span>"))), ITEM_BREAK)
    book = fill(
        BOOK_CARD, title=title, number=F.col("book_no").cast("string"),
        card_cover=_cover(F.col("thumbnail"), ' loading="lazy"'),
        popup_cover=_cover(F.coalesce("cover", "thumbnail"), ""),
        card_author=_optional(CARD_TEXT, html_escape("author")),
        popup_author=_optional(POPUP_AUTHOR, html_escape("author")),
        popup_summary=_optional(POPUP_SUMMARY, html_escape("summary")),
        meta=_optional(POPUP_META, spans), downloads=_downloads(),
    )
    return F.when(F.col("kind") == "folder", folder).otherwise(book)


def _body_parts(entries: DataFrame, piece: Column) -> DataFrame:
    """Entries joined to parts of bounded size; a line break stands between two entries."""
    rows = entries.select("folder", "pos", piece.alias("piece"))
    part = F.floor((F.col("pos") - 1) / PART_ENTRIES).cast("int") + 1
    grouped = rows.groupBy("folder", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("items")
    )
    text = F.array_join(F.transform("items", lambda i: i["piece"]), "\n")
    return grouped.select("folder", "part", F.when(F.col("part") > 1, F.concat(F.lit("\n"), text)).otherwise(text).alias("text"))


def feed_document_parts(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Feed documents; the ``xml`` of the entries is spliced in unchanged."""
    opening = F.concat(
        F.lit(FEED_OPEN),
        F.lit("  <id>"), xml_text("id"), F.lit("</id>\n  <title>"), xml_text("title"),
        F.lit("</title>\n  <updated>"), col("updated"), F.lit("</updated>\n  <link rel=\"self\" href=\""),
        xml_attribute("self_href"), F.lit('" type="'), feed_type("kind"),
        F.lit('"/>\n  <link rel="start" href="'), xml_attribute("start_href"),
        F.lit(f'" type="{NAVIGATION_LINK_TYPE}"/>\n'),
    )
    opened = feeds.select("folder", F.lit(0).alias("part"), opening.alias("text"))
    closed = feeds.select("folder", F.lit(LAST_PART).alias("part"), F.lit("\n</feed>").alias("text"))
    return opened.unionByName(_body_parts(entries, F.col("xml"))).unionByName(closed)


def folder_page_parts(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    """Folder pages of parsed and numbered entries."""
    title = html_escape("title")
    home = F.when(F.col("self_href") == F.col("start_href"), F.lit("")).otherwise(
        fill(PAGE_HOME, start=html_escape(safe_link(browser_href("start_href"))))
    )
    opened = feeds.select("folder", F.lit(0).alias("part"), fill(PAGE_OPEN, title=title, home=home).alias("text"))
    closed = feeds.select("folder", F.lit(LAST_PART).alias("part"), F.lit(PAGE_CLOSE).alias("text"))
    # A card that cannot be rendered leaves a gap on the page and never touches the feed.
    card = F.coalesce(entry_card(), F.lit(""))
    return opened.unionByName(_body_parts(entries, card)).unionByName(closed)


def part_headers(parts: DataFrame) -> DataFrame:
    """Feed headers read back from the opening parts."""
    opening = parts.filter("part = 0").select("folder", F.concat("text", F.lit("</feed>")).alias("xml"))
    return feed_headers(opening, "folder")


def part_fragments(parts: DataFrame) -> DataFrame:
    """Entry fragments read back from the parts: folder, pos, xml. No document is put together."""
    bodies = parts.filter((F.col("part") > 0) & (F.col("part") < LAST_PART))
    rows = bodies.select(
        "folder", "part", F.posexplode(F.regexp_extract_all("text", F.lit(f"({ENTRY_PATTERN})"), F.lit(1))).alias("at", "xml")
    )
    pos = (F.col("part") - 1) * PART_ENTRIES + F.col("at") + 1
    return rows.select("folder", pos.alias("pos"), "xml")


def join_parts(parts: DataFrame) -> DataFrame:
    """Whole documents, one row per folder: for folders known to be small, such as in tests."""
    window = Window.partitionBy("folder").orderBy("part")
    numbered = parts.withColumn("part", F.row_number().over(window))
    return numbered.groupBy("folder").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("document")
    )


def write_parts(parts: DataFrame, path: str) -> None:
    """Write document parts sorted by folder and part, so one folder is one run of rows."""
    parts.repartitionByRange("folder", "part").sortWithinPartitions("folder", "part").write.mode("overwrite").parquet(path)
