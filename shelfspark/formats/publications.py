"""Feeds as a reader sees them: publications, navigation, links with prices, groups, facets."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import COVER_RELS, REL_ACQUISITION, REL_FACET, REL_GROUP, THUMBNAIL_RELS
from shelfspark.functions.frames import map_rows
from shelfspark.functions.links import is_catalog_type
from shelfspark.operators.links import choose_groups

ATOM = "{http://www.w3.org/2005/Atom}"
OPDS = "{http://opds-spec.org/2010/catalog}"
THR = "{http://purl.org/syndication/thread/1.0}"
DC = "{http://purl.org/dc/elements/1.1/}"
DCTERMS = "{http://purl.org/dc/terms/}"

LINK = (
    "struct<rel:array<string>,href:string,type:string,title:string,currency:string,price:string,"
    "indirect:array<string>,count:string,facet_group:string>"
)
ENTRY = (
    "feed string, pos int, title string, authors array<string>, contributors array<string>, publisher string, "
    "published string, language string, identifier string, subjects array<struct<name:string,code:string,scheme:string>>, "
    f"rights string, content string, content_type string, links array<{LINK}>"
)


def _all_text(e: ET.Element | None) -> str | None:
    return "".join(e.itertext()) if e is not None else None


def _indirect(e: ET.Element) -> list[str | None]:
    """Types of the chain of nested acquisitions."""
    inner = next(e.iter(f"{OPDS}indirectAcquisition"), None) if e.tag != f"{OPDS}indirectAcquisition" else next(
        (c for c in e.iter(f"{OPDS}indirectAcquisition") if c is not e), None
    )
    return [] if inner is None else [inner.get("type"), *_indirect(inner)]


def _link(e: ET.Element) -> dict:
    rel = e.get("rel").split() if e.get("rel") is not None else []
    if e.get(f"{OPDS}activeFacet") == "true":
        rel = [*rel, "self"]
    price = next(e.iter(f"{OPDS}price"), None)
    return {
        "rel": rel, "href": e.get("href"), "type": e.get("type"), "title": e.get("title"),
        "currency": price.get("currencycode") if price is not None else None, "price": _all_text(price),
        "indirect": _indirect(e), "count": e.get(f"{THR}count"), "facet_group": e.get(f"{OPDS}facetGroup"),
    }


def _person(e: ET.Element, ns: str) -> str:
    return _all_text(next(e.iter(f"{ns}name"), None)) or ""


def _content(e: ET.Element | None) -> tuple[str | None, str | None]:
    if e is None:
        return None, None
    kind = e.get("type", "text")
    if kind == "xhtml":
        return (e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), kind
    text = _all_text(e)
    if kind == "html":
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
            text = text.replace(name, char)
    return text, kind


def _entries(feed: str, xml: str) -> Iterator[tuple]:
    """Row 0 is the feed itself, then one row per entry."""
    root = ET.fromstring(xml)
    # Without the Atom namespace anywhere, bare names are accepted.
    ns = ATOM if any(isinstance(e.tag, str) and e.tag.startswith(ATOM) for e in root.iter()) else ""
    for pos, e in enumerate([root, *root.findall(f"{ns}entry")]):
        first = lambda *tags: next((c for t in tags for c in e if c.tag == t), None)
        # A Dublin Core element of either vocabulary: the one that stands first counts.
        dc = lambda name: _all_text(next((c for c in e if c.tag in (DC + name, DCTERMS + name)), None))
        issued = first(f"{DCTERMS}issued")
        summary = first(f"{ns}content", f"{ns}summary")
        content, kind = _content(summary if pos else first(f"{ns}subtitle"))
        subjects = [
            {"name": c.get("label"), "code": c.get("term"), "scheme": c.get("scheme")} for c in e if c.tag == f"{ns}category"
        ]
        yield (
            feed, pos, _all_text(first(f"{ns}title")) or "",
            [_person(c, ns) for c in e if c.tag == f"{ns}author"],
            [_person(c, ns) for c in e if c.tag == f"{ns}contributor"],
            dc("publisher"), _all_text(issued) if issued is not None else dc("date"), dc("language"), dc("identifier"),
            subjects, _all_text(first(f"{ns}rights")) or "", content, kind,
            [_link(c) for c in e if c.tag == f"{ns}link"],
        )


def reader_entries(documents: DataFrame, key: str = "path", xml: str = "xml") -> DataFrame:
    """Feed documents to entry rows (pos 0 is the feed itself); a broken document gives no rows."""

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for row in found:
            try:
                yield from _entries(getattr(row, key), getattr(row, xml))
            except (ET.ParseError, TypeError):
                continue

    return map_rows(documents.select(key, xml), rows, ENTRY)


def has_rel(link: Column, rel: str) -> Column:
    return F.array_contains(link["rel"], rel)


def is_publication() -> Column:
    """Some link is an acquisition of any kind, or a preview."""
    return F.exists("links", lambda l: F.exists(l["rel"], lambda r: r.startswith(REL_ACQUISITION) | (r == "preview")))


def images() -> Column:
    """Addresses of the images: the first link of each relation, covers before thumbnails."""
    found = [
        F.try_element_at(F.filter("links", lambda l: has_rel(l, rel)), F.lit(1))["href"]
        for rel in [*COVER_RELS, *THUMBNAIL_RELS]
    ]
    return F.array_compact(F.array(*found))


def publications(entries: DataFrame) -> DataFrame:
    rows = entries.filter(F.col("pos") > 0).filter(is_publication())
    return rows.withColumn("images", images())


def navigation(entries: DataFrame) -> DataFrame:
    """Entries that are no publication, with their catalog link, or their first one."""
    rows = entries.filter(F.col("pos") > 0).filter(~is_publication())
    first = lambda links: F.try_element_at(links, F.lit(1))
    link = F.coalesce(first(F.filter("links", lambda l: is_catalog_type(l["type"]))), first(F.col("links")))
    summary = F.when(F.col("content_type") == "text", F.col("content"))
    return rows.select("feed", "pos", "title", link["href"].alias("href"), link["type"].alias("type"), summary.alias("summary"))


def item_groups(entries: DataFrame) -> DataFrame:
    """Group of each entry: feed, pos, group (null for none), is_publication."""
    rows = entries.filter(F.col("pos") > 0).withColumn("is_publication", is_publication())
    named = lambda rel: F.filter("links", lambda l: has_rel(l, rel))
    links = F.when(F.size(named(REL_GROUP)) > 0, named(REL_GROUP)).otherwise(named("collection"))
    keyed = rows.select("feed", "pos", F.transform(links, lambda l: l["href"]).alias("links"))
    return choose_groups(keyed).join(rows.select("feed", "pos", "is_publication"), ["feed", "pos"])


def facets(entries: DataFrame) -> DataFrame:
    """Facet links of each feed: feed, facet_group, pos, href, title, active."""
    rows = entries.filter("pos = 0").select("feed", F.posexplode("links").alias("pos", "l"))
    rows = rows.filter(F.array_contains("l.rel", REL_FACET))
    return rows.select(
        "feed", F.col("l.facet_group").alias("facet_group"), "pos", "l.href", "l.title",
        F.array_contains("l.rel", "self").alias("active"),
    )
