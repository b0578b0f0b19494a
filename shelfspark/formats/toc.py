"""Tables of contents of EPUB books, flattened: nav documents first, NCX where there is no nav."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame

from shelfspark.functions.frames import frames

SCHEMA = "path string, list string, toc_path array<int>, depth int, label string, href string"
LISTS = {"toc": "toc", "page-list": "page_list", "landmarks": "landmarks"}
EPUB_TYPE = "{http://www.idpf.org/2007/ops}type"


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _child(e: ET.Element, name: str) -> ET.Element | None:
    return next((c for c in e if _local(c) == name), None)


def _text(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _href(value: str | None) -> str | None:
    return unquote(value) if value else None


def _nav_items(ol: ET.Element | None, above: list[int]) -> Iterator[tuple]:
    items = [c for c in ol if _local(c) == "li"] if ol is not None else []
    for i, li in enumerate(items):
        link = _child(li, "a")
        link = link if link is not None else _child(li, "span")
        at = [*above, i]
        href = link.get("href") if link is not None else None
        yield at, _text(link) or (link.get("title") if link is not None else None), _href(href)
        yield from _nav_items(_child(li, "ol"), at)


def _ncx_items(parent: ET.Element | None, name: str, above: list[int]) -> Iterator[tuple]:
    items = [c for c in parent if _local(c) == name] if parent is not None else []
    for i, item in enumerate(items):
        content, at = _child(item, "content"), [*above, i]
        yield at, _text(_child(item, "navLabel")), _href(content.get("src") if content is not None else None)
        if name == "navPoint":
            yield from _ncx_items(item, name, at)


def _lists(root: ET.Element) -> Iterator[tuple[str, Iterator[tuple]]]:
    if _local(root) == "ncx":
        yield "toc", _ncx_items(_child(root, "navMap"), "navPoint", [])
        yield "page_list", _ncx_items(_child(root, "pageList"), "pageTarget", [])
        return
    seen = set()
    for nav in (e for e in root.iter() if _local(e) == "nav"):
        types = (nav.get(EPUB_TYPE) or nav.get("type") or "").split()
        name = next((LISTS[t] for t in LISTS if t in types), "other")
        if name == "other" or name not in seen:
            seen.add(name)
            yield name, _nav_items(_child(nav, "ol"), [])


def toc_rows(documents: DataFrame) -> DataFrame:
    """Documents (path, xml) to rows in reading order; a document that is not XML gives no rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for path, xml in zip(batch["path"], batch["xml"]):
                try:
                    root = ET.fromstring(xml)
                except (ET.ParseError, TypeError):
                    continue
                for name, items in _lists(root):
                    yield from ((path, name, at, len(at) - 1, label, href) for at, label, href in items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return frames(rows(batches), SCHEMA)

    return documents.select("path", "xml").mapInPandas(run, SCHEMA)
