"""Functions of XML and HTML text: titles, authors, namespaces, script-free text, blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.constants import BLOCK_TAGS
from shelfspark.functions.text import SPACE, col, decode_entities, decode_xml_entities, empty_to_null, let, strip_space, tail


# A tag with its attributes, whose values may hold ">"; else up to the next ">". Possessive, so without recursion.
INSIDE_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TAG = rf"<{INSIDE_TAG}|<[^>]*>"
CDATA = "<![CDATA["


def extract_title(xml: Column | str) -> Column:
    """Text of the first title; '' when there is none."""
    return decode_xml_entities(strip_space(F.regexp_extract(col(xml), r"(?s)<title[^>]*>(.*?)</title>", 1)))


def extract_author(xml: Column | str) -> Column:
    pattern = rf"(?s)<author>{SPACE}*<name>(.*?)</name>{SPACE}*</author>"
    raw = empty_to_null(F.regexp_extract(col(xml), pattern, 1))
    return decode_xml_entities(strip_space(raw))


def without_scripts(html: Column | str) -> Column:
    """HTML without comments and without the content of script and style."""
    return F.regexp_replace(
        col(html), r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", ""
    )


def body_of(html: Column | str) -> Column:
    """What stands inside the body element; the whole text when there is no body tag."""
    h = col(html)
    inner = F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    return F.when(h.rlike(r"(?i)<body\b"), inner).otherwise(h)


def _nodes(markup: Column) -> Column:
    return F.transform(F.filter(F.split(markup, TAG), lambda p: p != ""), decode_entities)


def _nodes_with_cdata(markup: Column) -> Column:
    """Text nodes where sections are nodes of their own, as they stand; one without an end goes up to the next section."""
    section = r"(?s)^<!\[CDATA\[(.*?)(?:\]\]>|\z)"

    def nodes(piece: Column) -> Column:
        inner = F.filter(F.array(F.regexp_extract(piece, section, 1)), lambda t: t != "")
        return F.when(piece.startswith(CDATA), F.concat(inner, _nodes(F.regexp_replace(piece, section, "")))).otherwise(_nodes(piece))

    return F.flatten(F.transform(F.split(markup, r"(?=<!\[CDATA\[)"), nodes))


def text_segments(html: Column | str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Decoded text nodes of the body in document order, CDATA sections among them, script and style left out.

    ``keep`` is a further condition on the text of a node.
    """
    body = body_of(without_scripts(html))
    nodes = let(body, lambda b: F.when(b.contains(CDATA), _nodes_with_cdata(b)).otherwise(_nodes(b)))
    return nodes if keep is None else F.filter(nodes, keep)


def block_texts(html: Column | str) -> Column:
    """Decoded texts between the starts of block elements, blank ones dropped."""
    starts = rf"(?i)<(?:{'|'.join(BLOCK_TAGS)})(?:>|[\s/](?:{INSIDE_TAG}|[^>]*>))"
    body = body_of(without_scripts(html))
    blocks = F.split(body, starts)
    # Text before the first block belongs to no block, unless there is no block at all.
    kept = F.when(F.size(blocks) > 1, tail(blocks, 2)).otherwise(blocks)
    texts = F.transform(kept, lambda b: decode_entities(F.regexp_replace(b, TAG, "")))
    return F.filter(texts, lambda t: strip_space(t) != "")


def links_of(html: Column | str) -> Column:
    """href values of the anchors, in document order."""
    return F.regexp_extract_all(col(html), F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))
