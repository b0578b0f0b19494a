"""FB2: description of a book, its cover, and its body as sections and table of contents."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.formats.common import metadata
from shelfspark.functions.frames import map_rows
from shelfspark.functions.text import (
    clean_description,
    collapse_space,
    decode_entities,
    empty_to_null,
    get_string,
    person_name,
    string_array,
)
from shelfspark.operators.feeds import XML_OPTIONS
from shelfspark.sources.archives import book_texts

PERSON = "array<struct<`first-name`:string,`middle-name`:string,`last-name`:string,nickname:string>>"
DESCRIPTION = (
    f"`title-info` struct<`book-title`:string,author:{PERSON},genre:array<string>,"
    "date:struct<_VALUE:string,_value:string>,lang:string,coverpage:struct<image:array<struct<_href:string>>>,"
    "sequence:array<struct<_name:string,_number:string>>>,`publish-info` struct<publisher:string,year:string>"
)
BINARY = r'(?s)<binary\b[^>]*?\bid="{id}"[^>]*>(.*?)</binary>'


def fb2_metadata(files: DataFrame) -> DataFrame:
    """Rows (path, meta, cover); cover is the id of the embedded image."""
    # Only the description is read; the body and the images, most of the file, are left alone.
    texts = book_texts(files, end="</description>").filter(F.col("text").contains("<FictionBook"))
    head = F.regexp_extract("text", r"(?s)<description\b[^>]*>.*?</description>", 0)
    note = F.regexp_extract("__head", r"(?s)<annotation\b[^>]*>(.*?)</annotation>", 1)
    bare = F.regexp_replace("__head", r"(?s)<annotation\b[^>]*>.*?</annotation>", "")
    # The date element has a text and an attribute whose names differ only in case for the parser.
    date = F.coalesce(
        empty_to_null(F.regexp_extract("__info", r'<date\b[^>]*?\bvalue="([^"]*)"', 1)),
        empty_to_null(F.regexp_extract("__info", r"(?s)<date\b[^>]*>(.*?)</date>", 1)),
    )
    rows = texts.select("path", head.alias("__head"))
    rows = rows.withColumn("__info", F.regexp_extract("__head", r"(?s)<title-info\b.*?</title-info>", 0))
    schema = DESCRIPTION.replace("date:struct<_VALUE:string,_value:string>,", "")
    rows = rows.withColumn("d", F.from_xml(bare, schema, XML_OPTIONS)).withColumn("__note", note)
    t = lambda name: F.col(f"d.`title-info`.{name}")
    author = F.try_element_at(t("author"), F.lit(1))
    name = person_name(author["first-name"], author["middle-name"], author["last-name"], author["nickname"])
    sequence = t("sequence")
    meta = metadata(
        title=get_string(t("`book-title`")),
        author=F.when(author.isNotNull(), name),
        description=clean_description(decode_entities(F.regexp_replace("__note", "<[^>]+>", " "))),
        publisher=get_string("d.`publish-info`.publisher"),
        issued=get_string(date),
        language=get_string(t("lang")),
        subjects=string_array(t("genre")),
        series=F.when(F.size(sequence) == 1, get_string(F.element_at(sequence, 1)["_name"])),
    )
    image = F.try_element_at(t("coverpage.image"), F.lit(1))["_href"]
    return rows.select("path", meta.alias("meta"), F.regexp_replace(image, "^#", "").alias("cover"))


def fb2_binaries(files: DataFrame) -> DataFrame:
    """Embedded images: path, id, data (null when the text is not base64)."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?s)(<binary\b.*?</binary>)"), F.lit(1))
    rows = book_texts(files).select("path", F.explode(blocks).alias("b"))
    body = F.regexp_replace(F.regexp_extract("b", r"(?s)<binary\b[^>]*>(.*?)</binary>", 1), r"\s", "")
    return rows.select(
        "path", F.regexp_extract("b", r'<binary\b[^>]*?\bid="([^"]*)"', 1).alias("id"),
        F.try_to_binary(body, F.lit("base64")).alias("data"),
    )


def fb2_covers(files: DataFrame) -> DataFrame:
    """Cover bytes of each book that has one: an equi-join of cover ids and images."""
    wanted = fb2_metadata(files).select("path", F.col("cover").alias("id")).filter("id is not null")
    return wanted.join(fb2_binaries(files), ["path", "id"]).select("path", "data")


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def _text(e: ET.Element | None) -> str:
    return " ".join("".join(e.itertext()).split()) if e is not None else ""


def _body_rows(path: str, text: str) -> Iterator[tuple]:
    """Sections of the first body, then one non-linear section per further body."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return
    bodies = [e for e in root if _local(e) == "body"]
    parts = [(e, None) for e in (bodies[0] if bodies else [])] + [(b, "no") for b in bodies[1:]]
    for number, (part, linear) in enumerate(parts):
        head = part if _local(part) == "title" else next(
            (e for e in part.iter() if _local(e) in ("title", "subtitle", "p")), None
        )
        inner = [_text(next((c for c in s if _local(c) == "title"), None)) for s in part if _local(s) == "section"]
        size = len("".join(part.itertext()).encode())
        yield path, number, _text(head), size, linear, [] if linear else [t for t in inner if t]


def fb2_sections(files: DataFrame) -> DataFrame:
    """Rows (path, section, label, size, linear, subtitles); size counts text bytes, images excluded."""
    schema = "path string, section int, label string, size long, linear string, subtitles array<string>"

    rows = lambda books: (row for book in books for row in _body_rows(book.path, book.text))
    texts = book_texts(files).filter("text is not null")
    bare = F.regexp_replace("text", r"(?s)<binary\b.*?</binary>", "")
    return map_rows(texts.withColumn("text", bare), rows, schema).withColumn("label", collapse_space("label"))
