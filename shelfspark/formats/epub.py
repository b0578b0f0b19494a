"""EPUB: package document, metadata, cover, manifest, spine, contributors, identifiers."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import COVER_IMAGE_EXTENSIONS, PACKAGE_TYPE, RELATORS
from shelfspark.formats.common import metadata
from shelfspark.functions.links import identifier_to_urn
from shelfspark.functions.text import (
    clean_description,
    empty_to_null,
    first_string,
    get_string,
    let,
    parse_date,
    string_array,
)
from shelfspark.operators.feeds import XML_OPTIONS
from shelfspark.sources.archives import map_archives, source_column

CONTAINER = "META-INF/container.xml"
ELEMENT = "array<struct<_VALUE:string,_id:string,_role:string,`_file-as`:string,_scheme:string,_event:string,_lang:string>>"
META = "array<struct<_VALUE:string,_id:string,_name:string,_content:string,_property:string,_refines:string,_scheme:string>>"
ELEMENTS = [
    "title", "creator", "contributor", "description", "publisher", "date", "language", "subject", "rights",
    "identifier", "source",
]
PACKAGE = (
    f"metadata struct<{','.join(f'{n}:{ELEMENT}' for n in ELEMENTS)},meta:{META}>,"
    "manifest struct<item:array<struct<_id:string,_href:string,_properties:string,`_media-type`:string>>>,"
    "spine struct<_toc:string,itemref:array<struct<_idref:string,_linear:string>>>"
)
IMAGE = rf"(?i)\.(?:{'|'.join(COVER_IMAGE_EXTENSIONS)})$"


def _package_path(container: bytes) -> str | None:
    """Address of the package document: by media type, else the first one named."""
    try:
        found = [e for e in ET.fromstring(container).iter() if e.tag.rsplit("}", 1)[-1] == "rootfile"]
    except ET.ParseError:
        return None
    typed = [e for e in found if e.get("media-type") == PACKAGE_TYPE and e.get("full-path")]
    return (typed or found)[0].get("full-path") if found else None


def _read_package(row, archive):
    container = archive.read(CONTAINER)
    path = _package_path(container) if container else None
    data = archive.read(path) if path else None
    if data:
        yield row.path, path, data.decode("utf-8", "replace"), archive.names()


def packages(files: DataFrame) -> DataFrame:
    """Parsed package documents: path, package_path, members, p (struct). Books without one give no row."""
    raw = map_archives(
        files.select("path", source_column(files)), _read_package,
        "path string, package_path string, xml string, members array<string>",
    )
    return raw.select("path", "package_path", "members", F.from_xml("xml", PACKAGE, XML_OPTIONS).alias("p"))


def _texts(name: str) -> Column:
    return F.transform(F.col(f"p.metadata.{name}"), lambda e: e["_VALUE"])


def _single(name: str) -> Column:
    """Text of an element that stands once; several of them count as none."""
    values = _texts(name)
    return F.when(F.size(values) == 1, get_string(F.element_at(values, 1)))


def package_metadata() -> Column:
    return metadata(
        title=_single("title"),
        author=first_string(_texts("creator")),
        description=clean_description(_single("description")),
        publisher=_single("publisher"),
        issued=parse_date(_single("date")),
        language=_single("language"),
        subjects=string_array(_texts("subject")),
        rights=_single("rights"),
    )


def package_cover() -> Column:
    """Member of the cover: by cover id, by manifest property, by name, or the first image."""
    items, metas = F.col("p.manifest.item"), F.col("p.metadata.meta")
    first = lambda array, test: F.try_element_at(F.filter(array, test), F.lit(1))
    directory = F.regexp_replace("package_path", "[^/]+$", "")
    cover_id = first(metas, lambda m: m["_name"] == "cover")["_content"]
    by_id = let(cover_id, lambda wanted: first(items, lambda i: i["_id"] == wanted)["_href"])
    by_property = first(items, lambda i: i["_properties"].contains("cover-image"))["_href"]
    images = F.filter("members", lambda m: m.rlike(IMAGE))
    named = first(images, lambda m: m.rlike("(?i)cover" + IMAGE.removeprefix("(?i)")))
    containing = first(images, lambda m: F.lower(m).contains("cover"))
    listed = F.coalesce(by_id, by_property)
    return F.coalesce(
        F.when(listed.isNotNull(), F.concat(directory, listed)), named, containing,
        F.try_element_at(F.array_sort(images), F.lit(1)),
    )


def epub_metadata(files: DataFrame) -> DataFrame:
    """Rows (path, meta, cover); cover is the archive member with the cover image."""
    return packages(files).select("path", package_metadata().alias("meta"), package_cover().alias("cover"))


# --- package tables for the reader ---------------------------------------------------------------


def manifest_items(parsed: DataFrame) -> DataFrame:
    """Rows (path, pos, id, href, media_type, properties)."""
    rows = parsed.select("path", F.posexplode("p.manifest.item").alias("pos", "i"))
    return rows.select(
        "path", "pos", F.col("i._id").alias("id"), F.col("i._href").alias("href"),
        F.col("i.`_media-type`").alias("media_type"), F.split("i._properties", r"\s").alias("properties"),
    )


def spine_sections(parsed: DataFrame) -> DataFrame:
    """Spine with the manifest items it names: path, section, id, href, linear.

    Spine and manifest stand in the same package, so the join stays inside the row. References
    without an item are dropped.
    """
    target = lambda s: F.try_element_at(F.filter("p.manifest.item", lambda i: i["_id"] == s["_idref"]), F.lit(-1))
    spine = F.transform(
        "p.spine.itemref",
        lambda s: F.struct(s["_idref"].alias("id"), target(s)["_href"].alias("href"), s["_linear"].alias("linear")),
    )
    rows = parsed.select("path", F.posexplode(spine).alias("section", "s")).select("path", "section", "s.*")
    return rows.filter("href is not null")


def item_by_property(items: DataFrame, name: str) -> DataFrame:
    """First manifest item of each book with a property."""
    return items.filter(F.array_contains("properties", name)).groupBy("path").agg(F.min_by("href", "pos").alias("href"))


def package_elements(parsed: DataFrame) -> DataFrame:
    """Metadata elements of all names: path, name, pos, id, value, role, file_as, scheme, event, lang."""
    tagged = F.flatten(
        F.array(*[
            F.transform(
                F.coalesce(F.col(f"p.metadata.{n}"), F.array().cast(ELEMENT)),
                lambda e, i: F.struct(F.lit(n).alias("name"), i.alias("pos"), e.alias("e")),
            )
            for n in ELEMENTS
        ])
    )
    rows = parsed.select("path", F.explode(tagged).alias("t"))
    return rows.select(
        "path", "t.name", "t.pos", F.col("t.e._id").alias("id"), F.trim("t.e._VALUE").alias("value"),
        F.col("t.e._role").alias("role"), F.col("t.e.`_file-as`").alias("file_as"),
        F.col("t.e._scheme").alias("scheme"), F.col("t.e._event").alias("event"), F.col("t.e._lang").alias("lang"),
    )


def package_properties(parsed: DataFrame) -> DataFrame:
    """meta elements: path, pos, id, name, content, property, refines, scheme, value."""
    rows = parsed.select("path", F.posexplode("p.metadata.meta").alias("pos", "m"))
    return rows.select(
        "path", "pos", F.col("m._id").alias("id"), F.col("m._name").alias("name"), F.col("m._content").alias("content"),
        F.col("m._property").alias("property"), F.col("m._refines").alias("refines"),
        F.col("m._scheme").alias("scheme"), F.trim("m._VALUE").alias("value"),
    )


def refinements(properties: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements with each property that refines them: path, name, pos, id, property, refined, scheme."""
    refined = properties.filter("refines is not null").select(
        "path", F.regexp_replace("refines", "^#", "").alias("id"), "property",
        F.col("value").alias("refined"), F.col("scheme").alias("refined_scheme"),
    )
    return elements.join(refined, ["path", "id"])


def contributors(elements: DataFrame, properties: DataFrame) -> DataFrame:
    """Rows (path, pos, person, role): each person under each of their roles.

    Codes come from refinements, else from the element; unknown codes and no code give the default
    role of the element.
    """
    people = elements.filter(F.col("name").isin("creator", "contributor"))
    default = F.when(F.col("name") == "creator", "author").otherwise("contributor")
    refined = refinements(properties, people).filter("property = 'role'").select("path", "name", "pos", "refined")
    codes = people.join(refined, ["path", "name", "pos"], "left").withColumn("code", F.coalesce("refined", "role"))
    roles = people.sparkSession.createDataFrame(list(RELATORS.items()), "code string, named string")
    return (
        codes.join(F.broadcast(roles), "code", "left")
        .select("path", "name", "pos", F.col("value").alias("person"), F.coalesce("named", default).alias("role"))
        .distinct()
    )


def collections(properties: DataFrame) -> DataFrame:
    """Rows (path, pos, collection, kind, position): series and other collections of a book."""
    named = properties.filter("property = 'belongs-to-collection' and refines is null")
    named = named.select("path", "pos", "id", F.col("value").alias("collection"))
    facts = properties.filter("refines is not null").select("path", F.regexp_replace("refines", "^#", "").alias("id"), "property", "value")
    by_id = facts.groupBy("path", "id").agg(
        F.first(F.when(F.col("property") == "collection-type", F.col("value")), ignorenulls=True).alias("type"),
        F.first(F.when(F.col("property") == "group-position", F.col("value")), ignorenulls=True).alias("position"),
    )
    kind = F.when(F.col("type") == "series", "series").otherwise("collection")
    return named.join(by_id, ["path", "id"], "left").select("path", "pos", "collection", kind.alias("kind"), "position")


def identifiers(elements: DataFrame, properties: DataFrame) -> DataFrame:
    """Rows (path, pos, identifier) as URNs where a type is known."""
    ids = elements.filter("name = 'identifier'")
    typed = refinements(properties, ids).filter("property = 'identifier-type'").select("path", "pos", F.col("refined").alias("code"))
    rows = ids.join(typed, ["path", "pos"], "left")
    return rows.select("path", "pos", identifier_to_urn("value", "scheme", "code").alias("identifier"))


def reader_metadata(elements: DataFrame) -> DataFrame:
    """Elements grouped by name: one row per (path, name) with the first value and the count."""
    return elements.filter(empty_to_null("value").isNotNull()).groupBy("path", "name").agg(
        F.min_by("value", "pos").alias("value"), F.count(F.lit(1)).alias("count")
    )
