"""Catalog entries of books and folders, as rows and as XML fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import (
    ACQUISITION_TYPE,
    BOOK_URN,
    CATALOG_URN,
    DEFAULT_MEDIA_TYPE,
    FEED_FILE,
    MEDIA_TYPES,
    NAVIGATION_TYPE,
    REL_IMAGE,
    REL_OPEN_ACCESS,
    REL_SUBSECTION,
    REL_THUMBNAIL,
    ROOT_NAME,
)
from shelfspark.functions.paths import loose_extension, parent_path, path_name, strip_extension
from shelfspark.functions.text import (
    col,
    empty_to_null,
    encode_url_component,
    encode_url_path,
    folder_summary,
    format_file_size,
    normalize_title,
    xml_attribute,
    xml_text,
)


def media_types(spark) -> DataFrame:
    """The 14 known extensions and their media types: a dimension table of fixed size."""
    return spark.createDataFrame(list(MEDIA_TYPES.items()), "extension string, media_type string")


def with_media_type(files: DataFrame, extension: str = "extension") -> DataFrame:
    """Media type of each file; unknown extensions get the default one."""
    types = media_types(files.sparkSession).withColumnRenamed("extension", "__ext")
    return (
        files.join(F.broadcast(types), F.col(extension) == F.col("__ext"), "left")
        .drop("__ext")
        .withColumn("media_type", F.coalesce("media_type", F.lit(DEFAULT_MEDIA_TYPE)))
    )


def book_entries(files: DataFrame) -> DataFrame:
    """One entry row per file. Columns in: path, size, meta struct, has_cover."""
    m = lambda name: F.col(f"meta.{name}")
    name = path_name("path")
    url = F.concat(F.lit("/"), encode_url_path("path"))
    rows = with_media_type(files.withColumn("extension", loose_extension(name)))
    return rows.select(
        "path",
        parent_path("path").alias("folder"),
        name.alias("name"),
        F.lit("book").alias("kind"),
        F.concat(F.lit(BOOK_URN), "path").alias("id"),
        F.coalesce(empty_to_null(m("title")), normalize_title(strip_extension(name))).alias("title"),
        empty_to_null(m("author")).alias("author"),
        empty_to_null(m("description")).alias("summary"),
        F.upper("extension").alias("format"),
        format_file_size("size").alias("content"),
        empty_to_null(m("publisher")).alias("publisher"),
        empty_to_null(m("issued")).alias("issued"),
        empty_to_null(m("language")).alias("language"),
        m("subjects").alias("subjects"),
        F.when(m("page_count") != 0, F.concat(m("page_count").cast("string"), F.lit(" pages"))).alias("extent"),
        empty_to_null(m("series")).alias("is_part_of"),
        empty_to_null(m("rights")).alias("rights"),
        F.when(F.col("has_cover"), F.concat(url, F.lit("/cover.jpg"))).alias("cover"),
        F.when(F.col("has_cover"), F.concat(url, F.lit("/thumb.jpg"))).alias("thumbnail"),
        F.concat(url, F.lit("/"), encode_url_component(name)).alias("acquisition"),
        "media_type",
    )


def folder_title(folder: Column | str) -> Column:
    """Readable folder name; the root and a folder named like it keep the root name."""
    name = path_name(folder)
    return F.when(name.isin("", ROOT_NAME), F.lit(ROOT_NAME)).otherwise(normalize_title(name))


def feed_id(folder: Column | str) -> Column:
    return F.concat(F.lit(CATALOG_URN), F.when(col(folder) == "", "root").otherwise(col(folder)))


def feed_href(folder: Column | str) -> Column:
    path = F.concat(F.lit("/"), encode_url_path(folder), F.lit(f"/{FEED_FILE}"))
    return F.when(col(folder) == "", F.lit(f"/{FEED_FILE}")).otherwise(path)


def folder_entries(structure: DataFrame) -> DataFrame:
    """One entry row per folder but the root. Columns in: folder, folder_count, book_count."""
    return structure.filter("folder <> ''").select(
        F.col("folder").alias("path"),
        parent_path("folder").alias("folder"),
        path_name("folder").alias("name"),
        F.lit("folder").alias("kind"),
        feed_id("folder").alias("id"),
        folder_title("folder").alias("title"),
        folder_summary("folder_count", "book_count").alias("summary"),
        feed_href("folder").alias("href"),
    )


def _element(tag: str, value: Column | str, attributes: str = "") -> Column:
    """Line of one element; null for a null value, so that ``concat_ws`` leaves it out."""
    return F.concat(F.lit(f"  <{tag}{attributes}>"), xml_text(value), F.lit(f"</{tag}>"))


def _link(rel: str, href: Column | str, media_type: Column | str) -> Column:
    return F.concat(
        F.lit(f'  <link rel="{rel}" href="'), xml_attribute(href), F.lit('" type="'), xml_attribute(media_type), F.lit('"/>')
    )


def book_entry_xml(updated: Column | str) -> Column:
    """Entry fragment of a row of ``book_entries``."""
    subjects = F.array_join(
        F.transform("subjects", lambda s: F.concat(F.lit("  <dc:subject>"), xml_text(s), F.lit("</dc:subject>"))), "\n"
    )
    return F.concat_ws(
        "\n",
        F.lit("<entry>"),
        _element("id", "id"),
        _element("title", "title"),
        _element("updated", updated),
        F.concat(F.lit("  <author><name>"), xml_text("author"), F.lit("</name></author>")),
        _element("summary", "summary", ' type="text"'),
        _element("rights", "rights"),
        _element("dc:format", "format"),
        _element("dc:publisher", "publisher"),
        _element("dc:issued", "issued"),
        _element("dc:language", "language"),
        empty_to_null(subjects),
        _element("dc:extent", "extent"),
        _element("dc:isPartOf", "is_part_of"),
        _element("content", "content", ' type="text"'),
        _link(REL_IMAGE, "cover", F.lit("image/jpeg")),
        _link(REL_THUMBNAIL, "thumbnail", F.lit("image/jpeg")),
        _link(REL_OPEN_ACCESS, "acquisition", "media_type"),
        F.lit("</entry>"),
    )


def folder_entry_xml(updated: Column | str) -> Column:
    """Entry fragment of a row of ``folder_entries``."""
    return F.concat_ws(
        "\n",
        F.lit("<entry>"),
        _element("id", "id"),
        _element("title", "title"),
        _element("updated", updated),
        _element("summary", "summary", ' type="text"'),
        _link(REL_SUBSECTION, "href", F.lit(NAVIGATION_TYPE)),
        F.lit("</entry>"),
    )


def feeds_of(structure: DataFrame, kinds: DataFrame, updated: Column | str) -> DataFrame:
    """Feed header of every folder; a folder without entries is a navigation feed."""
    return structure.join(kinds, "folder", "left").select(
        "folder",
        feed_id("folder").alias("id"),
        folder_title("folder").alias("title"),
        col(updated).alias("updated"),
        F.coalesce("feed_kind", F.lit("navigation")).alias("kind"),
        feed_href("folder").alias("self_href"),
        F.lit(f"/{FEED_FILE}").alias("start_href"),
    )


def feed_type(kind: Column | str) -> Column:
    return F.when(col(kind) == "acquisition", ACQUISITION_TYPE).otherwise(NAVIGATION_TYPE)
