"""Comic archives: metadata of the two description files, choice of the cover, pages as sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import COVER_IMAGE_EXTENSIONS, PAGE_IMAGE_EXTENSIONS
from shelfspark.formats.common import first_non_empty, metadata
from shelfspark.functions.natural import TERTIARY, natural_key
from shelfspark.functions.text import (
    clean_description,
    empty_to_null,
    first_string,
    format_series,
    parse_date,
    split_genres,
    string_array,
    year_month,
)
from shelfspark.operators.feeds import XML_OPTIONS
from shelfspark.operators.ordered import number_rows, ordered
from shelfspark.sources.archives import archive_members, map_archives, source_column

INFO = (
    "Title string, Series string, Number string, Volume string, Summary string, Publisher string, Year string, "
    "Month string, Writer string, Penciller string, CoverArtist string, Genre string, LanguageISO string, "
    "PageCount string, Pages struct<Page:array<struct<_Image:string,_Type:string>>>"
)
COMET = (
    "title string, series string, issue string, volume string, description string, publisher string, date string, "
    "writer array<string>, creator array<string>, penciller array<string>, genre array<string>, language string, rights string"
)
IMAGE = rf"(?i)\.(?:{'|'.join(COVER_IMAGE_EXTENSIONS)})$"
PAGE = rf"\.(?:{'|'.join(PAGE_IMAGE_EXTENSIONS)})$"
# Names that tell a cover, in order of preference (fixed values).
COVER_NAMES = ["(?i)cover", "(?i)front", "(?iu)обложка", r"^0+[01]?\."]


def _read(row, archive):
    names = archive.names()
    if names:
        def text(wanted):
            found = [n for n in names if n.lower() == wanted]
            data = archive.read(found[0]) if found else None
            return data.decode("utf-8", "replace") if data else None

        yield row.path, names, text("comicinfo.xml"), text("comet.xml")


def _info(i: Column) -> Column:
    pages = i["PageCount"].try_cast("double").try_cast("int")
    return metadata(
        title=F.coalesce(empty_to_null(i["Title"]), i["Series"]),
        author=F.coalesce(empty_to_null(i["Writer"]), empty_to_null(i["Penciller"]), i["CoverArtist"]),
        description=clean_description(i["Summary"]),
        publisher=i["Publisher"],
        issued=year_month(i["Year"].try_cast("double"), i["Month"].try_cast("double")),
        language=i["LanguageISO"],
        subjects=split_genres(i["Genre"]),
        page_count=F.when(pages != 0, pages),
        series=format_series(i["Series"], i["Volume"], i["Number"]),
    )


def _comet(c: Column) -> Column:
    author = F.coalesce(*[empty_to_null(first_string(c[n])) for n in ("writer", "creator", "penciller")])
    return metadata(
        title=F.coalesce(empty_to_null(c["title"]), c["series"]),
        author=author,
        description=clean_description(c["description"]),
        publisher=c["publisher"],
        issued=parse_date(c["date"]),
        language=c["language"],
        subjects=string_array(c["genre"]),
        series=format_series(c["series"], c["volume"], c["issue"]),
        rights=c["rights"],
    )


def choose_cover(images: Column, pages: Column) -> Column:
    """Front cover of the page list, else a telling name, else the first image in code order."""
    ordered_images = F.array_sort(images)
    front = F.try_element_at(F.filter(pages, lambda p: p["_Type"] == "FrontCover"), F.lit(1))["_Image"]
    index = F.regexp_extract(front, r"^\s*([0-9]+)", 1).try_cast("int")
    listed = F.when(index.isNotNull(), F.get(ordered_images, index))
    named = [F.try_element_at(F.filter(images, lambda m: m.rlike(p)), F.lit(1)) for p in COVER_NAMES]
    return F.coalesce(listed, *named, F.try_element_at(ordered_images, F.lit(1)))


def comic_metadata(files: DataFrame) -> DataFrame:
    """Rows (path, meta, cover): the first description file wins per field, the second fills gaps."""
    raw = map_archives(
        files.select("path", source_column(files)), _read,
        "path string, members array<string>, info string, comet string",
    )
    rows = raw.select(
        "path", "members", F.from_xml("info", INFO, XML_OPTIONS).alias("i"), F.from_xml("comet", COMET, XML_OPTIONS).alias("c")
    )
    meta = first_non_empty(_info(F.col("i")), _comet(F.col("c")))
    images = F.filter("members", lambda m: m.rlike(IMAGE))
    return rows.select("path", meta.alias("meta"), choose_cover(images, F.col("i.Pages.Page")).alias("cover"))


def comic_sections(files: DataFrame) -> DataFrame:
    """Rows (path, section, label): one section, and one item of contents, per image in natural order."""
    pages = archive_members(files).filter(F.col("member").rlike(PAGE)).withColumn("__k", natural_key("member", TERTIARY))
    rows = number_rows(ordered(pages, ["path"], [F.col("__k"), F.col("member")]), "n").plain()
    return rows.select("path", (F.col("n") - 1).alias("section"), F.col("member").alias("label"))
