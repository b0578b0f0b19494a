"""Text reports of the PDF and DjVu tools: key and value lines to metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.formats.common import metadata
from shelfspark.functions.text import (
    col,
    split_keywords,
    strip_source_extension,
    strip_space,
    year_of_text,
)


def _last_value(pairs: Column, key: str) -> Column:
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == key), F.lit(-1))["v"]


def _pairs(report: Column | str, separator: str, value, indented: bool = True) -> Column:
    """array<struct<k, v>> of the lines that have the separator and a value, indented ones on demand."""
    lines = F.filter(F.split(col(report), "\n"), lambda l: l.contains(separator))
    if not indented:
        lines = F.filter(lines, lambda l: ~l.rlike(r"^\s"))
    pairs = F.transform(
        lines,
        lambda l: F.struct(
            strip_space(F.substring_index(l, separator, 1)).alias("k"),
            value(F.substring(l, F.instr(l, separator) + 1, F.length(l))).alias("v"),
        ),
    )
    return F.filter(pairs, lambda p: p["v"] != "")


def _pages(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?[0-9]+)", 1).try_cast("int")


def pdf_metadata(reports: DataFrame, report: str = "report") -> DataFrame:
    """Rows (path, meta) of PDF reports: ``Key: value`` lines, indented ones belong to sub-blocks."""
    rows = reports.select("path", _pairs(report, ":", strip_space, indented=False).alias("p"))
    v = lambda key: _last_value(F.col("p"), key)
    pages = _pages(v("Pages"))
    meta = metadata(
        title=strip_source_extension(v("Title")), author=v("Author"), description=v("Subject"),
        issued=year_of_text(v("CreationDate")), subjects=split_keywords(v("Keywords")),
        page_count=F.when(pages != 0, pages),
    )
    return rows.select("path", meta.alias("meta"))


def djvu_metadata(reports: DataFrame, report: str = "report", pages: str = "pages") -> DataFrame:
    """Rows (path, meta) of DjVu reports (key, tab, quoted value) and page counts."""
    unquote = lambda v: strip_space(F.regexp_replace(v, '^"(.*)"$', "$1"))
    rows = reports.select("path", pages, _pairs(report, "\t", unquote).alias("p"))
    v = lambda key: _last_value(F.col("p"), key)
    count = _pages(F.col(pages))
    meta = metadata(
        title=v("Title"), author=v("Author"),
        issued=year_of_text(v("CreationDate")), subjects=split_keywords(v("Keywords")),
        page_count=F.when(count != 0, count),
    )
    return rows.select("path", meta.alias("meta"))
