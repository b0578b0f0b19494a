"""Sort key of reading locations such as ``epubcfi(/6/4!/4/2:3)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import col


def _steps(path: Column) -> Column:
    """array<struct<steps, offset>>, one per part: all steps are compared before the last offset."""

    def part(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit("/([0-9]+)"), F.lit(1))
        offset = F.regexp_extract(text, "/[0-9]+:([0-9]+)$", 1).try_cast("long")
        # Numbers beyond a long are all the largest one.
        step = lambda s: F.coalesce(s.try_cast("long"), F.lit(2**63 - 1))
        return F.struct(F.transform(found, step).alias("steps"), offset.alias("offset"))

    return F.transform(F.split(path, "!"), part)


def cfi_sort_key(cfi: Column | str) -> Column:
    """struct<start, end>: ranges by start then end, shorter prefix first, no offset before any offset."""
    inner = F.regexp_replace(col(cfi), r"^epubcfi\((.*)\)$", "$1")
    # Assertions in brackets (with ^ as escape), times and positions do not take part in the order.
    bare = F.regexp_replace(inner, r"\[(?:\^.|[^\]^])*\]|~[0-9.]*|@[0-9.]*(?::[0-9.]*)?", "")
    parts = F.split(bare, ",")
    parent = F.element_at(parts, 1)
    tail = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.struct(
        _steps(F.concat(parent, tail(2))).alias("start"), _steps(F.concat(parent, tail(3))).alias("end")
    )
