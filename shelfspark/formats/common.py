"""What all formats share: the metadata struct and its merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import empty_to_null

FIELDS = {
    "title": "string", "author": "string", "description": "string", "publisher": "string", "issued": "string",
    "language": "string", "subjects": "array<string>", "page_count": "int", "series": "string", "rights": "string",
}


def metadata(**values: Column) -> Column:
    """Metadata struct; fields that are not given are null, an unknown title is ''."""
    fields = []
    for name, kind in FIELDS.items():
        value = values.get(name, F.lit(None)).cast(kind)
        fields.append((F.coalesce(value, F.lit("")) if name == "title" else value).alias(name))
    return F.struct(*fields)


def first_non_empty(first: Column, second: Column) -> Column:
    """Field by field: the first source unless it is missing or empty."""
    def value(meta: Column, name: str) -> Column:
        c = meta[name]
        if FIELDS[name] == "string":
            return empty_to_null(c)
        return F.when(F.size(c) > 0, c) if name == "subjects" else F.nullif(c, F.lit(0))

    return metadata(**{n: F.coalesce(value(first, n), value(second, n)) for n in FIELDS})


def merge_metadata(first: DataFrame, second: DataFrame, key: str = "path") -> DataFrame:
    """Two tables (key, meta) of the same books, merged; a book may be in one table only."""
    a, b = first.withColumnRenamed("meta", "__a"), second.withColumnRenamed("meta", "__b")
    return a.join(b, key, "full").select(key, first_non_empty(F.col("__a"), F.col("__b")).alias("meta"))
