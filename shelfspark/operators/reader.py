"""Reading position: section sizes and fractions, progress, tables of contents, dictionaries.

sections: book, section, size, linear. toc: book, section, label and, where needed, an order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.operators.ordered import as_of, carry_forward, number_rows, ordered, running_sum

EPSILON = 2.0**-52


def counted_size() -> Column:
    """Size that counts: none for sections outside the linear order."""
    return F.when(~F.col("linear").eqNullSafe("no") & (F.col("size") > 0), F.col("size")).otherwise(F.lit(0)).cast("long")


def book_totals(sections: DataFrame) -> DataFrame:
    return sections.groupBy("book").agg(F.sum(counted_size()).alias("total_size"), F.count(F.lit(1)).alias("sections"))


def sized_sections(sections: DataFrame) -> DataFrame:
    """Sections with counted size, size before and after, and the totals of their book."""
    rows = ordered(sections.withColumn("counted", counted_size()), ["book"], [F.col("section")])
    placed = running_sum(rows, F.col("counted"), "size_after").plain()
    placed = placed.withColumn("size_before", F.col("size_after") - F.col("counted"))
    return placed.join(book_totals(sections), "book")


def section_fractions(sections: DataFrame) -> DataFrame:
    """Share of the book before and after each section."""
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.col("total_size").cast("double"))
    return sized_sections(sections).select(
        "book", "section", share("size_before").alias("fraction_start"), share("size_after").alias("fraction_end")
    )


def section_progress(
    sections: DataFrame, requests: DataFrame, size_per_location: float, size_per_time: float,
) -> DataFrame:
    """Progress at a place in a section. requests: book, section, fraction, page_fraction."""
    at = sized_sections(sections).join(requests, ["book", "section"])
    size = F.col("size_before") + F.col("fraction") * F.col("counted")
    after = size + F.col("page_fraction") * F.col("counted")
    return at.select(
        "book", "section", "fraction",
        F.try_divide(after, F.col("total_size")).alias("total_fraction"),
        F.floor(size / size_per_location).alias("location"),
        F.floor(after / size_per_location).alias("next_location"),
        F.ceil(F.col("total_size") / size_per_location).alias("locations"),
        ((1 - F.col("fraction")) * F.col("counted") / size_per_time).alias("time_in_section"),
        ((F.col("total_size") - size) / size_per_time).alias("time_total"),
    )


def section_at(sections: DataFrame, places: DataFrame) -> DataFrame:
    """Section, and share of it, at a share of the book. places: book, at (one row per pair).

    The inverse of progress: the last section with a size that starts at or before the place.
    """
    sized = sized_sections(sections)
    start = F.col("size_before") / F.col("total_size")
    starts = sized.filter("counted > 0").select(
        "book", "section", start.alias("start"),
        F.struct("section", start.alias("start"), (F.col("counted") / F.col("total_size")).alias("width")).alias("hit"),
    )
    known = book_totals(sections).select("book", (F.col("sections") - 1).alias("last_section"))
    asked = places.join(known, "book").withColumn("__shifted", F.col("at") + F.lit(EPSILON))
    found = as_of(asked, starts, ["book"], "__shifted", "start", "hit", ["section"])
    inside = (F.col("__shifted") - F.col("hit.start")) / F.col("hit.width")
    section = F.when(F.col("at") <= 0, 0).when(F.col("at") >= 1, F.col("last_section")).otherwise(F.coalesce("hit.section", F.lit(0)))
    part = F.when(F.col("at") <= 0, 0.0).when(F.col("at") >= 1, 1.0).otherwise(F.coalesce(inside, F.lit(0.0)))
    return found.select("book", "at", section.cast("long").alias("section"), part.alias("fraction"))


def number_toc(toc: DataFrame, path: str = "toc_path") -> DataFrame:
    """Depth-first number of each item from 0. ``path`` holds the positions from the top item down."""
    numbered = number_rows(ordered(toc, ["book"], [F.col(path)]), "__no").plain()
    return numbered.withColumn("toc_id", F.col("__no") - 1).drop("__no")


def toc_at_section(sections: DataFrame, toc: DataFrame) -> DataFrame:
    """First table-of-contents label of each section, else that of the last section that has one.

    toc: book, section, toc_id, label. Before the first item the label is null.
    """
    first = toc.groupBy("book", "section").agg(F.min_by("label", "toc_id").alias("__label"))
    rows = sections.select("book", "section").join(first, ["book", "section"], "left")
    filled = carry_forward(ordered(rows, ["book"], [F.col("section")]), F.col("__label"), "label")
    return filled.plain().drop("__label")


def toc_at_position(places: DataFrame, toc: DataFrame) -> DataFrame:
    """Label of the last item whose anchor is not after a position in the book.

    places: book, position. toc: book, position, toc_id, label.
    """
    items = toc.select("book", F.col("position").alias("anchor"), "toc_id", "label")
    return as_of(places, items, ["book"], "position", "anchor", "label", ["toc_id"])


def lookup_words(queries: DataFrame, words: DataFrame) -> DataFrame:
    """Dictionary lookup: all words equal to the query, case apart.

    queries: query; words: word_idx, word. Queries are made distinct before the join.
    """
    asked = queries.select("query").distinct().withColumn("__key", F.lower("query"))
    return asked.join(words.withColumn("__key", F.lower("word")), "__key").drop("__key")


def lookup_synonyms(queries: DataFrame, synonyms: DataFrame, words: DataFrame) -> DataFrame:
    """Words a query is a synonym of. synonyms: synonym, word_idx."""
    asked = queries.select("query").distinct().withColumn("__key", F.lower("query"))
    hits = asked.join(synonyms.withColumn("__key", F.lower("synonym")), "__key").select("query", "synonym", "word_idx")
    return hits.join(words, "word_idx")


def vector_rmse(pairs: DataFrame, a: str, b: str, scale: float = 1.0, threshold: float = 0.15) -> DataFrame:
    """Root mean square error of two vectors; unequal lengths give 1 and are never similar."""
    squares = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) / scale),
        F.lit(0.0), lambda acc, d: acc + d * d,
    )
    rmse = F.when(F.size(a) == F.size(b), F.sqrt(squares / F.size(a))).otherwise(1.0)
    same = F.size(a) == F.size(b)
    return pairs.withColumn("rmse", rmse).withColumn("similar", same & (F.col("rmse") < threshold))
