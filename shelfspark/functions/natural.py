"""Natural order: digits compare as numbers, case and accents do not count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import col

BASE = "UNICODE_CI_AI"
TERTIARY = "UNICODE"


def natural_key(c: Column | str, collation: str = BASE) -> Column:
    """Sort key of natural order.

    Each run of digits loses its leading zeros and is preceded by its length on ten places, more than
    any text needs, so plain collated text comparison orders numbers by value. The result
    is one collated string: usable in sorts, ranges, windows and joins.
    """
    raw = col(c)

    def mark(token: Column) -> Column:
        digits = F.regexp_replace(token, "^0+(?=.)", "")
        return F.when(
            token.rlike(r"^\p{Nd}"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        ).otherwise(token)

    tokens = F.regexp_extract_all(raw, F.lit(r"(?s)(\p{Nd}+|\P{Nd}+)"), F.lit(1))
    marked = F.when(raw.rlike(r"\p{Nd}"), F.array_join(F.transform(tokens, mark), "")).otherwise(raw)
    return F.collate(marked, collation)
