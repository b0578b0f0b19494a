"""Registration of queries and the inputs they share.

Web pages stand for book files: the address without query and fragment is the path. Documents stand
for files with a size, and conversations for books whose turns are the sections.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.paths import url_to_path
from shelfspark.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with the SQL that must agree with it."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql.strip()
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for costly work per row; the first one is its key."""
    return spread(table(spark, sf_dir, name).select(*columns), columns[0])


def page_files(spark: SparkSession, sf_dir: str, **values: Column) -> DataFrame:
    """One row per page path: path, page_id and further values. The lowest page id wins.

    Values are computed from a page before the pages of a path are brought together, so the page
    text itself is not shuffled.
    """
    pages = table(spark, sf_dir, "pages").select(url_to_path("url").alias("path"), "page_id", *[v.alias(n) for n, v in values.items()])
    return pages.groupBy("path").agg(F.min("page_id").alias("page_id"), *[F.min_by(n, "page_id").alias(n) for n in values])


# --- pieces of SQL -------------------------------------------------------------------------------

PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/+$', '')"
PAGES = f"(SELECT path, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM (SELECT page_id, html, {PATH} AS path FROM pages) GROUP BY path)"


def parent_sql(path: str) -> str:
    return f"regexp_replace({path}, '/?[^/]*$', '')"


def name_sql(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


FOLDERS = f"""(SELECT DISTINCT array_to_string(parts[1:i], '/') AS folder
  FROM (SELECT parts, unnest(range(0, len(parts) + 1)) AS i FROM (SELECT string_split({parent_sql('path')}, '/') AS parts FROM {PAGES}))
  UNION SELECT '')"""
# Order of punctuation before digits and letters in the root collation (fixed value).
PUNCTUATION = " _-,;:!¡?¿.'\"«»()[]{}@*/\\&#%`^+<=>|~$"


def natural_sql(expr: str) -> str:
    """Natural order of Latin text: accents and case dropped, digits by value, punctuation first."""
    source = PUNCTUATION.replace("'", "''")
    target = "".join(chr(1 + i) for i in range(len(PUNCTUATION))).replace("'", "''")
    base = f"translate(strip_accents(lower(replace({expr}, 'ß', 'ss'))), '{source}', '{target}')"
    digits = r"regexp_replace(t, '^0+(.)', '\1')"
    return (
        f"array_to_string(list_transform(regexp_extract_all({base}, '[0-9]+|[^0-9]+'), "
        f"lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN lpad(length({digits})::VARCHAR, 4, '0') || {digits} ELSE t END), '')"
    )


def title_sql(name: str) -> str:
    """Readable title of a name, step by step as a chain of replacements."""
    split = f"regexp_replace(regexp_replace({name}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
    count = lambda c: f"(length({name}) - length(replace({name}, '{c}', '')))"
    spaced = f"CASE WHEN {count('-')} > {count('_')} THEN regexp_replace({split}, '-+', ' ', 'g') ELSE regexp_replace({split}, '_+', ' ', 'g') END"
    clean = f"trim(regexp_replace({spaced}, '\\s+', ' ', 'g'))"
    return f"(upper(substr({clean}, 1, 1)) || substr({clean}, 2))"


def encode_sql(expr: str, keep_slash: bool = True) -> str:
    out = f"url_encode({expr})"
    for found, wanted in (("+", "%20"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        out = f"replace({out}, '{found}', '{wanted}')"
    return f"replace({out}, '%2F', '/')" if keep_slash else out


def xml_text_sql(expr: str) -> str:
    return f"replace(replace(replace({expr}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def xml_decode_sql(expr: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("amp", "&"), ("quot", '"'), ("apos", "''")):
        expr = f"replace({expr}, '&{name};', '{char}')"
    return expr


def size_sql(n: str) -> str:
    one = lambda x: f"printf('%.1f', round({x}, 1))"
    return f"CASE WHEN {n} < 1024 THEN {n}::VARCHAR || ' B' WHEN {n} < 1048576 THEN {one(f'{n} / 1024.0')} || ' KB' ELSE {one(f'{n} / 1048576.0')} || ' MB' END"


def summary_sql(folders: str, books: str) -> str:
    f, b = f"'🗂 ' || {folders}::VARCHAR", f"'📚 ' || {books}::VARCHAR"
    return f"CASE WHEN {folders} = 0 AND {books} = 0 THEN NULL WHEN {folders} = 0 THEN {b} WHEN {books} = 0 THEN {f} ELSE {f} || ' · ' || {b} END"


PAGE_TITLE = xml_decode_sql("trim(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1))")
STRUCTURE = f"""(SELECT f.folder, CASE WHEN f.folder = '' THEN 'Catalog' ELSE {name_sql('f.folder')} END AS name,
  coalesce(c.n, 0) AS folder_count, coalesce(b.n, 0) AS book_count
  FROM {FOLDERS} f
  LEFT JOIN (SELECT {parent_sql('folder')} AS folder, count(*) AS n FROM {FOLDERS} WHERE folder <> '' GROUP BY 1) c ON f.folder = c.folder
  LEFT JOIN (SELECT {parent_sql('path')} AS folder, count(*) AS n FROM {PAGES} GROUP BY 1) b ON f.folder = b.folder)"""
