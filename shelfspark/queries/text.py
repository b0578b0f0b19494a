"""Scalar text functions over the text and name columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import text as t
from shelfspark.functions.markup import extract_author, extract_title
from shelfspark.functions.paths import file_extension, is_hidden, loose_extension, url_to_path
from shelfspark.queries.base import (
    PAGE_TITLE,
    PATH,
    encode_sql,
    query,
    size_sql,
    table,
    texts,
    title_sql,
    xml_decode_sql,
)


@query(f"SELECT doc_id, {size_sql('n_chars')} AS size_label, {size_sql('(n_chars * 4096)')} AS large_label FROM documents")
def file_size_label(spark, sf_dir) -> DataFrame:
    label = lambda c: t.format_file_size(c)
    return table(spark, sf_dir, "documents").select(
        "doc_id", label(F.col("n_chars")).alias("size_label"), label(F.col("n_chars") * 4096).alias("large_label")
    )


# Names in the three shapes that matter: snake, kebab and camel case, from name, type and brand.
_NAMES = "CASE p_partkey % 3 WHEN 0 THEN replace(p_name, ' ', '_') || '-' || p_brand WHEN 1 THEN replace(p_name, ' ', '--') || '-x_y' ELSE p_type || 'Of' || replace(p_brand, '#', 'XMLPart') || '  e' END"


@query(f"SELECT p_partkey, name, {title_sql('name')} AS title FROM (SELECT p_partkey, {_NAMES} AS name FROM part)")
def title_from_name(spark, sf_dir) -> DataFrame:
    k, rep = F.col("p_partkey") % 3, lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    name = (
        F.when(k == 0, F.concat_ws("-", rep("p_name", " ", "_"), "p_brand"))
        .when(k == 1, F.concat(rep("p_name", " ", "--"), F.lit("-x_y")))
        .otherwise(F.concat("p_type", F.lit("Of"), rep("p_brand", "#", "XMLPart"), F.lit("  e")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name")).withColumn("title", t.normalize_title("name"))


@query(f"SELECT page_id, {encode_sql('url')} AS encoded, {encode_sql('x', False)} AS component FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)', 1) AS x FROM pages)")
def encode_path(spark, sf_dir) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", t.encode_url_path("url").alias("encoded"), t.encode_url_component(title).alias("component")
    )


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS decoded FROM pages")
def decode_component(spark, sf_dir) -> DataFrame:
    encoded = t.encode_url_component(F.regexp_extract("html", "<title>([^<]*)", 1))
    return table(spark, sf_dir, "pages").select("page_id", t.decode_url_component(encoded).alias("decoded"))


@query(f"SELECT page_id, {PAGE_TITLE} AS title FROM pages")
def page_title(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", extract_title("html").alias("title"))


_AUTHOR = "'<entry><author>' || chr(10) || ' <name> ' || source || ' &amp; ' || lang || '</name></author></entry>'"


@query("SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN source || ' & ' || lang END AS author FROM documents")
def entry_author(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("<entry><author>\n <name> "), "source", F.lit(" &amp; "), "lang", F.lit("</name></author></entry>"))
    xml = F.when(F.col("doc_id") % 4 > 0, name).otherwise("<entry><author><name></name></author></entry>")
    return table(spark, sf_dir, "documents").select("doc_id", extract_author(xml).alias("author"))


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '') AS description FROM pages")
def clean_text(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", t.clean_description("html").alias("description"))


@query("SELECT doc_id, trim(text, ' \t\n\r') AS body FROM documents")
def strip_declaration(spark, sf_dir) -> DataFrame:
    xml = F.concat(F.lit('<?xml version="1.0"?>\n'), "text", F.lit('<?xml-stylesheet href="x"?> '))
    return texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", t.strip_xml_declaration(xml).alias("body"))


@query(f"SELECT page_id, {xml_decode_sql('html')} AS decoded FROM pages")
def decode_xml(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", t.decode_xml_entities("html").alias("decoded"))


@query("SELECT page_id, replace(replace(replace(replace(html, '&quot;', chr(34)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') || '€ A А ' || chr(128512) || ' &none; <A>' AS decoded FROM pages")
def decode_entities(spark, sf_dir) -> DataFrame:
    text = F.concat("html", F.lit("&euro; &#65; &#1040; &#55357;&#56832; &none; &lt;&#x41;&gt;"))
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", t.decode_entities(text).alias("decoded"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS from_day, strftime(o_orderdate, '%Y') AS from_year, NULL::VARCHAR AS from_text,
  CASE WHEN year(o_orderdate) BETWEEN 1900 AND 2099 THEN strftime(o_orderdate, '%Y') END AS year_in_text FROM orders""")
def parse_date_ym(spark, sf_dir) -> DataFrame:
    day = lambda fmt: F.date_format("o_orderdate", fmt)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", t.parse_date(day("yyyy-MM-dd")).alias("from_day"), t.parse_date(day("yyyy/MM")).alias("from_year"),
        t.parse_date(F.concat(F.lit("on "), day("yyyy-MM"))).alias("from_text"),
        t.year_of_text(F.concat(F.lit("x1987 12345 "), day("d MMM yyyy HH:mm"))).alias("year_in_text"),
    )


@query("""SELECT p_partkey, p_type || '|' || p_brand || '|' || p_name AS keywords, p_type || '|' || p_brand || '; ' || p_name AS genres,
  p_type IS NULL AS none FROM part""")
def split_keyword_lists(spark, sf_dir) -> DataFrame:
    listed = F.concat("p_type", F.lit(" ,, "), "p_brand", F.lit("; "), "p_name", F.lit(" ;"))
    genres = F.concat("p_type", F.lit(" ,, "), "p_brand", F.lit("; "), "p_name", F.lit(" ,"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(t.split_keywords(listed), "|").alias("keywords"),
        F.array_join(t.split_genres(genres), "|").alias("genres"),
        t.split_keywords(F.lit(" ;, ")).isNotNull().alias("none"),
    )


@query("""SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey % 2 = 0 THEN p_type END, CASE WHEN p_size % 4 > 0 THEN 'Vol.' || (p_size % 4) END,
  CASE WHEN p_partkey % 3 > 0 THEN '#' || (p_partkey % 3) END) AS series,
  CASE WHEN p_size % 5 > 0 THEN (1990 + p_size % 5)::VARCHAR || CASE WHEN p_partkey % 13 > 0 THEN '-' || lpad((p_partkey % 13)::VARCHAR, 2, '0') ELSE '' END END AS issued
  FROM part WHERE p_partkey % 2 = 0 OR p_size % 4 > 0 OR p_partkey % 3 > 0
  UNION ALL SELECT p_partkey, NULL, CASE WHEN p_size % 5 > 0 THEN (1990 + p_size % 5)::VARCHAR || CASE WHEN p_partkey % 13 > 0 THEN '-' || lpad((p_partkey % 13)::VARCHAR, 2, '0') ELSE '' END END
  FROM part WHERE NOT (p_partkey % 2 = 0 OR p_size % 4 > 0 OR p_partkey % 3 > 0)""")
def series_and_month(spark, sf_dir) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    year = F.when(size % 5 > 0, size % 5 + 1990)
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.format_series(F.when(k % 2 == 0, F.col("p_type")), size % 4, k % 3).alias("series"),
        t.year_month(year, k % 13).alias("issued"),
    )


@query("SELECT p_partkey, p_name AS stripped, p_name || '.epub' AS kept FROM part")
def source_suffixes(spark, sf_dir) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, [".docx", ".INDD", ".tex", ".pub"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", t.strip_source_extension(F.concat("p_name", suffix)).alias("stripped"),
        t.strip_source_extension(F.concat("p_name", F.lit(".epub"))).alias("kept"),
    )


@query("""SELECT event_id, ((event_id % 5) * 3600 + (event_id % 60) * 60 + (event_id % 60))::DOUBLE AS hms, ((event_id % 60) * 60.0 + 5.5)::DOUBLE AS ms,
  (event_id % 7)::DOUBLE * 60 AS minutes, round((event_id % 7)::DOUBLE * 0.001, 6) AS millis FROM events""")
def clock_seconds(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", t.parse_clock(F.format_string("%d:%02d:%02d", e % 5, e % 60, e % 60)).alias("hms"),
        t.parse_clock(F.format_string("%d:05.5", e % 60)).alias("ms"),
        t.parse_clock(F.format_string("%dmin", e % 7)).alias("minutes"),
        F.round(t.parse_clock(F.format_string("%dms", e % 7)), 6).alias("millis"),
    )


@query("SELECT DISTINCT event_type, lower(event_type) || upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || 'Id' AS camel FROM events")
def camel_names(spark, sf_dir) -> DataFrame:
    name = F.concat(F.upper("event_type"), F.lit("-"), "event_type", F.lit(":id"))
    return table(spark, sf_dir, "events").select("event_type").distinct().select("event_type", t.camel_case(name).alias("camel"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '\"', '&quot;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escape_html(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", t.html_escape("html").alias("escaped"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || ' ' || c_name END AS person,
  CASE WHEN c_custkey % 3 = 0 THEN c_name || ', ' ELSE c_name || ', ' || c_mktsegment END AS sort_name,
  CASE WHEN c_custkey % 2 = 0 THEN 'nick' WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || ' ' || c_name END AS reader_name FROM customer""")
def person_names(spark, sf_dir) -> DataFrame:
    first = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    nick = F.when(F.col("c_custkey") % 2 == 0, "nick")
    args = (first, F.lit(""), F.col("c_name"), nick)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", t.person_name(*args).alias("person"), t.person_sort_name(*args[:3]).alias("sort_name"),
        t.person_name(*args, nickname_first=True).alias("reader_name"),
    )


@query("SELECT doc_id, lang AS single, CASE WHEN doc_id % 2 = 0 THEN lang END AS first_value, source || '|' || lang AS listed FROM documents")
def scalar_coercions(spark, sf_dir) -> DataFrame:
    padded = F.concat(F.lit(" \t"), "lang", F.lit("\n"))
    values = F.when(F.col("doc_id") % 2 == 0, F.array(padded, F.col("source")))
    listed = F.array(F.col("source"), F.lit(" "), F.lit(None), padded)
    return table(spark, sf_dir, "documents").select(
        "doc_id", t.get_string(padded).alias("single"), t.first_string(values).alias("first_value"),
        F.array_join(t.string_array(listed), "|").alias("listed"),
    )


@query(f"""SELECT page_id, CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$')) ELSE '' END AS extension,
  lower(regexp_extract(name, '[^.]*$')) AS loose, page_id % 3 = 0 OR regexp_matches(path, '(^|/)[.]') AS hidden
  FROM (SELECT page_id, {PATH} AS path, regexp_extract({PATH}, '[^/]*$') AS name FROM pages)""")
def extension_rules(spark, sf_dir) -> DataFrame:
    name = F.substring_index(url_to_path("url"), "/", -1)
    # Every third path gets a hidden folder.
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("a/.b/"), url_to_path("url"))).otherwise(url_to_path("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", file_extension(name).alias("extension"), loose_extension(name).alias("loose"), is_hidden(path).alias("hidden")
    )
