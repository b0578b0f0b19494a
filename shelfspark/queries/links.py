"""Links of web pages: safety, labels, validation, groups, reachability, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import MEDIA_TYPES
from shelfspark.functions import links as l
from shelfspark.functions.markup import links_of
from shelfspark.functions.paths import parent_path, path_name, url_to_path
from shelfspark.operators.folders import folders_of
from shelfspark.operators.links import broken_links as find_broken
from shelfspark.operators.links import choose_groups, group_by_keys, reachable
from shelfspark.queries.base import FOLDERS, PAGES, PATH, page_files, parent_sql, query, table

HREFS = r"""(SELECT page_id, host, lang, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (
  SELECT page_id, split_part(p, '/', 1) AS host, split_part(p, '/', 2) AS lang, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS h
  FROM (SELECT page_id, html, """ + PATH + " AS p FROM pages)))"


def page_links(spark, sf_dir) -> DataFrame:
    """Rows (page_id, host, lang, pos, href) of all anchors."""
    pages = table(spark, sf_dir, "pages").withColumn("__p", F.split(url_to_path("url"), "/"))
    rows = pages.select(
        "page_id", F.element_at("__p", 1).alias("host"), F.try_element_at("__p", F.lit(2)).alias("lang"),
        F.posexplode(links_of("html")).alias("pos", "href"),
    )
    return rows.withColumn("pos", F.col("pos") + 1)


# Schemes put in front of page links to make hostile variants of them (fixed values).
_SCHEMES = ["", "https://x", "javascript:", "java\tscript:", "mailto:", "#"]
_SCHEME_SQL = "(['', 'https://x', 'javascript:', 'java' || chr(9) || 'script:', 'mailto:', '#'])[pos % 6 + 1]"


@query(f"""SELECT page_id, pos::INTEGER AS pos, CASE WHEN pos % 6 IN (2, 3, 4) THEN '#' ELSE {_SCHEME_SQL} || href END AS safe FROM {HREFS}""")
def safe_links(spark, sf_dir) -> DataFrame:
    scheme = F.element_at(F.array(*map(F.lit, _SCHEMES)), (F.col("pos") % 6 + 1).cast("int"))
    return page_links(spark, sf_dir).select("page_id", "pos", l.safe_link(F.concat(F.lit(" "), scheme, "href")).alias("safe"))


_TYPES = list(MEDIA_TYPES.values())
_LABELS = ["EPUB", "PDF", "MOBI", "MOBI", "MOBI", "FB2", "FB2", "Comic", "Comic", "Comic", "Comic", "Download", "DJVU", "TXT"]


@query(f"""SELECT doc_id, ({_LABELS})[doc_id % {len(_LABELS)} + 1] AS label,
  ({_LABELS})[doc_id % {len(_LABELS)} + 1] IN ('EPUB', 'PDF') AND doc_id % 2 = 0 AS viewable FROM documents""")
def link_labels(spark, sf_dir) -> DataFrame:
    media_type = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("doc_id") % len(_TYPES) + 1).cast("int"))
    label = l.format_from_mime(F.upper(media_type))
    href = F.when(F.col("doc_id") % 2 == 0, "/a/b").otherwise("#")
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), l.is_viewable(label, href).alias("viewable"))


_FRAGMENTS = """CASE doc_id % 8 WHEN 0 THEN '/' || lang || '/b' || doc_id || '.epub/b' || doc_id || '.epub' WHEN 1 THEN '#/' || lang || '/b%20' || doc_id || '.PDF'
  WHEN 2 THEN '/' || lang || '/x.epub/file' WHEN 3 THEN '//' || lang || '/a.epub' WHEN 4 THEN '/' || lang || '/%2e%2e/a.epub'
  WHEN 5 THEN '/' || lang || '/b' || doc_id || '.fb2' WHEN 6 THEN '/' || lang || '/%zz.epub' ELSE '/a' || doc_id || '.epub' END"""


@query("""SELECT doc_id, CASE WHEN k < 3 THEN 'ok' WHEN k = 5 THEN 'unsupported' ELSE 'invalid' END AS kind,
  CASE k WHEN 0 THEN '/' || lang || '/b' || doc_id || '.epub/b' || doc_id || '.epub' WHEN 1 THEN '/' || lang || '/b%20' || doc_id || '.PDF' WHEN 2 THEN '/' || lang || '/x.epub/file' END AS path,
  CASE WHEN k IN (0, 1, 2, 5) THEN '/' || lang || '/' END AS folder,
  CASE k WHEN 0 THEN 'b' || doc_id || '.epub' WHEN 1 THEN 'b ' || doc_id || '.PDF' WHEN 2 THEN 'x.epub' END AS filename,
  CASE k WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' WHEN 2 THEN 'epub' WHEN 5 THEN 'fb2' END AS ext FROM (SELECT *, doc_id % 8 AS k FROM documents)""")
def book_link_check(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_FRAGMENTS).alias("fragment"))
    return docs.select("doc_id", l.book_link("fragment").alias("r")).select("doc_id", "r.*")


@query(f"""WITH known AS (SELECT path AS node FROM {PAGES} UNION SELECT folder FROM {FOLDERS})
  SELECT page_id, pos::INTEGER AS pos, target FROM (SELECT page_id, pos, host || '/' || lang || CASE WHEN pos % 3 = 0 THEN '' ELSE href END AS target FROM {HREFS})
  WHERE target NOT IN (SELECT node FROM known)""")
def broken_links(spark, sf_dir) -> DataFrame:
    files = page_files(spark, sf_dir)
    folders = folders_of(files)
    edges = folders.filter("folder <> ''").select(parent_path("folder").alias("src"), F.col("folder").alias("dst"))
    root = spark.range(1).select(F.lit("").alias("node"))
    live = reachable(edges, root)
    targets = files.select(F.col("path").alias("node")).union(folders.select("folder"))
    target = F.concat_ws("/", "host", "lang", F.when(F.col("pos") % 3 > 0, F.regexp_replace("href", "^/", "")))
    links = page_links(spark, sf_dir).select(F.concat_ws("/", "host", "lang").alias("src"), "page_id", "pos", target.alias("href"))
    return find_broken(links, targets, live).select("page_id", "pos", F.col("href").alias("target"))


# From the root: every folder links to its subfolders and back to the root.
@query(f"""WITH RECURSIVE edges AS (SELECT DISTINCT {parent_sql('folder')} AS src, folder AS dst FROM {FOLDERS} WHERE folder <> ''
    UNION SELECT folder, '' FROM {FOLDERS}),
  seen AS (SELECT '' AS node UNION SELECT dst FROM edges JOIN seen ON src = node) SELECT node FROM seen""")
def reachable_feeds(spark, sf_dir) -> DataFrame:
    folders = folders_of(page_files(spark, sf_dir))
    down = folders.filter("folder <> ''").select(parent_path("folder").alias("src"), F.col("folder").alias("dst"))
    back = folders.select(F.col("folder").alias("src"), F.lit("").alias("dst"))
    return reachable(down.union(back), spark.range(1).select(F.lit("").alias("node")))


@query(f"""SELECT key, count(*)::BIGINT AS links, min(page_id) AS first_page FROM (SELECT page_id, unnest([host, lang]) AS key FROM {HREFS}) GROUP BY key""")
def link_groups(spark, sf_dir) -> DataFrame:
    rows = group_by_keys(page_links(spark, sf_dir).withColumn("keys", F.array("host", "lang")), "keys")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("links"), F.min("page_id").alias("first_page"))


# Each page is an entry of the feed of its language; all its links are group links.
@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) AS n FROM (
    SELECT lang AS feed, page_id AS pos, list(href ORDER BY pos) AS links FROM {HREFS} GROUP BY lang, page_id)),
  walk AS (SELECT feed, pos, n, links[1] AS chosen, [links[1]] AS opened FROM e WHERE n = 1
    UNION ALL SELECT feed, pos, n, c, CASE WHEN list_contains(opened, c) THEN opened ELSE list_append(opened, c) END FROM (
      SELECT e.feed, e.pos, e.n, w.opened, coalesce(list_filter(e.links, lambda x: list_contains(w.opened, x))[1], e.links[1]) AS c
      FROM walk w JOIN e ON e.feed = w.feed AND e.n = w.n + 1))
  SELECT feed, pos, chosen AS "group" FROM walk""")
def group_choice(spark, sf_dir) -> DataFrame:
    pages = page_links(spark, sf_dir).groupBy("lang", "page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "href"))).alias("l"))
    return choose_groups(pages.select(F.col("lang").alias("feed"), F.col("page_id").alias("pos"), F.col("l.href").alias("links")))


@query("""SELECT doc_id, 'application/atom+xml' AS type, CASE WHEN doc_id % 2 = 0 THEN 'opds-catalog' ELSE 'x' END AS profile, lang AS kind, doc_id % 2 = 0 AS is_catalog FROM documents""")
def media_type_parameters(spark, sf_dir) -> DataFrame:
    profile = F.when(F.col("doc_id") % 2 == 0, "opds-catalog").otherwise("x")
    value = F.concat(F.lit('Application/Atom+XML ; Profile="'), profile, F.lit('";kind='), "lang")
    parsed = l.parse_media_type(value)
    rows = table(spark, sf_dir, "documents").select("doc_id", parsed.alias("m"), l.is_catalog_type(value).alias("is_catalog"))
    return rows.select("doc_id", "m.type", F.col("m.parameters")["profile"].alias("profile"), F.col("m.parameters")["kind"].alias("kind"), "is_catalog")


@query(f"""SELECT page_id, path AS plain, {parent_sql('path')} || '/x y.html#a' AS sibling, {parent_sql('path')} || '/' AS dirname,
  {parent_sql(parent_sql('path'))} || '/' AS up, false AS external FROM (SELECT page_id, {PATH} AS path FROM pages)""")
def resolve_links(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", url_to_path("url").alias("path"))
    return pages.select(
        "page_id", l.resolve_url(F.concat(F.lit("./"), path_name("path"), F.lit("?q=1")), "path").alias("plain"),
        l.resolve_url(F.lit("../x/../"), "path").alias("up"), l.resolve_url(F.lit("x%20y.html?a=b#a"), "path").alias("sibling"),
        l.dirname("path").alias("dirname"), l.is_external("path").alias("external"),
    )


@query(f"""SELECT page_id, CASE WHEN path LIKE host || '/en/%' THEN split_part(path, '/', 3) ELSE '../' || split_part(path, '/', 2) || '/' || split_part(path, '/', 3) END AS relative
  FROM (SELECT page_id, {PATH} AS path, split_part({PATH}, '/', 1) AS host FROM pages)""")
def relative_links(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", url_to_path("url").alias("path"))
    base = F.concat(F.substring_index("path", "/", 1), F.lit("/en"))
    return pages.select("page_id", l.relative_path(base, "path").alias("relative"))


@query("""SELECT doc_id, CASE k WHEN 0 THEN 'URN:x:' || doc_id WHEN 1 THEN 'urn:doi:10/' || doc_id WHEN 2 THEN 'urn:isbn:' || doc_id
  WHEN 3 THEN 'urn:ISBN:' || doc_id ELSE doc_id::VARCHAR END AS urn FROM (SELECT doc_id, doc_id % 5 AS k FROM documents)""")
def identifier_urns(spark, sf_dir) -> DataFrame:
    k, n = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    value = F.when(k == 0, F.concat(F.lit("URN:x:"), n)).when(k == 1, F.concat(F.lit("doi:10/"), n)).otherwise(n)
    scheme = F.when(k == 3, "ISBN").when(k == 4, "other")
    return table(spark, sf_dir, "documents").select("doc_id", l.identifier_to_urn(value, scheme, F.when(k == 2, "15")).alias("urn"))


@query(f"SELECT folder, CASE WHEN folder = '' THEN '/' ELSE '/' || folder || '/' END AS page FROM {FOLDERS}")
def browser_addresses(spark, sf_dir) -> DataFrame:
    folders = folders_of(page_files(spark, sf_dir))
    feed = F.when(F.col("folder") == "", "/feed.xml").otherwise(F.concat(F.lit("/"), "folder", F.lit("/feed.xml")))
    return folders.select("folder", l.browser_href(feed).alias("page"))
