"""Folders, feeds, entries and the refresh plan."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.formats.common import merge_metadata, metadata
from shelfspark.functions.markup import extract_title, links_of
from shelfspark.functions.natural import natural_key
from shelfspark.functions.paths import ancestor_paths, parent_path, path_depth, path_name, strip_extension
from shelfspark.functions.text import empty_to_null, normalize_title
from shelfspark.operators.events import delete_subtrees
from shelfspark.operators.feeds import (
    feed_kinds,
    order_entries,
    parse_entries,
    pick_feeds,
    profile_feeds,
)
from shelfspark.operators.folders import folder_edges, folder_structure, folders_of
from shelfspark.operators.ordered import number_rows, ordered
from shelfspark.plans import sync
from shelfspark.plans.entries import (
    book_entries,
    book_entry_xml,
    feed_href,
    feeds_of,
    folder_entries,
    folder_entry_xml,
    with_media_type,
)
from shelfspark.queries.base import (
    FOLDERS,
    PAGE_TITLE,
    PAGES,
    STRUCTURE,
    encode_sql,
    name_sql,
    natural_sql,
    page_files,
    parent_sql,
    query,
    size_sql,
    summary_sql,
    table,
    title_sql,
    xml_text_sql,
)
from shelfspark.session import checkpointed, shared_dir
from shelfspark.sinks import documents
from shelfspark.sinks.documents import feed_document_parts, folder_page_parts, part_fragments, part_headers
from shelfspark.sinks.tables import seed_root
from shelfspark.sources.files import scan_files
from shelfspark.streaming.catalog import CatalogStream, default_entries

UPDATED = "2026-01-01T00:00:00.000Z"


@query(f"SELECT folder, name, folder_count::BIGINT AS folder_count, book_count::BIGINT AS book_count FROM {STRUCTURE}")
def folder_structure_of_pages(spark, sf_dir) -> DataFrame:
    return folder_structure(page_files(spark, sf_dir))


@query(f"SELECT {parent_sql('folder')} AS folder, folder AS subfolder FROM {FOLDERS} WHERE folder <> ''")
def subfolder_list(spark, sf_dir) -> DataFrame:
    return folder_edges(folders_of(page_files(spark, sf_dir)))


@query(f"""SELECT folder, CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END::INTEGER AS depth,
  count(*)::BIGINT AS files_below FROM (SELECT array_to_string(parts[1:i], '/') AS folder
  FROM (SELECT string_split({parent_sql('path')}, '/') AS parts FROM {PAGES}) t, range(0, 20) r(i) WHERE i <= len(parts)) GROUP BY 1, 2""")
def files_below_folders(spark, sf_dir) -> DataFrame:
    direct = page_files(spark, sf_dir).groupBy(parent_path("path").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    above = direct.select(F.explode(ancestor_paths("folder")).alias("folder"), "n")
    return above.groupBy("folder").agg(path_depth("folder").alias("depth"), F.sum("n").alias("files_below"))


def page_entries(spark, sf_dir) -> DataFrame:
    """Folder and book entries of the pages: folder, name, kind, title, author, summary."""
    files = page_files(spark, sf_dir, title=extract_title("html"))
    name = path_name("path")
    books = files.select(
        parent_path("path").alias("folder"), name.alias("name"), F.lit("book").alias("kind"),
        F.coalesce(empty_to_null("title"), normalize_title(strip_extension(name))).alias("title"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("summary"),
    )
    folders = folder_entries(folder_structure(files)).select(
        "folder", "name", "kind", "title", F.lit(None).cast("string").alias("author"), "summary"
    )
    return folders.unionByName(books)


ENTRIES = f"""(SELECT {parent_sql('folder')} AS folder, {name_sql('folder')} AS name, 'folder' AS kind,
    {title_sql(name_sql('folder'))} AS title, {summary_sql('folder_count', 'book_count')} AS summary FROM {STRUCTURE} WHERE folder <> ''
  UNION ALL SELECT {parent_sql('path')}, {name_sql('path')}, 'book',
    coalesce(nullif({PAGE_TITLE}, ''), {title_sql(f"regexp_replace({name_sql('path')}, '[.][^.]+$', '')")}), NULL FROM {PAGES})"""


@query(f"""SELECT folder, row_number() OVER w AS pos, kind, title, summary,
  CASE WHEN kind = 'book' THEN count(*) FILTER (kind = 'book') OVER (w ROWS UNBOUNDED PRECEDING) END AS book_no
  FROM {ENTRIES} WHERE name NOT LIKE '\\_%' ESCAPE '\\'
  WINDOW w AS (PARTITION BY folder ORDER BY kind = 'book', {natural_sql('title')}, {natural_sql('name')}, name)""")
def catalog_feed(spark, sf_dir) -> DataFrame:
    return order_entries(page_entries(spark, sf_dir)).select("folder", "pos", "kind", "title", "summary", "book_no")


@query(f"""SELECT s.folder, CASE WHEN s.folder = '' THEN 'urn:opds:catalog:root' ELSE 'urn:opds:catalog:' || s.folder END AS id,
  CASE WHEN s.folder = '' THEN 'Catalog' ELSE {title_sql('s.name')} END AS title,
  CASE WHEN book_count > 0 THEN 'acquisition' ELSE 'navigation' END AS kind,
  CASE WHEN s.folder = '' THEN '/feed.xml' ELSE '/' || {encode_sql('s.folder')} || '/feed.xml' END AS self_href FROM {STRUCTURE} s""")
def feed_header_rows(spark, sf_dir) -> DataFrame:
    structure = folder_structure(page_files(spark, sf_dir))
    kinds = feed_kinds(page_entries(spark, sf_dir).select("folder", "kind"))
    return seed_root(feeds_of(structure, kinds, F.lit(UPDATED))).select("folder", "id", "title", "kind", "self_href")


@query(f"""SELECT {parent_sql('folder')} AS folder, 'urn:opds:catalog:' || folder AS id, {title_sql('name')} AS title,
  {summary_sql('folder_count', 'book_count')} AS summary, '/' || {encode_sql('folder')} || '/feed.xml' AS href
  FROM {STRUCTURE} WHERE folder <> ''""")
def folder_entry_rows(spark, sf_dir) -> DataFrame:
    structure = folder_structure(page_files(spark, sf_dir))
    return folder_entries(structure).select("folder", "id", "title", "summary", "href")


# --- documents as files --------------------------------------------------------------------------

# Extension of the file a document stands for, by the rest of its id (fixed values).
EXTENSIONS = ["epub", "pdf", "fb2", "mobi", "cbz", "djvu", "txt", "md"]


def document_files(spark, sf_dir) -> DataFrame:
    """Documents as files: lang/source/name.ext with a size, a time and metadata."""
    docs = table(spark, sf_dir, "documents")
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))
    name = F.concat(F.lit("my_book-"), F.col("doc_id").cast("string"), F.lit("."), extension)
    return docs.select(
        "doc_id", F.concat_ws("/", "lang", "source", name).alias("path"), extension.alias("extension"),
        F.col("n_chars").alias("size"), (F.col("doc_id") % 1000 + 0.5).alias("mtime_ms"), "lang", "source", "text",
    )


DOC_EXT = f"(['{chr(39).join(e + (chr(39) + ',' if i < len(EXTENSIONS) - 1 else '') for i, e in enumerate(EXTENSIONS))}'])[doc_id % {len(EXTENSIONS)} + 1]"
DOC_PATH = f"lang || '/' || source || '/my_book-' || doc_id || '.' || {DOC_EXT}"
MEDIA = """CASE ext WHEN 'epub' THEN 'application/epub+zip' WHEN 'pdf' THEN 'application/pdf' WHEN 'fb2' THEN 'application/x-fictionbook+xml'
  WHEN 'mobi' THEN 'application/x-mobipocket-ebook' WHEN 'cbz' THEN 'application/vnd.comicbook+zip' WHEN 'djvu' THEN 'image/vnd.djvu'
  WHEN 'txt' THEN 'text/plain' ELSE 'application/octet-stream' END"""


@query(f"SELECT doc_id, ext AS extension, {MEDIA} AS media_type FROM (SELECT doc_id, {DOC_EXT} AS ext FROM documents)")
def media_type_lookup(spark, sf_dir) -> DataFrame:
    return with_media_type(document_files(spark, sf_dir)).select("doc_id", "extension", "media_type")


@query(f"""SELECT path, 'urn:opds:book:' || path AS id, CASE WHEN doc_id % 3 = 0 THEN 'Title ' || doc_id ELSE 'My book-' || doc_id END AS title,
  CASE WHEN lang <> 'en' THEN source END AS author, upper(ext) AS format, {size_sql('n_chars')} AS content, lang AS language,
  CASE WHEN doc_id % 5 > 0 THEN (doc_id % 5)::VARCHAR || ' pages' END AS extent,
  '/' || path || '/' || {name_sql('path')} AS acquisition, {MEDIA} AS media_type
  FROM (SELECT *, {DOC_PATH} AS path, {DOC_EXT} AS ext FROM documents)""")
def book_entry_rows(spark, sf_dir) -> DataFrame:
    files = document_files(spark, sf_dir)
    meta = metadata(
        title=F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Title "), F.col("doc_id").cast("string"))),
        author=F.when(F.col("lang") != "en", F.col("source")), language=F.col("lang"), page_count=(F.col("doc_id") % 5),
    )
    rows = book_entries(files.select("path", "size", meta.alias("meta"), F.lit(False).alias("has_cover")))
    return rows.select("path", "id", "title", "author", "format", "content", "language", "extent", "acquisition", "media_type")


@query(f"""SELECT folder, row_number() OVER (PARTITION BY folder ORDER BY author IS NOT NULL, {natural_sql('author')}, {natural_sql('title')}, {natural_sql('name')}) AS book_no,
  author, title FROM (SELECT CASE WHEN lang <> 'en' THEN source END AS author, lang AS folder,
  'Part ' || (n_chars % 50)::VARCHAR AS title, 'book' || doc_id AS name FROM documents)""")
def books_by_author(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("folder"), F.concat(F.lit("book"), F.col("doc_id").cast("string")).alias("name"), F.lit("book").alias("kind"),
        F.concat(F.lit("Part "), (F.col("n_chars") % 50).cast("string")).alias("title"),
        F.when(F.col("lang") != "en", F.col("source")).alias("author"), F.col("doc_id"),
    )
    return order_entries(docs).select("folder", "book_no", "author", "title")


@query(f"""SELECT label, row_number() OVER (ORDER BY {natural_sql('label')}, label) AS pos FROM (
  SELECT c_mktsegment || ' ' || c_custkey AS label FROM customer UNION ALL SELECT DISTINCT p_brand FROM part)""")
def natural_order(spark, sf_dir) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.concat_ws(" ", "c_mktsegment", "c_custkey").alias("label"))
    labels = customers.union(table(spark, sf_dir, "part").select("p_brand").distinct()).withColumn("__k", natural_key("label"))
    rows = number_rows(ordered(labels, [], [F.col("__k"), F.col("label")]), "pos").plain()
    return rows.select("label", "pos")


# --- refresh plan --------------------------------------------------------------------------------


def plan_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Files are the documents; the state has one row per labelled document, some moved away."""
    files = document_files(spark, sf_dir).select("path", "size", "mtime_ms", "doc_id")
    labels = table(spark, sf_dir, "labels")
    state = labels.join(files.select("doc_id", "path"), "doc_id").select(
        F.when(F.col("quality") == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"),
        F.lit("book").alias("kind"),
        (F.col("doc_id") % 1000 + F.when(F.col("doc_id") % 2 == 0, 0.5).otherwise(-1.0)).alias("entry_mtime_ms"),
    )
    folders = state.filter("path like 'old/%'").select(parent_path("path").alias("path")).distinct()
    return files, state.unionByName(folders.select("path", F.lit("folder").alias("kind"), F.lit(0.0).alias("entry_mtime_ms")))


PLAN = f"""WITH files AS (SELECT doc_id, {DOC_PATH} AS path, doc_id % 1000 + 0.5 AS mtime_ms FROM documents),
  books AS (SELECT CASE WHEN quality = 0 THEN 'old/' || path ELSE path END AS path,
    doc_id % 1000 + CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE -1.0 END AS entry_ms FROM labels JOIN files USING (doc_id)),
  state AS (SELECT path FROM books UNION SELECT {parent_sql('path')} FROM books WHERE path LIKE 'old/%'),
  folders AS (SELECT DISTINCT array_to_string(parts[1:i], '/') AS path FROM (SELECT string_split({parent_sql('path')}, '/') AS parts FROM files) t,
    range(0, 5) r(i) WHERE i <= len(parts) UNION SELECT ''),
  changed AS (SELECT f.* FROM files f LEFT JOIN books b ON f.path = b.path WHERE b.path IS NULL OR f.mtime_ms > b.entry_ms),
  orphans AS (SELECT path FROM state WHERE path NOT IN (SELECT path FROM files UNION SELECT path FROM folders)),
  plan AS (SELECT 0 AS seq, 'delete' AS action, path FROM orphans UNION ALL SELECT 1, 'folder', path FROM folders
    UNION ALL SELECT 2, 'process', path FROM changed)
"""


@query(PLAN + "SELECT doc_id, path FROM changed")
def changed_items(spark, sf_dir) -> DataFrame:
    files, state = plan_inputs(spark, sf_dir)
    return sync.changed_files(files, state).select("doc_id", "path")


@query(PLAN + "SELECT path FROM orphans")
def orphan_items(spark, sf_dir) -> DataFrame:
    return sync.orphan_entries(*plan_inputs(spark, sf_dir))


@query(PLAN + f"""SELECT seq, CASE action WHEN 'delete' THEN 'BookDeleted' WHEN 'folder' THEN 'FolderCreated' ELSE 'BookCreated' END AS tag,
  '/books/' || CASE WHEN {parent_sql('path')} = '' THEN '' ELSE {parent_sql('path')} || '/' END AS parent, {name_sql('path')} AS name FROM plan""")
def plan_events(spark, sf_dir) -> DataFrame:
    return sync.plan_events(sync.plan(*plan_inputs(spark, sf_dir)), "/books")


# Every third page is a text file, every seventh a file that is no book.
_SUFFIX = "CASE WHEN page_id % 7 = 0 THEN '.md' WHEN page_id % 3 = 0 THEN '.TXT' ELSE '.epub' END"


def page_tree(spark, sf_dir) -> str:
    """The pages written as a tree of files in the shared folder; a task that runs again writes the same files."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    files = page_files(spark, sf_dir, html=F.col("html")).select(F.concat("path", F.expr(_SUFFIX)).alias("path"), "html")

    def write(batches):
        for batch in batches:
            for path, html in zip(batch["path"], batch["html"]):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as file:
                    file.write((html or "").encode())
            yield batch[["path"]]

    files.mapInPandas(write, "path string").agg(F.count(F.lit(1))).collect()
    return root


@query(f"""SELECT path, lower(regexp_extract(path, '[^.]+$')) AS extension, size FROM (SELECT path || {_SUFFIX} AS path, strlen(coalesce(html, ''))::BIGINT AS size FROM {PAGES})
  WHERE path NOT LIKE '%.md'""")
def scanned_files(spark, sf_dir) -> DataFrame:
    return scan_files(spark, page_tree(spark, sf_dir)).select("path", "extension", "size")


# From the listing on: the tree is listed, planned against an empty catalog and applied.
@query(f"""WITH f AS (SELECT path || {_SUFFIX} AS path FROM {PAGES}), b AS (SELECT * FROM f WHERE path NOT LIKE '%.md')
  SELECT path, 'book' AS kind FROM b UNION SELECT array_to_string(p[1:i], '/'), 'folder' FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM b))""")
def synced_tree(spark, sf_dir) -> DataFrame:
    files = scan_files(spark, page_tree(spark, sf_dir))
    job = CatalogStream("/books", f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", buckets=8)
    for tag in ("BookCreated", "FolderCreated"):
        job.register(tag, default_entries)
    job.resynchronize(files, 0)
    return job.buckets_of(spark, "entries").read().select("path", "kind")


# The state lies in a table of entries; afterwards it has the files and folders of the listing, rewritten where need be.
@query(PLAN + """SELECT path, 'book' AS kind, path IN (SELECT path FROM changed) AS fresh FROM files
  UNION ALL SELECT path, 'folder', true FROM folders WHERE path <> ''""")
def resynced_entries(spark, sf_dir) -> DataFrame:
    files, state = plan_inputs(spark, sf_dir)
    job = CatalogStream("/books", f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}", buckets=8)
    for tag in ("BookCreated", "FolderCreated"):
        job.register(tag, default_entries)
    entries = job.buckets_of(spark, "entries")
    entries.rewrite(default_entries(state.withColumn("tag", F.when(F.col("kind") == "book", "BookCreated").otherwise("FolderCreated"))).drop("tag"))
    job.resynchronize(files, 0, now_ms=1 << 50)
    return entries.read().select("path", "kind", (F.col("entry_mtime_ms") == float(1 << 50)).alias("fresh"))


@query(PLAN + """SELECT count(*) FILTER (action = 'process')::BIGINT AS books_process, count(*) FILTER (action = 'delete')::BIGINT AS books_delete,
  count(*) FILTER (action = 'folder')::BIGINT AS folders_count FROM plan""")
def plan_summary(spark, sf_dir) -> DataFrame:
    return sync.plan_summary(sync.plan(*plan_inputs(spark, sf_dir)))


@query(PLAN + f"SELECT DISTINCT {parent_sql('path')} AS folder FROM state WHERE {parent_sql('path')} IN (SELECT path FROM folders)")
def live_folder_requests(spark, sf_dir) -> DataFrame:
    files, state = plan_inputs(spark, sf_dir)
    requests = state.select(parent_path("path").alias("folder")).distinct()
    return sync.live_folders(requests, folders_of(files))


@query(f"""SELECT count(*) AS files, sum(n_chars)::BIGINT AS bytes, bit_xor(h) AS hash_xor, sum(h)::HUGEINT::VARCHAR AS hash_sum FROM (
  SELECT n_chars, xor(('0x' || substr(m, 1, 15))::BIGINT, ('0x' || substr(m, 17, 15))::BIGINT) AS h FROM (
    SELECT n_chars, md5({DOC_PATH} || '|' || n_chars || '|' || (doc_id % 1000)) AS m FROM documents))""")
def dataset_fingerprint(spark, sf_dir) -> DataFrame:
    return sync.fingerprint(document_files(spark, sf_dir).select("path", "size", "mtime_ms"))


# Trees that are deleted: two languages of one source, one book, one path that does not exist.
@query(f"""WITH f AS (SELECT doc_id, {DOC_PATH} AS path FROM documents),
  gone AS (SELECT DISTINCT {parent_sql('path')} AS path FROM f WHERE doc_id % 100 = 0)
  SELECT doc_id, path FROM f WHERE {parent_sql('path')} NOT IN (SELECT path FROM gone) AND doc_id % 7 <> 0""")
def delete_subtree(spark, sf_dir) -> DataFrame:
    files = document_files(spark, sf_dir).select("doc_id", "path")
    folders = files.filter(F.col("doc_id") % 100 == 0).select(parent_path("path").alias("path"))
    books = files.filter(F.col("doc_id") % 7 == 0).select("path")
    return delete_subtrees(files, folders.union(books).union(files.select(F.concat(F.lit("no/"), "path"))))


@query("""SELECT doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL AND quality = 1 THEN 'label ' || l.doc_id END, 'doc ' || d.doc_id, '') AS title,
  coalesce(CASE WHEN toxic = 1 THEN 'toxic' END, lang) AS language, coalesce(nullif(quality, 0), nullif(n_chars % 3, 0))::INTEGER AS page_count
  FROM documents d FULL JOIN (SELECT doc_id + 3 AS doc_id, quality, toxic FROM labels) l USING (doc_id)""")
def metadata_merge(spark, sf_dir) -> DataFrame:
    # Labels of shifted ids: some of them have no document.
    labels = table(spark, sf_dir, "labels").withColumn("doc_id", F.col("doc_id") + 3)
    docs = table(spark, sf_dir, "documents")
    number = lambda prefix: F.concat(F.lit(prefix), F.col("doc_id").cast("string"))
    first = labels.select("doc_id", metadata(
        title=F.when(F.col("quality") == 1, number("label ")), language=F.when(F.col("toxic") == 1, "toxic").otherwise(""),
        page_count=F.col("quality")).alias("meta"))
    second = docs.select("doc_id", metadata(title=number("doc "), language=F.col("lang"), page_count=F.col("n_chars") % 3).alias("meta"))
    merged = merge_metadata(first, second, "doc_id")
    return merged.select("doc_id", "meta.title", "meta.language", "meta.page_count")


# --- feed documents ------------------------------------------------------------------------------


def page_catalog(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Feed headers and ordered entries with their XML."""
    files = page_files(spark, sf_dir, title=extract_title("html"), size=F.length("html"))
    structure = folder_structure(files)
    meta = metadata(title=F.col("title"))
    books = book_entries(files.select("path", "size", meta.alias("meta"), F.lit(False).alias("has_cover")))
    books = books.withColumn("xml", book_entry_xml(F.lit(UPDATED)))
    folders = folder_entries(structure).withColumn("xml", folder_entry_xml(F.lit(UPDATED)))
    columns = ["folder", "name", "kind", "id", "title", "author", "xml"]
    folders = folders.withColumn("author", F.lit(None).cast("string"))
    entries = order_entries(folders.select(*columns).unionByName(books.select(*columns)))
    feeds = feeds_of(structure, feed_kinds(entries), F.lit(UPDATED))
    return feeds, entries


def _line(tag: str, value: str, attributes: str = "") -> str:
    return f"'  <{tag}{attributes}>' || {xml_text_sql(value)} || '</{tag}>'"


_NAV = "application/atom+xml;profile=opds-catalog;kind=navigation"
_ACQ = "application/atom+xml;profile=opds-catalog;kind=acquisition"
_EXT = "lower(regexp_extract(name, '[^.]*$'))"
_BOOK_XML = " || chr(10) || ".join([
    "'<entry>'", _line("id", "'urn:opds:book:' || path"), _line("title", "title"), _line("updated", f"'{UPDATED}'"),
    _line("dc:format", f"upper({_EXT})"), _line("content", size_sql("length(html)"), ' type="text"'),
    f"""'  <link rel="http://opds-spec.org/acquisition/open-access" href="/' || {encode_sql('path')} || '/' || {encode_sql('name')} || '" type="application/octet-stream"/>'""",
    "'</entry>'"])
_FOLDER_XML = " || chr(10) || ".join([
    "'<entry>'", _line("id", "'urn:opds:catalog:' || path"), _line("title", "title"), _line("updated", f"'{UPDATED}'"),
    _line("summary", summary_sql("folder_count", "book_count"), ' type="text"'),
    f"""'  <link rel="subsection" href="/' || {encode_sql('path')} || '/feed.xml" type="{_NAV}"/>'""", "'</entry>'"])
XML_ENTRIES = f"""(SELECT *, {_FOLDER_XML} AS xml, 'folder' AS kind FROM (SELECT folder AS path, {parent_sql('folder')} AS folder, name,
    {title_sql('name')} AS title, folder_count, book_count FROM {STRUCTURE} WHERE folder <> '')
  UNION ALL BY NAME SELECT folder, path, name, title, {_BOOK_XML} AS xml, 'book' AS kind, {size_sql("length(html)")} AS size FROM (SELECT html, path, {parent_sql('path')} AS folder, {name_sql('path')} AS name,
    coalesce(nullif({PAGE_TITLE}, ''), {title_sql(f"regexp_replace({name_sql('path')}, '[.][^.]+$', '')")}) AS title FROM {PAGES}))"""
NUMBERED = f"""(SELECT *, row_number() OVER (PARTITION BY folder ORDER BY kind = 'book', {natural_sql('title')}, {natural_sql('name')}, name) AS pos
  FROM {XML_ENTRIES} WHERE name NOT LIKE '\\_%' ESCAPE '\\')"""


@query(f"""WITH parts AS (SELECT folder, ((pos - 1) // 1000 + 1)::INTEGER AS part, CASE WHEN (pos - 1) // 1000 > 0 THEN chr(10) ELSE '' END AS glue,
    string_agg(xml, chr(10) ORDER BY pos) AS text FROM {NUMBERED} GROUP BY folder, (pos - 1) // 1000),
  heads AS (SELECT folder, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) ||
    '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opds="http://opds-spec.org/2010/catalog" xmlns:dc="http://purl.org/dc/terms/">' || chr(10) ||
    '  <id>urn:opds:catalog:' || CASE WHEN folder = '' THEN 'root' ELSE {xml_text_sql('folder')} END || '</id>' || chr(10) ||
    '  <title>' || CASE WHEN folder = '' THEN 'Catalog' ELSE {xml_text_sql(title_sql('name'))} END || '</title>' || chr(10) ||
    '  <updated>{UPDATED}</updated>' || chr(10) || '  <link rel="self" href="' ||
    CASE WHEN folder = '' THEN '/feed.xml' ELSE '/' || {encode_sql('folder')} || '/feed.xml' END || '" type="' ||
    CASE WHEN book_count > 0 THEN '{_ACQ}' ELSE '{_NAV}' END || '"/>' || chr(10) ||
    '  <link rel="start" href="/feed.xml" type="{_NAV}"/>' || chr(10) AS text FROM {STRUCTURE})
  SELECT folder, 0 AS part, md5(text) AS digest FROM heads UNION ALL SELECT folder, part, md5(glue || text) FROM parts
  UNION ALL SELECT folder, 2147483647, md5(chr(10) || '</feed>') FROM heads""")
def feed_documents(spark, sf_dir) -> DataFrame:
    return feed_document_parts(*page_catalog(spark, sf_dir)).select("folder", "part", F.md5("text").alias("digest"))


@query(f"""SELECT n.folder, pos::INTEGER AS pos, kind, CASE WHEN kind = 'book' THEN 'urn:opds:book:' ELSE 'urn:opds:catalog:' END || path AS id, trim(title) AS title,
  CASE WHEN kind = 'folder' THEN {summary_sql('folder_count', 'book_count')} END AS summary,
  CASE WHEN kind = 'folder' THEN '/' || {encode_sql('path')} || '/feed.xml' END AS href,
  CASE WHEN kind = 'book' THEN '/' || {encode_sql('path')} || '/' || {encode_sql('name')} END AS acquisition FROM {NUMBERED} n""")
def parse_feed_entries(spark, sf_dir) -> DataFrame:
    rows = parse_entries(part_fragments(feed_document_parts(*page_catalog(spark, sf_dir))))
    acquisition = F.try_element_at("acquisitions", F.lit(1))["href"]
    return rows.select("folder", "pos", "kind", "id", "title", "summary", "href", acquisition.alias("acquisition"))


@query(f"""SELECT folder, part, true AS same FROM (SELECT DISTINCT folder, ((pos - 1) // 1000 + 1)::INTEGER AS part FROM {NUMBERED}
  UNION ALL SELECT folder, 0 FROM {FOLDERS} UNION ALL SELECT folder, 2147483647 FROM {FOLDERS})""")
def feed_round_trip(spark, sf_dir) -> DataFrame:
    parts = checkpointed(feed_document_parts(*page_catalog(spark, sf_dir)))
    again = feed_document_parts(part_headers(parts), part_fragments(parts)).withColumnRenamed("text", "again")
    both = parts.join(again, ["folder", "part"], "left")
    return both.select("folder", "part", F.col("text").eqNullSafe(F.col("again")).alias("same"))


def _html(value: str) -> str:
    for char, name in (("&", "&amp;"), ('"', "&quot;"), ("''", "&#39;"), ("<", "&lt;"), (">", "&gt;")):
        value = f"replace({value}, '{char}', '{name}')"
    return value


def _filled(template: str, **values: str) -> str:
    """SQL of a template text with each {name} replaced by an expression."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    return " || ".join(values[t] if i % 2 else quoted(t) for i, t in enumerate(re.split(r"\{(\w+)\}", template)) if i % 2 or t)


_TITLE = _html("trim(title)")
_HREF = _html(f"'/' || {encode_sql('path')} || '/'")
_FOLDER_CARD = _filled(documents.FOLDER_CARD, shelf=_filled(documents.FOLDER_SHELF, title=_TITLE), href=_HREF, title=_TITLE,
                       summary=f"coalesce({_filled(documents.CARD_TEXT, value=_html(summary_sql('folder_count', 'book_count')))}, '')")
_FILE = _html(f"'/' || {encode_sql('path')} || '/' || {encode_sql('name')}")
_ABOUT = f"'<span>' || {_html(f'''concat_ws(' · ', nullif(upper({_EXT}), ''), size)''')} || '</span>'"
_BOOK_CARD = _filled(
    documents.BOOK_CARD, title=_TITLE, number="book_no", card_cover=_filled(documents.COVER_TEXT, title=_TITLE), popup_cover=_filled(documents.COVER_TEXT, title=_TITLE),
    card_author="''", popup_author="''", popup_summary="''", meta=_filled(documents.POPUP_META, value=_ABOUT),
    downloads=_filled(documents.POPUP_DOWNLOADS, value=_filled(documents.DOWNLOAD, href=_FILE, label="'Download'")))


@query(f"""WITH e AS (SELECT *, count(*) FILTER (kind = 'book') OVER (PARTITION BY folder ORDER BY pos) AS book_no FROM {NUMBERED}),
  parts AS (SELECT folder, ((pos - 1) // 1000 + 1)::INTEGER AS part, CASE WHEN (pos - 1) // 1000 > 0 THEN chr(10) ELSE '' END AS glue,
    string_agg(CASE WHEN kind = 'folder' THEN {_FOLDER_CARD} ELSE {_BOOK_CARD} END, chr(10) ORDER BY pos) AS text FROM e GROUP BY folder, (pos - 1) // 1000),
  pages AS (SELECT folder, 0 AS part, {_filled(documents.PAGE_OPEN, title=_html('title'), home=f"CASE WHEN folder = '' THEN '' ELSE {_filled(documents.PAGE_HOME, start=chr(39) + '/' + chr(39))} END")} AS text
      FROM (SELECT folder, CASE WHEN folder = '' THEN 'Catalog' ELSE {title_sql('name')} END AS title FROM {STRUCTURE})
    UNION ALL SELECT folder, part, glue || text FROM parts UNION ALL SELECT folder, 2147483647, {_filled(documents.PAGE_CLOSE)} FROM {FOLDERS})
  SELECT folder, part, length(text)::INTEGER AS length, md5(text) AS digest FROM pages""")
def folder_pages(spark, sf_dir) -> DataFrame:
    feeds, entries = page_catalog(spark, sf_dir)
    parsed = parse_entries(entries.select("folder", "pos", "book_no", "xml"))
    return folder_page_parts(feeds, parsed).select("folder", "part", F.length("text").alias("length"), F.md5("text").alias("digest"))


def page_profiles(spark, sf_dir) -> DataFrame:
    parts = feed_document_parts(*page_catalog(spark, sf_dir))
    path = F.when(F.col("folder") == "", "feed.xml").otherwise(F.concat("folder", F.lit("/feed.xml")))
    return profile_feeds(parts.select(path.alias("path"), F.col("text").alias("xml")))


@query(f"""WITH p AS (SELECT f.folder, CASE WHEN f.folder = '' THEN '' ELSE f.folder || '/' END || 'feed.xml' AS path, count(n.xml) AS entries,
    max(greatest(length({xml_text_sql(title_sql('f.name'))}), coalesce(length({xml_text_sql('n.title')}), 0))) AS longest, bool_or(n.kind = 'book') AS books
  FROM {STRUCTURE} f JOIN {NUMBERED} n ON n.folder = f.folder GROUP BY f.folder, f.name)
  SELECT path, entries::INTEGER AS entries, len(string_split(path, '/'))::INTEGER AS depth, books AS book_without_cover, false AS cyrillic, longest::INTEGER AS max_title_length FROM p""")
def feed_profiles(spark, sf_dir) -> DataFrame:
    return page_profiles(spark, sf_dir)


@query(f"""WITH p AS (SELECT CASE WHEN f.folder = '' THEN 'feed.xml' ELSE f.folder || '/feed.xml' END AS path, count(n.xml) AS entries
    FROM {STRUCTURE} f LEFT JOIN {NUMBERED} n ON n.folder = f.folder GROUP BY 1),
  q AS (SELECT *, len(string_split(path, '/')) AS depth FROM p)
  SELECT 'root' AS pick, 'feed.xml' AS path, 0 AS rank
  UNION ALL (SELECT 'largest', path, entries::INTEGER FROM q ORDER BY entries DESC, path LIMIT 1)
  UNION ALL (SELECT 'deepest', path, depth::INTEGER FROM q WHERE depth > 2 ORDER BY depth DESC, path LIMIT 1)""")
def top_feeds(spark, sf_dir) -> DataFrame:
    return pick_feeds(page_profiles(spark, sf_dir))


@query(f"""SELECT page_id, href FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY
  CASE WHEN lower(href) LIKE '%cover%' THEN 0 WHEN lower(href) LIKE '%th%' THEN 1 ELSE 2 END, pos) AS n FROM (
  SELECT page_id, unnest(h) AS href, generate_subscripts(h, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS h FROM pages)))
  WHERE n = 1""")
def first_by_priority(spark, sf_dir) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(links_of("html")).alias("pos", "href"))
    low = F.lower("href")
    priority = F.when(low.contains("cover"), 0).when(low.contains("th"), 1).otherwise(2)
    return links.groupBy("page_id").agg(F.min_by("href", F.struct(priority, "pos")).alias("href"))


@query(f"SELECT folder, '/' || {encode_sql('folder')} || '/feed.xml' AS href FROM {FOLDERS} WHERE folder <> ''")
def feed_addresses(spark, sf_dir) -> DataFrame:
    return folders_of(page_files(spark, sf_dir)).filter("folder <> ''").select("folder", feed_href("folder").alias("href"))
