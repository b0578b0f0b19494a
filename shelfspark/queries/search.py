"""Full-text search and text units of documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import BLOCK_TAGS
from shelfspark.formats.html import element_attributes, elements_by_class, html_elements
from shelfspark.functions.markup import block_texts, text_segments
from shelfspark.operators import phrases, search
from shelfspark.queries.base import query, table, texts

NEEDLE = "ungau"
COMMON = "tion"


def _hits(needle: str, source: str, key: str, text: str) -> str:
    """Hits of a needle that cannot overlap itself: running lengths of the pieces between them."""
    n = len(needle)
    return f"""(SELECT {key}, i AS hit_no, {text} AS text, list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * {n} AS start
      FROM (SELECT {key}, {text}, parts, unnest(range(1, len(parts))) AS i FROM (SELECT {key}, {text}, string_split(lower({text}), '{needle}') AS parts FROM {source})))"""


@query(f"SELECT doc_id, hit_no::INTEGER AS hit_no, start::INTEGER AS start FROM {_hits(NEEDLE, 'documents', 'doc_id', 'text')}")
def text_search(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return search.search_text(docs, "text", NEEDLE).select("doc_id", "hit_no", "start")


_S = r"[\s\x{00A0}]+"


@query(f"""SELECT doc_id, hit_no::INTEGER AS hit_no, CASE WHEN length(b) < 50 THEN '' ELSE '…' END || right(b, 50) AS pre,
  substr(text, start::INTEGER + 1, {len(NEEDLE)}) AS match, left(a, 50) || CASE WHEN length(a) < 50 THEN '' ELSE '…' END AS post
  FROM (SELECT *, ltrim(regexp_replace(left(text, start::INTEGER), '{_S}', ' ', 'g')) AS b,
    rtrim(regexp_replace(substr(text, start::INTEGER + {len(NEEDLE)} + 1), '{_S}', ' ', 'g')) AS a FROM {_hits(NEEDLE, 'documents', 'doc_id', 'text')})""")
def search_excerpts(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return search.search_text(docs, "text", NEEDLE).select("doc_id", "hit_no", "pre", "match", "post")


@query(f"""SELECT doc_id, ((length(text) - length(replace(text, '{COMMON}', ''))) // {len(COMMON)})::BIGINT AS hits FROM documents WHERE contains(text, '{COMMON}')""")
def hits_by_document(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    hits = F.size(search.hit_positions("text", COMMON, match_case=True)).cast("long")
    return docs.filter(F.col("text").contains(COMMON)).select("doc_id", hits.alias("hits"))


@query(f"""SELECT conv_id AS book, turn AS section, ((length(text) - length(replace(lower(text), '{COMMON}', ''))) // {len(COMMON)})::BIGINT AS hits,
  (turn + 1) / sections AS progress FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS sections FROM conversations) WHERE contains(lower(text), '{COMMON}')""")
def hits_by_section(spark, sf_dir) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("turn").alias("section"), "text")
    totals = turns.groupBy("book").agg(F.count(F.lit(1)).alias("sections"))
    return search.hits_by_section(search.search_text(turns, "text", COMMON), totals, "book", "section").drop("sections")


PHRASE = "de la"
_FOLDED = r"strip_accents(lower(regexp_replace(regexp_replace(text, '\p{Cf}', '', 'g'), '[\s\x{00A0}]+', ' ', 'g')))"


@query(f"""SELECT doc_id, ((length(f) - length(replace(f, '{PHRASE}', ''))) // {len(PHRASE)})::BIGINT AS hits FROM (SELECT doc_id, {_FOLDED} AS f FROM documents) WHERE contains(f, '{PHRASE}')""")
def phrase_search(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    return phrases.search_phrase(docs, "text", "De  là".replace("  ", " ")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


_WORD = r"[\p{L}\p{M}\p{N}_]+(?:[''’.·]\p{L}[\p{L}\p{M}\p{N}_]*|[.,;''’]\p{N}[\p{L}\p{M}\p{N}_]*)*"
_GAP = r"[^\p{L}\p{M}\p{N}_]+"


@query(f"""SELECT doc_id, hits FROM (SELECT doc_id, len(list_filter(regexp_extract_all(text, '{_WORD}'), lambda w: lower(w) = 'der'))::BIGINT AS hits FROM documents) WHERE hits > 0""")
def word_search(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "documents", "doc_id", "text")
    hits = phrases.search_phrase(docs, "text", "DER", "accent", whole_words=True)
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query(f"""SELECT doc_id, count(*) AS words, sum(start)::BIGINT AS starts, max(length(token))::INTEGER AS longest FROM (
  SELECT doc_id, token, sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(token) AS start FROM (
    SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}|{_GAP}') AS t FROM documents)))
  WHERE regexp_matches(token, '^[\\p{{L}}\\p{{M}}\\p{{N}}_]') GROUP BY doc_id""")
def text_words(spark, sf_dir) -> DataFrame:
    rows = search.words(texts(spark, sf_dir, "documents", "doc_id", "text"), "text")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("words"), F.sum("start").alias("starts"), F.max(F.length("word")).alias("longest")
    )


_SENTENCE = r"[^.!?…]*[.!?…]+[\"''”’)\]]*\s*|[^.!?…]+$"


@query(f"""SELECT conv_id, turn, count(*) AS sentences, sum(start)::BIGINT AS starts FROM (
  SELECT conv_id, turn, sum(length(token)) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS UNBOUNDED PRECEDING) - length(token) AS start FROM (
    SELECT conv_id, turn, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM (SELECT conv_id, turn, regexp_extract_all(text, '(?s){_SENTENCE}') AS t FROM conversations)))
  GROUP BY conv_id, turn""")
def text_sentences(spark, sf_dir) -> DataFrame:
    rows = search.sentences(texts(spark, sf_dir, "conversations", "conv_id", "turn", "text"), "text")
    return rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("sentences"), F.sum("start").alias("starts"))


_BODY = r"""regexp_extract(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)', 1)"""
_INSIDE = r"""(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
_TAG = f"<{_INSIDE}|<[^>]*>"


def _decoded(x: str) -> str:
    """Text with the references that the pages hold."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


_SEGMENTS = f"list_transform(list_filter(string_split_regex({_BODY}, '{_TAG}'), lambda x: x <> ''), lambda x: {_decoded('x')})"


@query(f"SELECT page_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS segment FROM (SELECT page_id, {_SEGMENTS} AS s FROM pages)")
def page_segments(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.posexplode(text_segments("html")).alias("pos", "segment"))


@query(f"""SELECT page_id, (generate_subscripts(b, 1) - 1)::INTEGER AS pos, unnest(b) AS block FROM (SELECT page_id,
  list_filter(list_transform((string_split_regex({_BODY}, '(?i)<(?:{'|'.join(BLOCK_TAGS)})(?:>|[\\s/](?:{_INSIDE}|[^>]*>))'))[2:],
    lambda x: {_decoded(f"regexp_replace(x, '{_TAG}', '', 'g')")}),
    lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> '') AS b FROM pages)""")
def text_blocks(spark, sf_dir) -> DataFrame:
    return texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.posexplode(block_texts("html")).alias("pos", "block"))


@query(f"""WITH p AS (SELECT page_id, s, array_to_string(s, '') AS text, list_transform(range(1, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x))), 0)) AS starts
    FROM (SELECT page_id, {_SEGMENTS} AS s FROM pages)),
  h AS (SELECT page_id, start::INTEGER AS a, start::INTEGER + {len(COMMON)} AS e FROM {_hits(COMMON, 'p', 'page_id', 'text')}),
  n AS (SELECT h.page_id, a, e, starts, len(list_filter(starts, lambda x: x <= a)) - 1 AS start_node, len(list_filter(starts, lambda x: x <= e)) - 1 AS end_node FROM h JOIN p USING (page_id))
  SELECT page_id, start_node::INTEGER AS start_node, (a - starts[start_node + 1])::INTEGER AS start_offset, end_node::INTEGER AS end_node, (e - starts[end_node + 1])::INTEGER AS end_offset FROM n""")
def segment_search(spark, sf_dir) -> DataFrame:
    pages = texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", text_segments("html").alias("segments"))
    hits = search.search_segments(pages, "segments", COMMON)
    return hits.select("page_id", "start_node", "start_offset", "end_node", "end_offset")


NODE_PHRASE = "hès"
_JOINT = "chr(65529)"
_OVER = r"(?i)h\x{FFF9}?[eéèêë]\x{FFF9}?s"


@query(f"""WITH p AS (SELECT page_id, s, regexp_extract_all(t, '{_OVER}') AS m, string_split_regex(t, '{_OVER}') AS parts,
    list_transform(range(1, len(s) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i - 1], lambda x: length(x) + 1)), 0)) AS starts
    FROM (SELECT page_id, s, array_to_string(s, {_JOINT}) AS t FROM (SELECT page_id, {_SEGMENTS} AS s FROM pages))),
  h AS (SELECT page_id, s, starts, m[i] AS found, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM p)),
  n AS (SELECT *, len(list_filter(starts, lambda x: x <= a)) AS f, len(list_filter(starts, lambda x: x <= a + length(found) - 1)) AS l FROM h),
  o AS (SELECT page_id, f, l, (a - starts[f])::INTEGER AS start_offset, (a + length(found) - starts[l])::INTEGER AS end_offset, replace(found, {_JOINT}, '') AS match, s FROM n)
  SELECT page_id, (f - 1)::INTEGER AS start_node, start_offset, (l - 1)::INTEGER AS end_node, end_offset,
    CASE WHEN length(b) < 50 THEN '' ELSE '…' END || right(b, 50) AS pre, match, left(e, 50) || CASE WHEN length(e) < 50 THEN '' ELSE '…' END AS post
  FROM (SELECT *, ltrim(regexp_replace(left(s[f], start_offset), '{_S}', ' ', 'g')) AS b, rtrim(regexp_replace(substr(s[l], end_offset + 1), '{_S}', ' ', 'g')) AS e FROM o)""")
def segment_phrase(spark, sf_dir) -> DataFrame:
    pages = texts(spark, sf_dir, "pages", "page_id", "html").select("page_id", text_segments("html").alias("segments"))
    return phrases.search_nodes(pages, "segments", NODE_PHRASE)


@query(r"""SELECT page_id, lower(tag) AS tag, count(*) AS elements FROM (SELECT page_id, unnest(regexp_extract_all(
  regexp_replace(html, '(?is)<!--.*?-->|(<script\b[^>]*>).*?</script\s*>', '\1', 'g'), '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1, 2""")
def html_element_counts(spark, sf_dir) -> DataFrame:
    elements = html_elements(texts(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")
    return elements.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("elements"))


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1)) AS text FROM pages""")
def html_by_class(spark, sf_dir) -> DataFrame:
    elements = html_elements(texts(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")
    return elements_by_class(elements, "ad").select("page_id", "text")


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) AS value FROM pages""")
def html_attributes(spark, sf_dir) -> DataFrame:
    elements = html_elements(texts(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")
    return element_attributes(elements, "page_id").filter("tag = 'a' and name = 'href'").select("page_id", "value")
