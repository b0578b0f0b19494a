"""Full-text search with excerpts, words with offsets.

Inputs are columns with the whole text, or with the text nodes of a document. Positions count
characters from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import EXCERPT_CONTEXT
from shelfspark.functions.text import col, collapse_space, let, pick, tail

CHUNK = 32
# Possessive, so that the pattern engine loops over the parts of a word instead of recursing.
WORD = r"[\p{L}\p{M}\p{N}_]++(?:['’.·]\p{L}[\p{L}\p{M}\p{N}_]*+|[.,;'’]\p{N}[\p{L}\p{M}\p{N}_]*+)*+"
GAP = r"[^\p{L}\p{M}\p{N}_]+"
SENTENCE = r"[^.!?…]*[.!?…]+[\"'”’)\]]*\s*|[^.!?…]+$"


def piece_starts(pieces: Column) -> Column:
    """Start of each piece of a text cut in pieces.

    The running sum is folded inside chunks and over the chunks, so its cost stays near linear.
    """
    nothing = F.array().cast("array<int>")

    def fold(values: Column, start: Column) -> Column:
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(values, F.struct(start.alias("at"), nothing.alias("out")), step)["out"]

    def chunked(lengths: Column) -> Column:
        last = F.greatest(F.ceil(F.size(lengths) / CHUNK).cast("int") - 1, F.lit(0))
        chunk = lambda c: pick(lengths, c * CHUNK + 1, F.least((c + 1) * CHUNK, F.size(lengths)))
        return F.transform(F.sequence(F.lit(0), last), chunk)

    def starts(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v))
        return F.flatten(F.zip_with(chunks, fold(totals, F.lit(0)), fold))

    found = let(F.transform(pieces, F.length), lambda lengths: F.when(F.size(lengths) > 0, let(chunked(lengths), starts)))
    return F.coalesce(found, nothing)


def _quote(text: str) -> str:
    return re.sub(r"([^\w\s]|_)", r"\\\1", text)


def hit_positions(text: Column | str, query: str, match_case: bool = False) -> Column:
    """All positions of a query in a text, overlapping ones included."""
    needle = query if match_case else query.lower()

    def find(haystack: Column) -> Column:
        # A cut in front of every occurrence: each piece but possibly the first starts with a hit.
        starts = piece_starts(F.split(haystack, f"(?={_quote(needle)})"))
        first = F.when(haystack.startswith(needle), 1).otherwise(2)
        hits = let(starts, lambda s: tail(s, first))
        return F.when(haystack.contains(needle), hits).otherwise(F.array().cast("array<int>"))

    return let(col(text) if match_case else F.lower(col(text)), find)


def make_excerpt(first: Column, start: Column, match: Column, last: Column, end: Column) -> Column:
    """struct<pre, match, post> of a hit from ``start`` in one text node to ``end`` in the last.

    Up to 50 characters on each side, with an ellipsis where text is cut. A window of the context is
    enough unless most of it is white space.
    """
    n, window = EXCERPT_CONTEXT, 4 * EXCERPT_CONTEXT
    rest = F.length(last) - end
    before = collapse_space(F.substring(first, F.greatest(start - window, F.lit(0)) + 1, F.least(start, F.lit(window))))
    after = collapse_space(F.substring(last, end + 1, F.lit(window)))
    whole_before = collapse_space(F.substring(first, F.lit(1), start))
    whole_after = collapse_space(F.substring(last, end + 1, rest))
    enough = lambda near, size: (F.length(near) > n + 1) | (size <= window)
    pre = let(before, lambda b: F.regexp_replace(F.when(enough(b, start), b).otherwise(whole_before), "^ ", ""))
    post = let(after, lambda a: F.regexp_replace(F.when(enough(a, rest), a).otherwise(whole_after), " $", ""))
    dots = lambda c: F.when(F.length(c) < n, "").otherwise("…")
    return F.struct(
        let(pre, lambda p: F.concat(dots(p), F.right(p, F.lit(n)))).alias("pre"),
        match.alias("match"),
        let(post, lambda p: F.concat(F.left(p, F.lit(n)), dots(p))).alias("post"),
    )


def search_text(docs: DataFrame, text: str, query: str, match_case: bool = False) -> DataFrame:
    """One row per hit in a text column: the other columns, hit_no, start, pre, match, post."""
    others = [c for c in docs.columns if c != text]
    found = F.col(text).contains(query) if match_case else F.lower(text).contains(query.lower())
    size = len(query)

    def hit(at: Column) -> Column:
        t = F.col(text)
        return F.struct(
            at.alias("start"),
            make_excerpt(t, at, F.substring(t, at + 1, F.lit(size)), t, at + size).alias("x"),
        )

    hits = F.transform(hit_positions(text, query, match_case), hit)
    rows = docs.filter(found).select(*others, F.posexplode(hits).alias("hit_no", "h"))
    return rows.select(*others, (F.col("hit_no") + 1).alias("hit_no"), "h.start", "h.x.pre", "h.x.match", "h.x.post")


def search_segments(docs: DataFrame, segments: str, query: str, match_case: bool = False) -> DataFrame:
    """One row per hit in an array of text nodes, with the node and offset of its start and end.

    The context comes from the node of the start and the node of the end; a hit over several nodes
    keeps its whole text.
    """
    others = [c for c in docs.columns if c != segments]
    joined = docs.withColumn("__text", F.array_join(segments, ""))
    found = F.col("__text").contains(query) if match_case else F.lower("__text").contains(query.lower())
    # Empty nodes hold no position and would only blur the node numbers.
    rows = joined.filter(found).withColumn("__starts", piece_starts(F.col(segments)))
    rows = rows.withColumn("__at", F.explode(hit_positions("__text", query, match_case)))
    end = F.col("__at") + len(query)
    last = F.size(segments)
    node = lambda position: F.least(F.size(F.filter("__starts", lambda s: s <= position)), last)
    rows = rows.withColumn("start_node", node(F.col("__at")) - 1).withColumn("end_node", node(end) - 1)
    offset = lambda position, n: position - F.element_at("__starts", F.col(n) + 1)
    rows = rows.withColumn("start_offset", offset(F.col("__at"), "start_node"))
    rows = rows.withColumn("end_offset", offset(end, "end_node"))
    first, final = F.element_at(segments, F.col("start_node") + 1), F.element_at(segments, F.col("end_node") + 1)
    match = F.substring("__text", F.col("__at") + 1, F.lit(len(query)))
    excerpt = make_excerpt(first, F.col("start_offset"), match, final, F.col("end_offset"))
    return rows.withColumn("x", excerpt).select(
        *others, "start_node", "start_offset", "end_node", "end_offset", "x.pre", "x.match", "x.post"
    )


def hits_by_section(hits: DataFrame, totals: DataFrame, book: str, section: str) -> DataFrame:
    """Hits per section that has any, with the share of the book read after it.

    totals: book, sections (number of sections of each book).
    """
    counted = hits.groupBy(book, section).agg(F.count(F.lit(1)).alias("hits"))
    return counted.join(totals, book).withColumn("progress", (F.col(section) + 1) / F.col("sections"))


def placed_tokens(text: Column | str, unit: str = WORD, gap: str = GAP) -> Column:
    """array<struct<start, token>> of the words of a text."""
    pieces = F.regexp_extract_all(col(text), F.lit(f"({unit}|{gap})"), F.lit(1))
    place = lambda ps: F.zip_with(ps, piece_starts(ps), lambda t, s: F.struct(s.alias("start"), t.alias("token")))

    def is_word(token: Column) -> Column:
        # The first character decides; ASCII ones without a pattern.
        code = F.ascii(token)
        letter = code.between(97, 122) | code.between(65, 90) | code.between(48, 57) | (code == 95)
        return F.when(code < 128, letter).otherwise(token.rlike(r"^[\p{L}\p{M}\p{N}_]"))

    return F.filter(let(pieces, place), lambda p: is_word(p["token"]))


def words(docs: DataFrame, text: str) -> DataFrame:
    """One row per word: the other columns, word_no, start, word."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(*others, F.posexplode(placed_tokens(text)).alias("word_no", "p"))
    return rows.select(*others, "word_no", "p.start", F.col("p.token").alias("word"))


def sentences(docs: DataFrame, text: str) -> DataFrame:
    """One row per sentence: the other columns, sentence_no, start, sentence."""
    others = [c for c in docs.columns if c != text]
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)({SENTENCE})"), F.lit(1))
    place = lambda ps: F.zip_with(ps, piece_starts(ps), lambda t, s: F.struct(s.alias("start"), t.alias("sentence")))
    return docs.select(*others, F.posexplode(let(pieces, place)).alias("sentence_no", "p")).select(*others, "sentence_no", "p.*")
