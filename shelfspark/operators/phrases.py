"""Phrases under a collation, in whole texts or across the text nodes of a document.

A phrase is a number of units, graphemes or words. A run of white space is one blank, also where it goes on in the
next node, and format characters are no units; no unit spans two nodes. A hit is a run of as many units
whose folded text equals the phrase under the collation.

Collated comparison is dear, so a pattern looks for candidates first. ASCII characters have one weight each
and keep their order, so up to its first other character a hit reads like the phrase; with the other
character anything may begin, but a later ASCII character must be one of the phrase. Only the runs at such
places are cut out, folded and compared, and only texts with a hit are cut for its positions.
"""

from __future__ import annotations

import re
import unicodedata

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import SPACE_CLASS
from shelfspark.functions.text import col, collapse_space, let
from shelfspark.operators.search import WORD, make_excerpt, piece_starts, search_segments

# Collation of each sensitivity: what counts as different besides the letter itself.
SENSITIVITY = {"base": "UNICODE_CI_AI", "accent": "UNICODE_CI", "case": "UNICODE_AI", "variant": "UNICODE"}
# Stands between nodes: a format character that ends graphemes and words on both sides.
JOINT = "￹"
# Characters whose weights are not known here, white space of other scripts and control characters included.
OTHER = r"[^\x09-\x0D\x20-\x7E]"
BLANKS = rf"[{SPACE_CLASS}](?:[{SPACE_CLASS}\p{{Cf}}]*[{SPACE_CLASS}])?"
IN_WORD = r"[\p{L}\p{M}\p{N}_]"
# Format characters that belong to the grapheme behind them.
BEFORE = r"[\x{600}-\x{605}\x{6DD}\x{70F}\x{890}\x{891}\x{8E2}]"
FORMAT = rf"(?!{BEFORE})\p{{Cf}}"
# Places inside a grapheme. The pattern engine's own boundary depends on the match before, so it is of no use here.
INSIDE_GRAPHEME = (
    rf"(?<={BEFORE})", r"(?<=\x{200D})\p{So}",
    r"(?<=[^\p{Cc}\p{Cf}\x{2028}\x{2029}]|[\x{200C}\x{200D}])[\p{M}\x{1F3FB}-\x{1F3FF}\x{FF9E}\x{FF9F}\x{1160}-\x{11FF}]",
)
# Places inside a word, as a word is read greedily from its start.
INSIDE_WORD = (
    rf"(?<={IN_WORD}){IN_WORD}", rf"(?<={IN_WORD})['’.·]\p{{L}}", rf"(?<={IN_WORD})[.,;'’]\p{{N}}",
    rf"(?<={IN_WORD}['’.·])\p{{L}}", rf"(?<={IN_WORD}[.,;'’])\p{{N}}",
)
SURROGATE = r"[\x{DC00}-\x{DFFF}]"
# The pattern follows a phrase for this many characters; what comes later is left to the comparison.
FOLLOWED = 64
ANY = None


def _folded_query(query: str) -> str:
    return re.sub(rf"[{SPACE_CLASS}]+", " ", regex.sub(r"\p{Cf}", "", query))


def _slots(folded: str) -> list[str | None]:
    """What stands for each character of a phrase: itself, OTHER, or ANY where ASCII may be equal to it."""
    out = []
    for char in unicodedata.normalize("NFD", folded):
        if "\t" <= char <= "\r" or " " <= char <= "~":
            out.append(char)
        elif unicodedata.category(char) in ("Mn", "Me"):
            continue
        else:
            plain = any(c.isascii() for c in unicodedata.normalize("NFKD", char))
            foreign = unicodedata.category(char)[0] == "L" and not unicodedata.name(char, "LATIN").startswith("LATIN")
            out.append(OTHER if foreign and not plain else ANY)
    return out


def _letters(char: str, exact: bool) -> str:
    if char == " ":
        return r"\x09-\x0D\x20"
    return "".join(f"\\x{ord(c):02X}" for c in ({char} if exact else {char.lower(), char.upper()}))


def candidates(folded: str, units: int, exact: bool) -> str:
    """Pattern of all places where a phrase of so many units may begin, and of some others."""
    slots = _slots(folded)

    def stray(at: int) -> str:
        rest, least = slots[at:], max(units - 1 - at, 0)
        letters = "".join(dict.fromkeys(_letters(c, exact) for c in rest if c not in (ANY, OTHER)))
        if ANY in rest or least == 0:
            return OTHER
        return f"{OTHER}(?:{OTHER}{{{least}}}" + (f"|{OTHER}*+[{letters}])" if letters else ")")

    pattern = ""
    for at in reversed(range(min(len(slots), FOLLOWED))):
        if slots[at] is ANY:
            pattern = "(?s:.)"
        elif slots[at] == OTHER:
            pattern = stray(at)
        else:
            pattern = rf"(?:[{_letters(slots[at], exact)}]{'++' if slots[at] == ' ' else ''}{pattern}|{stray(at)})"
    return pattern


def phrase_hits(text: Column | str, query: str, sensitivity: str = "base", whole_words: bool = False) -> Column:
    """array<struct<start, end>>: the hits of a phrase in a text, overlapping ones included; an empty phrase has none.

    A hit that ends with a blank ends behind the first character of it. A phrase that begins with a flag of
    two regional indicators may also be found between two flags.
    """
    none = F.array().cast("array<struct<start:int,end:int>>")
    folded = _folded_query(query)
    units = regex.findall(rf"{BLANKS}|{WORD}|(?s:.)" if whole_words else rf"{BLANKS}|\X", folded)
    if not units:
        return none
    collation, exact = SENSITIVITY[sensitivity], sensitivity in ("case", "variant")
    guards = "".join(f"(?!{p})" for p in (*(INSIDE_WORD if whole_words else INSIDE_GRAPHEME), SURROGATE, FORMAT))
    if folded[0] == " ":
        guards += rf"(?!(?<=[{SPACE_CLASS}]\p{{Cf}}{{0,99}})[{SPACE_CLASS}])"
    place = f"(?={candidates(folded, len(units), exact)}){guards}"
    unit = rf"(?:{FORMAT})*+(?:{BLANKS}|" + (f"{WORD}|(?s:.))" if whole_words else r"\X)")
    place = f"{place}(?=((?:{unit}){{{len(units)}}}))"
    wanted = F.collate(F.lit(folded), collation)

    def is_hit(run: Column) -> Column:
        return F.collate(collapse_space(F.regexp_replace(run, r"\p{Cf}", "")), collation) == wanted

    def length(run: Column) -> Column:
        return F.length(F.regexp_replace(run, f"{BLANKS}$", " ")) if folded[-1] == " " else F.length(run)

    def placed(runs: Column, found: Column) -> Column:
        # Each piece but possibly the first begins with a candidate.
        starts = piece_starts(F.split(col(text), place))
        starts = let(starts, lambda s: F.slice(s, F.size(s) - F.size(runs) + 1, F.size(runs)))
        span = lambda run, start: F.struct(start.alias("start"), (start + length(run)).alias("end"))
        pairs = let(starts, lambda s: F.zip_with(runs, s, span))
        return let(pairs, lambda all_: F.filter(all_, lambda _, i: F.get(found, i)))

    def spans(runs: Column) -> Column:
        flags = F.transform(runs, is_hit)
        return let(flags, lambda found: F.when(F.array_contains(found, True), placed(runs, found)))

    return F.coalesce(let(F.regexp_extract_all(col(text), F.lit(place), F.lit(1)), spans), none)


def search_phrase(docs: DataFrame, text: str, query: str, sensitivity: str = "base", whole_words: bool = False) -> DataFrame:
    """One row per phrase hit: the other columns, start, end. Null and empty texts have none."""
    others = [c for c in docs.columns if c != text]
    spans = F.explode(phrase_hits(text, query, sensitivity, whole_words))
    return docs.select(*others, spans.alias("__s")).select(*others, "__s.start", "__s.end")


def search_nodes(
    docs: DataFrame, nodes: str, query: str, match_case: bool = False, match_diacritics: bool = False, whole_words: bool = False
) -> DataFrame:
    """One row per hit in an array of text nodes: the other columns, start_node, start_offset, end_node, end_offset, pre, match, post.

    With diacritics and without whole words the text is searched as it is (``search_segments``), else by units
    under the collation of the two settings. The match is the text of the nodes from start to end; null
    nodes count as empty.
    """
    if match_diacritics and not whole_words:
        return search_segments(docs, nodes, query, match_case)
    others = [c for c in docs.columns if c != nodes]
    sensitivity = {(0, 0): "base", (0, 1): "accent", (1, 0): "case", (1, 1): "variant"}[match_case, match_diacritics]
    filled = docs.withColumn("__nodes", F.transform(nodes, lambda n: F.coalesce(n, F.lit(""))))
    joined = filled.withColumn("__text", F.array_join("__nodes", JOINT))

    def hit(span: Column, starts: Column) -> Column:
        node = lambda position: F.size(F.filter(starts, lambda s: s <= position))
        text = lambda number: F.element_at("__nodes", number)
        ends = F.struct(node(span["start"]).alias("first"), node(span["end"] - 1).alias("last"))

        def described(e: Column) -> Column:
            start = span["start"] - F.element_at(starts, e["first"])
            end = span["end"] - F.element_at(starts, e["last"])
            # The joints between the nodes are no text.
            between = F.slice(F.col("__nodes"), e["first"], e["last"] - e["first"] + 1)
            whole = F.array_join(between, "")
            match = F.substring(whole, start + 1, span["end"] - span["start"] - (e["last"] - e["first"]))
            return F.struct(
                (e["first"] - 1).alias("start_node"), start.alias("start_offset"), (e["last"] - 1).alias("end_node"), end.alias("end_offset"),
                make_excerpt(text(e["first"]), start, match, text(e["last"]), end).alias("x"),
            )

        return let(ends, described)

    def hits(spans: Column) -> Column:
        starts = piece_starts(F.transform("__nodes", lambda n: F.concat(n, F.lit(JOINT))))
        return F.when(F.size(spans) > 0, let(starts, lambda s: F.transform(spans, lambda span: hit(span, s))))

    # The hits are described before they become rows, so that no row carries the nodes.
    found = let(phrase_hits("__text", query, sensitivity, whole_words), hits)
    rows = joined.select(*others, F.explode(found).alias("__h"))
    return rows.select(
        *others, "__h.start_node", "__h.start_offset", "__h.end_node", "__h.end_offset", "__h.x.pre", "__h.x.match", "__h.x.post"
    )
