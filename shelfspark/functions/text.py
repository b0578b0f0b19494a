"""Scalar text functions: paths for links, labels, titles, entities, dates and keyword lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.constants import ENTITIES, SOURCE_SUFFIXES, SPACE_CLASS

SPACE = f"[{SPACE_CLASS}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A column expression used inside a lambda is computed again for every element; a lambda variable
    is not. So the value is bound as the variable of a transform over a one-element array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pick(array: Column, start: Column, stop: Column, value=lambda x: x) -> Column:
    """``value`` of the elements from one position to another, both counted from 1.

    Spark's ``slice`` copies the whole array on every call; this touches the wanted elements only.
    """
    return F.transform(F.sequence(start, stop), lambda i: value(F.element_at(array, i)))


def tail(array: Column, start: Column | int) -> Column:
    """Elements from a 1-based position to the end."""
    return F.slice(array, start, F.size(array))


def strip_space(c: Column | str) -> Column:
    """Trim every character that counts as white space, not only blanks."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(c: Column | str) -> Column:
    """Each run of white space becomes one blank."""
    return F.regexp_replace(col(c), f"{SPACE}+", " ")


def collapse_ascii_space(c: Column | str) -> Column:
    """Collapse and trim tab, newline, form feed, return and blank only; null becomes ''."""
    one = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[\t\n\f\r ]+", " ")
    return F.regexp_replace(one, "^ | $", "")


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def encode_url_component(c: Column | str) -> Column:
    """Percent-encode all but letters, digits and ``-_.!~*'()``."""
    out = F.url_encode(col(c))
    for found, wanted in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def encode_url_path(c: Column | str) -> Column:
    """Percent-encode each segment and keep the slashes."""
    return F.replace(encode_url_component(c), F.lit("%2F"), F.lit("/"))


def decode_url_component(c: Column | str) -> Column:
    """Percent-decode; null when an escape is broken or is not UTF-8."""
    raw = col(c)
    out = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    broken = out.contains("�") & ~raw.contains("�") & ~F.upper(raw).contains("%EF%BF%BD")
    return F.when(~broken, out)


def format_file_size(c: Column | str) -> Column:
    """``512 B``, ``1.5 KB``, ``10.0 MB``: base 1024, no unit above MB."""
    n = col(c)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / F.lit(1024.0)))
        .otherwise(F.format_string("%.1f MB", n / F.lit(1024.0 * 1024.0)))
    )


def normalize_title(c: Column | str) -> Column:
    """Readable title from a file name: camel case split, majority separator to blanks, first letter up."""
    raw = col(c)
    hyphens = F.length(raw) - F.length(F.replace(raw, F.lit("-"), F.lit("")))
    underscores = F.length(raw) - F.length(F.replace(raw, F.lit("_"), F.lit("")))
    split = F.regexp_replace(raw, "([a-z])([A-Z])", "$1 $2")
    split = F.regexp_replace(split, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.when(hyphens > underscores, F.regexp_replace(split, "-+", " ")).otherwise(
        F.regexp_replace(split, "_+", " ")
    )
    clean = F.trim(collapse_space(spaced))
    return F.concat(F.upper(F.substring(clean, 1, 1)), F.substring(clean, 2, 2**31 - 1))


def folder_summary(folders: Column | str, books: Column | str) -> Column:
    """Counts under a folder title; null for an empty folder."""
    f, b = col(folders), col(books)
    f_label = F.concat(F.lit("\U0001f5c2 "), f.cast("string"))
    b_label = F.concat(F.lit("\U0001f4da "), b.cast("string"))
    return (
        F.when((f == 0) & (b == 0), F.lit(None).cast("string"))
        .when(f == 0, b_label)
        .when(b == 0, f_label)
        .otherwise(F.concat(f_label, F.lit(" · "), b_label))
    )


def strip_xml_declaration(c: Column | str) -> Column:
    return strip_space(F.regexp_replace(col(c), rf"<\?xml[^?]*\?>{SPACE}*", ""))


def decode_xml_entities(c: Column | str) -> Column:
    """The five XML names, ``&amp;`` before ``&quot;`` and ``&apos;`` (so those two may decode twice)."""
    out = col(c)
    for name in ("lt", "gt", "amp", "quot", "apos"):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    return out


def _code_units(token: Column, base: int) -> Column:
    """Text of a run of numeric references such as ``&#65;&#66;``; codes wrap at 65536.

    Halves of a pair that stand alone become the replacement character.
    """
    pattern, start = (r"&#([0-9]+);", 10) if base == 10 else (r"(?i)&#x([0-9a-f]+);", 16)
    codes = F.regexp_extract_all(token, F.lit(pattern), F.lit(1))
    if start == 10:
        unit = lambda d: F.lpad(F.hex((d.try_cast("decimal(38,0)") % 65536).cast("int")), 4, "0")
    else:
        unit = lambda d: F.upper(F.lpad(F.right(d, F.lit(4)), 4, "0"))
    units = F.array_join(F.transform(codes, unit), ",")
    pairs = F.regexp_replace(units, "(D[89AB]..),(D[C-F]..)", "$1$2")
    whole = F.regexp_replace(pairs, "(?<![0-9A-F])D[89A-F][0-9A-F]{2}(?![0-9A-F])", "FFFD")
    return F.decode(F.unhex(F.replace(whole, F.lit(","), F.lit(""))), "UTF-16BE")


def decode_entities(c: Column | str) -> Column:
    """Named, then decimal, then hexadecimal references; unknown names stay as they are.

    Repeated groups are possessive: the pattern engine then runs them in a loop instead of recursing.
    """
    raw = col(c)
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def rewrite(text: Column, token: str, rest: str, value) -> Column:
        parts = F.regexp_extract_all(text, F.lit(f"(?s)({token}|{rest})"), F.lit(1))
        return F.array_join(F.transform(parts, value), "")

    named = rewrite(
        raw,
        "&[a-zA-Z]+;",
        "[^&]+|&",
        lambda t: F.coalesce(
            F.when(t.rlike("^&[a-zA-Z]+;$"), F.try_element_at(names, F.substring(t, 2, F.length(t) - 2))), t
        ),
    )
    decimal = rewrite(
        named, "(?:&#[0-9]++;)++", "[^&]+|&", lambda t: F.when(t.startswith("&#"), _code_units(t, 10)).otherwise(t)
    )
    hexed = rewrite(
        decimal, "(?:&#[xX][0-9a-fA-F]++;)++", "[^&]+|&", lambda t: F.when(t.rlike("^&#[xX]"), _code_units(t, 16)).otherwise(t)
    )
    numeric = F.when(named.contains("&#"), hexed).otherwise(named)
    return F.when(raw.contains("&"), numeric).otherwise(raw)


def get_string(c: Column | str) -> Column:
    """Trimmed and decoded text of a scalar value; null stays null."""
    return decode_entities(strip_space(col(c).cast("string")))


def first_string(c: Column | str) -> Column:
    return get_string(F.try_element_at(col(c), F.lit(1)))


def string_array(c: Column | str) -> Column:
    """Decoded values without the empty ones; null when none is left."""
    kept = F.filter(F.transform(col(c), get_string), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) > 0, kept)


def clean_description(c: Column | str) -> Column:
    """Tags removed without a blank, white space collapsed; null when nothing is left."""
    return empty_to_null(strip_space(collapse_space(F.regexp_replace(col(c), "<[^>]+>", ""))))


def parse_date(c: Column | str) -> Column:
    """Leading ``YYYY`` or ``YYYY-MM``."""
    return empty_to_null(F.regexp_extract(col(c), r"^([0-9]{4}(?:-[0-9]{2})?)", 1))


def year_of_text(c: Column | str) -> Column:
    """First whole word that is a year of the 20th or 21st century."""
    return empty_to_null(F.regexp_extract(col(c), r"\b((?:19|20)[0-9]{2})\b", 1))


def split_list(c: Column | str, separators: str = ",;") -> Column:
    """Trimmed parts without the empty ones; null when none is left."""
    parts = F.transform(F.split(col(c), f"[{separators}]"), strip_space)
    kept = F.filter(parts, lambda x: x != "")
    return F.when(F.size(kept) > 0, kept)


def split_keywords(c: Column | str) -> Column:
    return split_list(c, ",;")


def split_genres(c: Column | str) -> Column:
    return split_list(c, ",")


def format_series(name: Column | str, volume: Column | str, number: Column | str) -> Column:
    """``Name Vol.V #N`` from the parts that are there."""
    def truthy(c):
        return F.when(c.isNotNull() & ~c.isin("", "0"), c)

    volume, number = truthy(col(volume).cast("string")), truthy(col(number).cast("string"))
    return empty_to_null(
        F.concat_ws(" ", empty_to_null(name), F.concat(F.lit("Vol."), volume), F.concat(F.lit("#"), number))
    )


def year_month(year: Column | str, month: Column | str) -> Column:
    y, m = col(year).try_cast("int"), col(month).try_cast("int")
    label = F.when(m.isNotNull() & (m != 0), F.format_string("%d-%02d", y, m)).otherwise(y.cast("string"))
    return F.when(y.isNotNull() & (y != 0), label)


def strip_source_extension(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"(?i)\.({'|'.join(SOURCE_SUFFIXES)})$", "")


def html_escape(c: Column | str) -> Column:
    out = col(c)
    for char, name in (("&", "&amp;"), ('"', "&quot;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def xml_text(c: Column | str) -> Column:
    """Escaped element text."""
    out = col(c)
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def xml_attribute(c: Column | str) -> Column:
    """Escaped attribute value."""
    return F.replace(xml_text(c), F.lit('"'), F.lit("&quot;"))


def camel_case(c: Column | str) -> Column:
    """``dash-or:colon`` to ``dashOrColon``."""
    parts = F.split(F.lower(col(c)), "[-:](?=.)")
    rest = F.transform(
        tail(parts, 2), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 2**31 - 1))
    )
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


def parse_clock(c: Column | str) -> Column:
    """Seconds of ``h:m:s``, ``m:s`` or a number with the unit h, min, ms or s."""
    raw = col(c)
    parts = F.transform(F.split(raw, ":"), lambda p: F.regexp_extract(p, r"^\s*([0-9]*\.?[0-9]+)", 1).try_cast("double"))
    at = lambda i: F.try_element_at(parts, F.lit(i))
    unit = F.regexp_extract(raw, r"^[0-9.]*([^0-9.]*)", 1)
    factor = F.when(unit == "h", 3600.0).when(unit == "min", 60.0).when(unit == "ms", 0.001).otherwise(1.0)
    return F.when(raw.isNotNull() & (raw != ""),
                  F.when(F.size(parts) == 3, at(1) * 3600 + at(2) * 60 + at(3))
                  .when(F.size(parts) == 2, at(1) * 60 + at(2))
                  .otherwise(at(1) * factor))


def person_name(first, middle, last, nickname, nickname_first: bool = False) -> Column:
    """First, middle and last name, or the nickname; the reader prefers the nickname."""
    full = empty_to_null(F.concat_ws(" ", *(empty_to_null(x) for x in (first, middle, last))))
    nick = empty_to_null(nickname)
    return F.coalesce(nick, full) if nickname_first else F.coalesce(full, nick, F.lit(""))


def person_sort_name(first, middle, last) -> Column:
    """``Last, First Middle``; null without a last name."""
    given = F.concat_ws(" ", empty_to_null(first), empty_to_null(middle))
    return F.when(empty_to_null(last).isNotNull(), F.concat(col(last), F.lit(", "), given))
