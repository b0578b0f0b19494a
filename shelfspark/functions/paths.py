"""Functions of slash-separated relative paths. The root folder is the empty path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import col, let


def path_name(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def parent_path(path: Column | str) -> Column:
    """Folder of a path; a trailing slash does not count."""
    p = F.regexp_replace(col(path), "/$", "")
    return F.regexp_replace(p, "/?[^/]*$", "")


def path_depth(path: Column | str) -> Column:
    p = col(path)
    return F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))


def file_extension(name: Column | str) -> Column:
    """Lower-case text after the last dot; '' for no dot or a leading dot only."""
    return F.lower(F.regexp_extract(path_name(name), r"^.+\.([^.]*)$", 1))


def loose_extension(name: Column | str) -> Column:
    """Lower-case last dot-separated part: a name without a dot is its own extension."""
    return F.lower(F.substring_index(col(name), ".", -1))


def format_extension(path: Column | str) -> Column:
    """Extension that picks the extractor: ``.fb2.zip`` counts as one extension."""
    return F.when(F.lower(col(path)).endswith(".fb2.zip"), "fb2.zip").otherwise(file_extension(path))


def strip_extension(name: Column | str) -> Column:
    """Name without its last extension."""
    return F.regexp_replace(col(name), r"\.[^.]+$", "")


def ancestor_paths(folder: Column | str) -> Column:
    """The folder and all folders above it, root first."""
    p = col(folder)
    prefixes = lambda parts: F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    below = let(F.split(p, "/"), prefixes)
    return F.when(p == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below))


def join_path(parent: Column | str, name: Column | str) -> Column:
    p, n = F.regexp_replace(col(parent), "/$", ""), col(name)
    return F.when(p == "", n).when(n == "", p).otherwise(F.concat_ws("/", p, n))


def relative_to(root: str, path: Column | str) -> Column:
    """Path below a root directory; the root itself is ''."""
    base = root.rstrip("/")
    p = F.regexp_replace(col(path), "/+$", "")
    return F.when(p == base, "").when(p.startswith(base + "/"), F.substring(p, len(base) + 2, 2**31 - 1)).otherwise(p)


def is_hidden(path: Column | str) -> Column:
    """Some part of the path starts with a dot."""
    return F.exists(F.split(col(path), "/"), lambda part: part.startswith("."))


def url_to_path(url: Column | str) -> Column:
    """``host/dir/leaf`` of a web address, without query, fragment and trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(col(url), "^[a-z]+://", ""), "[?#].*$", "")
    return F.regexp_replace(bare, "/+$", "")
