"""Refresh plan: compare a file listing with the state of the previous run.

files: path, size, mtime_ms. state: path, kind (book or folder), entry_mtime_ms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.paths import parent_path, path_name
from shelfspark.operators.folders import folders_of


def changed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files without an entry, or strictly newer than their entry."""
    known = state.filter("kind = 'book'").select("path", F.col("entry_mtime_ms").alias("__entry_ms"))
    return (
        files.join(known, "path", "left")
        .filter(F.col("__entry_ms").isNull() | (F.col("mtime_ms") > F.col("__entry_ms")))
        .drop("__entry_ms")
    )


def orphan_entries(files: DataFrame, state: DataFrame) -> DataFrame:
    """State paths that are neither a file nor a folder of the listing; the root is never one."""
    live = files.select("path").union(folders_of(files).select("folder"))
    return state.select("path").filter("path <> ''").distinct().join(live, "path", "left_anti")


def live_folders(requests: DataFrame, folders: DataFrame) -> DataFrame:
    """Rebuild requests whose source folder still exists; the root always does."""
    with_root = folders.select("folder").union(requests.sparkSession.range(1).select(F.lit("").alias("folder")))
    return requests.join(with_root, "folder", "left_semi")


def plan(files: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (seq, action, path): deletions, then every folder, then changed files."""
    part = lambda df, seq, action, c: df.select(F.lit(seq).alias("seq"), F.lit(action).alias("action"), F.col(c).alias("path"))
    return (
        part(orphan_entries(files, state), 0, "delete", "path")
        .unionByName(part(folders_of(files), 1, "folder", "folder"))
        .unionByName(part(changed_files(files, state), 2, "process", "path"))
    )


def plan_events(actions: DataFrame, root: str) -> DataFrame:
    """Plan rows to typed events (seq, tag, parent, name); orphan folders are deleted as books too."""
    base = F.lit(root.rstrip("/") + "/")
    above = parent_path("path")
    parent = F.when(above == "", base).otherwise(F.concat(base, above, F.lit("/")))
    tag = (
        F.when(F.col("action") == "delete", "BookDeleted")
        .when(F.col("action") == "folder", "FolderCreated")
        .otherwise("BookCreated")
    )
    return actions.select("seq", tag.alias("tag"), parent.alias("parent"), path_name("path").alias("name"))


def plan_summary(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count_if(F.col("action") == "process").alias("books_process"),
        F.count_if(F.col("action") == "delete").alias("books_delete"),
        F.count_if(F.col("action") == "folder").alias("folders_count"),
    )


def fingerprint(files: DataFrame) -> DataFrame:
    """Order-independent fingerprint of a listing: equal listings give equal rows.

    Path, size and whole milliseconds of each file make a digest, both halves of which count (60 bits
    each); count, exclusive or and the whole sum are combined on the map side, so nothing is sorted.
    """
    line = F.concat_ws("|", "path", F.col("size").cast("string"), F.floor("mtime_ms").cast("string"))
    half = lambda start: F.conv(F.substring(F.md5(line), start, 15), 16, 10).cast("long")
    return files.select("size", half(1).bitwiseXOR(half(17)).alias("h")).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.bit_xor("h").alias("hash_xor"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
    )
