"""File listings of a tree and of the catalog state.

The tree is listed level by level: the folders of a level are spread over tasks, and each task hands on the names
of its folders in frames of bounded size, read from the folder as they are handed on. Sizes and times are asked for afterwards, with the names of all
folders spread over the tasks, so one huge folder is not one task's work. The root must be one that every executor can see.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.constants import BOOK_EXTENSIONS
from shelfspark.functions.frames import frames
from shelfspark.functions.paths import ancestor_paths, file_extension, parent_path
from shelfspark.session import Appended, shuffle_partitions

LISTING = "path string, full_path string, is_dir boolean, size long, mtime_ms double"
MEASURED = "path string, full_path string, size long, mtime_ms double"


def _is_book(name: str) -> bool:
    return "." in name[1:] and name.rsplit(".", 1)[1].lower() in BOOK_EXTENSIONS


def _local_children(root: str, folder: str) -> Iterator[tuple]:
    try:
        with os.scandir(os.path.join(root, folder) if folder else root) as found:
            for item in found:
                path = f"{folder}/{item.name}" if folder else item.name
                yield item.name, path, item.path, item.is_dir(follow_symlinks=False), None, None
    except OSError:
        return


def _remote_children(root: str, folder: str) -> Iterator[tuple]:
    """Children on a storage that has no folders of the system; sizes and times come with the names."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    place = f"{base.rstrip('/')}/{folder}".rstrip("/")
    for item in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
        path = f"{folder}/{item.base_name}" if folder else item.base_name
        full = f"{root.rstrip('/')}/{path}"
        if item.type == fs.FileType.Directory:
            yield item.base_name, path, full, True, None, None
        elif item.type == fs.FileType.File:
            yield item.base_name, path, full, False, item.size, item.mtime_ns / 1e6 if item.mtime_ns else None


def _nullable(found: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in found:
        yield frame.astype({"size": "Int64", "mtime_ms": "Float64"})


def _lister(root: str, remote: bool):
    children = _remote_children if remote else _local_children

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for batch in batches:
            for folder in batch["path"]:
                for name, *row in children(root, folder):
                    if not name.startswith(".") and (row[2] or _is_book(name)):
                        yield tuple(row)

    return lambda batches: _nullable(frames(rows(batches), LISTING))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size and time of the regular files; what went away meanwhile is left out."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, full_path in zip(batch["path"], batch["full_path"]):
                try:
                    found = os.lstat(full_path)
                except OSError:
                    continue
                if stat.S_ISREG(found.st_mode):
                    yield path, full_path, found.st_size, found.st_mtime_ns / 1e6

    return _nullable(frames(rows(), MEASURED))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Book files below a root: path (relative), full_path, size, mtime_ms, mtime, extension.

    The root is a folder or an address of a storage that Arrow knows (``s3://``, ``gs://``, ``hdfs://``); there a folder's
    names come as one list. Names starting with a dot are skipped, folders too; only regular files with one of the
    known extensions are listed, links are not followed. A root that is not there has no files.
    """
    remote = "://" in root and not root.startswith("file:")
    if not remote:
        root = os.path.abspath(root.removeprefix("file://").removeprefix("file:"))
    n = shuffle_partitions(spark)
    folders = spark.createDataFrame([("",)], "path string")
    listed = Appended(spark.createDataFrame([], LISTING), "listing")
    while True:
        listed.add(folders.repartition(n, F.hash("path")).mapInPandas(_lister(root, remote), LISTING))
        folders = listed.latest().filter("is_dir").select("path")
        if folders.isEmpty():
            break
    files = listed.read().filter("not is_dir").select("path", "full_path", "size", "mtime_ms")
    if not remote:
        files = files.select("path", "full_path").repartition(n, F.hash("path")).mapInPandas(_measure, MEASURED)
    return files.withColumns(
        {"extension": file_extension("path"), "mtime": F.timestamp_millis(F.floor("mtime_ms"))}
    )


def scan_mirror(entries: DataFrame) -> DataFrame:
    """Paths of an entries table: path, kind, entry_mtime_ms. Hidden and ``_`` parts are left out.

    Nothing below a book counts, and folders without an own entry are not in the table.
    """
    hidden = F.exists(F.split("path", "/"), lambda p: p.startswith(".") | p.startswith("_"))
    rows = entries.filter(~hidden & (F.col("path") != "")).groupBy("path").agg(
        F.when(F.bool_or(F.col("kind") == "book"), "book").otherwise("folder").alias("kind"),
        F.max("entry_mtime_ms").alias("entry_mtime_ms"),
    )
    rows = rows.withColumn("__folder", parent_path("path"))
    above = rows.select("__folder").distinct().select("__folder", F.explode(ancestor_paths("__folder")).alias("__above"))
    books = rows.filter("kind = 'book'").select(F.col("path").alias("__above"))
    below = above.join(books, "__above", "left_semi").select("__folder").distinct()
    return rows.join(below, "__folder", "left_anti").drop("__folder")
