"""Folder structure of a file listing: folders, parents, counts. Paths are relative to the root ''."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import ROOT_NAME
from shelfspark.functions.paths import ancestor_paths, parent_path, path_name


def folders_of(files: DataFrame, path: str = "path") -> DataFrame:
    """Every folder above a file, and the root even for an empty listing.

    Folders are made distinct before their ancestors are unrolled, so the unrolled rows grow with
    the folders and not with the files.
    """
    root = files.sparkSession.range(1).select(F.lit("").alias("folder"))
    direct = files.select(parent_path(path).alias("folder")).distinct()
    return direct.select(F.explode(ancestor_paths("folder")).alias("folder")).union(root).distinct()


def folder_edges(folders: DataFrame) -> DataFrame:
    """Rows (folder, subfolder): the direct children of each folder."""
    return folders.filter("folder <> ''").select(
        parent_path("folder").alias("folder"), F.col("folder").alias("subfolder")
    )


def folder_structure(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per folder: name, number of direct books and of direct subfolders."""
    folders = folders_of(files, path)
    books = files.groupBy(parent_path(path).alias("folder")).agg(F.count(F.lit(1)).alias("book_count"))
    children = folder_edges(folders).groupBy("folder").agg(F.count(F.lit(1)).alias("folder_count"))
    return (
        folders.join(books, "folder", "left")
        .join(children, "folder", "left")
        .select(
            "folder",
            F.when(F.col("folder") == "", F.lit(ROOT_NAME)).otherwise(path_name("folder")).alias("name"),
            F.coalesce("folder_count", F.lit(0)).alias("folder_count"),
            F.coalesce("book_count", F.lit(0)).alias("book_count"),
        )
    )
