"""Registry of extractors: extension to a job over the files with that extension."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.formats.comic import comic_metadata
from shelfspark.formats.common import metadata
from shelfspark.formats.epub import epub_metadata
from shelfspark.formats.fb2 import fb2_metadata
from shelfspark.formats.mobi import mobi_metadata
from shelfspark.functions.paths import format_extension
from shelfspark.session import written

Extractor = Callable[[DataFrame], DataFrame]

_EXTRACTORS: dict[str, Extractor] = {}


def register(extensions: list[str], extractor: Extractor) -> None:
    """Add an extractor: files (path and content or full_path) to rows (path, meta, cover)."""
    for extension in extensions:
        _EXTRACTORS[extension.lower()] = extractor


register(["epub"], epub_metadata)
# RAR and 7z comics have no reader: they get no row here and so an entry with empty metadata.
register(["cbz", "cbr", "cb7", "cbt", "zip"], comic_metadata)
# ``.fb2.zip`` goes to the FB2 job, by its double extension.
register(["fb2", "fbz", "fb2.zip"], fb2_metadata)
register(["mobi", "azw", "azw3"], mobi_metadata)


def extract_metadata(files: DataFrame) -> DataFrame:
    """Files with ``meta`` and ``cover``. Unknown formats and failed files keep empty metadata.

    The files are written once and read by the job of each format, so they are not made or listed again for each.
    """
    files = written(files, "files")
    typed = files.withColumn("__format", format_extension("path"))
    by_job: dict[Extractor, list[str]] = {}
    for extension, job in _EXTRACTORS.items():
        by_job.setdefault(job, []).append(extension)
    # Files of one format are spread anew: sizes differ widely and listings are not balanced.
    parts = [
        job(typed.filter(F.col("__format").isin(extensions)).drop("__format").repartition(F.hash("path")))
        for job, extensions in by_job.items()
    ]
    found = reduce(DataFrame.unionByName, parts)
    rows = files.join(found, "path", "left")
    return rows.withColumn("meta", F.coalesce("meta", metadata()))
