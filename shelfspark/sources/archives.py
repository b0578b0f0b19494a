"""Members of zip and tar archives. RAR and 7z are recognised but have no reader here.

Input rows have ``path`` and either ``content`` (bytes) or ``full_path``. With a path only the
directory of an archive and the wanted members are read.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import ARCHIVE_MAGIC, TAR_MARK, TAR_MARK_OFFSET
from shelfspark.functions.frames import map_rows
from shelfspark.functions.text import col


def archive_type(content: Column | str) -> Column:
    """zip, rar, 7z or tar by the leading bytes, whatever the extension; null otherwise."""
    head = F.hex(F.substring(col(content), 1, 4))
    mark = F.hex(F.substring(col(content), TAR_MARK_OFFSET + 1, 5))
    out = F.when(F.lit(False), F.lit(""))
    for name, magic in ARCHIVE_MAGIC.items():
        out = out.when(head == magic, name)
    return out.when(mark == TAR_MARK, "tar")


class Archive:
    """One open archive: names of its files, and bytes of one of them."""

    def __init__(self, source: str | bytes):
        self.file = io.BytesIO(source) if isinstance(source, (bytes, bytearray)) else open(source, "rb")
        head = self.file.read(TAR_MARK_OFFSET + 5)
        self.zip = self.tar = None
        if head[:4].hex().upper() == ARCHIVE_MAGIC["zip"]:
            self.zip = zipfile.ZipFile(self.file)
        elif head[TAR_MARK_OFFSET:].hex() == TAR_MARK:
            self.file.seek(0)
            self.tar = tarfile.open(fileobj=self.file)

    def names(self) -> list[str]:
        if self.zip:
            return [n for n in self.zip.namelist() if not n.endswith("/")]
        return [m.name for m in self.tar.getmembers() if not m.isdir()] if self.tar else []

    def open(self, name: str):
        """A member as an open file; null if it is not there."""
        return self.zip.open(name) if self.zip else self.tar.extractfile(name) if self.tar else None

    def read(self, name: str) -> bytes | None:
        """Bytes of a member; a missing or empty one gives None."""
        return self.data(name) or None

    def data(self, name: str) -> bytes | None:
        """Bytes of a member, none of an empty one; a missing one or a directory gives None."""
        try:
            if self.zip:
                return None if self.zip.getinfo(name).is_dir() else self.zip.read(name)
            member = self.tar.extractfile(name) if self.tar else None
            return member.read() if member else None
        except (KeyError, OSError, RuntimeError, zipfile.BadZipFile, tarfile.TarError):
            return None


def open_archive(source: str | bytes) -> Archive | None:
    try:
        return Archive(source)
    except (OSError, EOFError, ValueError, zipfile.BadZipFile, tarfile.TarError):
        return None


def source_column(files: DataFrame) -> str:
    return "content" if "content" in files.columns else "full_path"


def map_archives(files: DataFrame, read, schema: str) -> DataFrame:
    """Rows of ``read(row, archive)`` for each archive; an unreadable one gives no rows."""
    source = source_column(files)

    def rows(found: Iterator[tuple]) -> Iterator[tuple]:
        for row in found:
            archive = open_archive(getattr(row, source)) if getattr(row, source) is not None else None
            if archive:
                with archive.file:
                    yield from read(row, archive)

    return map_rows(files, rows, schema)


def archive_members(files: DataFrame) -> DataFrame:
    """Rows (path, pos, member), directories left out."""
    listed = lambda row, archive: ((row.path, i, name) for i, name in enumerate(archive.names()))
    return map_archives(files.select("path", source_column(files)), listed, "path string, pos int, member string")


def read_members(files: DataFrame, wanted: str = "wanted", empty: bool = False) -> DataFrame:
    """Rows (path, member, data) of the members named in an array column; data may be null.

    With ``empty`` the data of an empty member are empty, else they are null like those of a missing one.
    """
    found = lambda archive, name: archive.data(name) if empty else archive.read(name)
    read = lambda row, archive: ((row.path, name, found(archive, name)) for name in getattr(row, wanted))
    return map_archives(files.select("path", source_column(files), wanted), read, "path string, member string, data binary")


# Texts are read in pieces of this size until the wanted end is found.
PIECE = 1 << 16


def _upto(file, end: bytes | None) -> bytes:
    """The bytes of an open file, up to and including the first ``end`` if it is there."""
    if end is None:
        return file.read()
    out = bytearray()
    while piece := file.read(PIECE):
        seen = max(0, len(out) - len(end))
        out += piece
        at = out.find(end, seen)
        if at >= 0:
            return bytes(out[: at + len(end)])
    return bytes(out)


def book_texts(files: DataFrame, end: str | None = None) -> DataFrame:
    """Rows (path, text) of FB2 books: plain files, or the first ``.fb2`` member of an archive.

    With ``end`` a book is read only up to its first occurrence, also inside an archive.
    """
    source, stop = source_column(files), None if end is None else end.encode()

    def opened(found, path: str):
        if path.lower().endswith((".fbz", ".fb2.zip")):
            archive = open_archive(found)
            names = [n for n in archive.names() if n.lower().endswith(".fb2")] if archive else []
            return archive.open(names[0]) if names else None
        return io.BytesIO(found) if isinstance(found, (bytes, bytearray)) else open(found, "rb")

    def rows(books: Iterator[tuple]) -> Iterator[tuple]:
        for row in books:
            found, data = getattr(row, source), None
            try:
                file = opened(found, row.path) if found is not None else None
                if file is not None:
                    with file:
                        data = _upto(file, stop)
            except (OSError, EOFError, KeyError, RuntimeError, ValueError, zipfile.BadZipFile, tarfile.TarError, zlib.error):
                data = None
            yield row.path, data.decode("utf-8", "replace").removeprefix("\ufeff") if data else None

    return map_rows(files.select("path", source), rows, "path string, text string")
