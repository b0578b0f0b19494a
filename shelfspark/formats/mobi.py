"""MOBI and AZW: header and EXTH records, metadata, cover record."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import EXTH_TYPES
from shelfspark.formats.common import metadata
from shelfspark.functions.frames import map_rows
from shelfspark.functions.text import clean_description, empty_to_null, tail
from shelfspark.sources.archives import source_column

SCHEMA = (
    "path string, full_name binary, first_image long, file_size long, offsets array<long>, "
    "exth array<struct<type:int,data:binary>>"
)
HEADER_BYTES = 78


def _exth(record: bytes, start: int) -> list[tuple[int, bytes]]:
    """Records of the EXTH block; a truncated record ends the list."""
    if record[start : start + 4] != b"EXTH":
        return []
    count, at, out = struct.unpack_from(">I", record, start + 8)[0], start + 12, []
    for _ in range(count):
        if at + 8 > len(record):
            break
        kind, size = struct.unpack_from(">II", record, at)
        if size < 8 or at + size > len(record):
            break
        out.append((kind, record[at + 8 : at + size]))
        at += size
    return out


class Ranges:
    """Ranged reads of a file, or of bytes that are there already."""

    def __init__(self, source: str | bytes):
        self.data = bytes(source) if isinstance(source, (bytes, bytearray)) else None
        self.file = None if self.data is not None else open(source, "rb")
        self.size = len(self.data) if self.data is not None else os.fstat(self.file.fileno()).st_size

    def read(self, start: int, stop: int) -> bytes:
        if self.data is not None:
            return self.data[start:stop]
        self.file.seek(start)
        return self.file.read(max(0, stop - start))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _parse(source: Ranges) -> tuple | None:
    """What is read is the head, the index of records and record 0, whatever the size of the file."""
    start = source.read(0, HEADER_BYTES)
    records = struct.unpack_from(">H", start, 76)[0] if len(start) >= HEADER_BYTES else 0
    if not records:
        return None
    index = source.read(HEADER_BYTES, HEADER_BYTES + 8 * records)
    offsets = [struct.unpack_from(">I", index, 8 * i)[0] for i in range(records)]
    head = source.read(offsets[0], (offsets + [source.size])[1])
    if head[16:20] != b"MOBI":
        return None
    header_size, title_at, title_size = (struct.unpack_from(">I", head, at)[0] for at in (20, 84, 88))
    first_image, flags = (struct.unpack_from(">I", head, at)[0] for at in (108, 128))
    exth = _exth(head, 16 + header_size) if flags & 0x40 else []
    return head[title_at : title_at + title_size], first_image, source.size, offsets, exth


def _parse_file(source: str | bytes | None) -> tuple | None:
    try:
        ranges = Ranges(source)
    except (OSError, TypeError):
        return None
    try:
        return _parse(ranges)
    except (OSError, struct.error):
        return None
    finally:
        ranges.close()


def mobi_headers(files: DataFrame) -> DataFrame:
    """Header, record offsets and EXTH records of each readable file."""
    source = source_column(files)

    def rows(books: Iterator[tuple]) -> Iterator[tuple]:
        for row in books:
            found = _parse_file(getattr(row, source))
            if found:
                full_name, image, size, offsets, exth = found
                exth = [{"type": t, "data": d} for t, d in exth]
                yield row.path, full_name, image, size, offsets, exth

    return map_rows(files.select("path", source), rows, SCHEMA)


def _utf8(data: Column) -> Column:
    """Text up to the first zero byte; bytes that are not UTF-8 become the replacement character."""
    return F.substring_index(F.make_valid_utf8(data.cast("string")), "\0", 1)


def _values(kind: str) -> Column:
    code = next(c for c, n in EXTH_TYPES.items() if n == kind)
    return F.transform(F.filter("exth", lambda r: r["type"] == code), lambda r: r["data"])


def _last(kind: str) -> Column:
    return _utf8(F.try_element_at(_values(kind), F.lit(-1)))


def _number(kind: str) -> Column:
    return F.conv(F.hex(F.substring(F.try_element_at(_values(kind), F.lit(-1)), 1, 4)), 16, 10).cast("long")


def mobi_metadata(files: DataFrame) -> DataFrame:
    """Rows (path, meta, cover); cover is the number of the record with the image."""
    subjects = F.transform(_values("subject"), _utf8)
    meta = metadata(
        title=F.coalesce(empty_to_null(_last("title")), _utf8(F.col("full_name"))),
        author=_utf8(F.try_element_at(_values("creator"), F.lit(1))),
        description=clean_description(_last("description")),
        publisher=_last("publisher"),
        issued=_last("date"),
        subjects=F.when(F.size(subjects) > 0, subjects),
        rights=_last("rights"),
    )
    image = F.coalesce(_number("cover_offset"), _number("thumbnail_offset")) + F.col("first_image")
    cover = F.when((image >= 0) & (image < F.size("offsets")), image.cast("string"))
    return mobi_headers(files).select("path", meta.alias("meta"), cover.alias("cover"))


def mobi_records(headers: DataFrame) -> DataFrame:
    """Rows (path, record, start, end): a record ends where the next one starts."""
    ends = F.concat(tail(F.col("offsets"), 2), F.array("file_size"))
    spans = F.arrays_zip(F.col("offsets").alias("start"), ends.alias("end"))
    return headers.select("path", F.posexplode(spans).alias("record", "s")).select("path", "record", "s.start", "s.end")
