"""``change_events``: a data source for change logs, in batch and as a stream.

A log is a directory of files of JSON lines, one event each, which are written in the order of their names:
a file is appended to until the next one begins. The position of a line is the number of bytes of the log
before it; it is the event's ``seq``, the same in every run. An offset of the stream is such a position,
always at the end of a line, so a line that is still being written is left for the next batch.

The log is read in ranges of ``partBytes`` bytes, which fall on any byte: a range has the lines that begin in it.
Options: ``path``, ``partBytes`` (default 64 MiB). A micro-batch takes all whole lines that are there, in ranges.
Lines are handed on as they are; ``operators.events.valid_events`` tells the good ones.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "change_events"
SCHEMA = "seq long, ms long, value string"
PART_BYTES = 64 << 20
TAIL = 1 << 16


class Range(InputPartition):
    """Lines of ``file`` that begin at bytes from ``start`` up to ``stop``; ``before`` bytes of the log lie before the file."""

    def __init__(self, file: str, start: int, stop: int, before: int):
        self.file, self.start, self.stop, self.before = file, start, stop, before


def log_files(path: str) -> list[tuple[str, int]]:
    """Files of a log in order, with their sizes; hidden ones left out."""
    names = sorted(n for n in os.listdir(path) if not n.startswith((".", "_")))
    return [(f"{path}/{n}", os.path.getsize(f"{path}/{n}")) for n in names if os.path.isfile(f"{path}/{n}")]


def whole_lines(file: str, size: int) -> int:
    """Bytes of a file up to the end of its last whole line."""
    with open(file, "rb") as log:
        stop = size
        while stop > 0:
            start = max(0, stop - TAIL)
            log.seek(start)
            at = log.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


def log_end(path: str) -> int:
    """Position behind the last whole line of the log. In all files but the last one, the last line is whole as it is."""
    files = log_files(path)
    if not files:
        return 0
    return sum(size for _, size in files[:-1]) + whole_lines(*files[-1])


def ranges(path: str, start: int, stop: int, part_bytes: int) -> list[Range]:
    """The log from one position to another, in ranges of one file each."""
    out, before = [], 0
    for file, size in log_files(path):
        low, high = max(start - before, 0), min(stop - before, size)
        out += [Range(file, at, min(at + part_bytes, high), before) for at in range(low, high, part_bytes)]
        before += size
    return out


def read_range(part: Range) -> Iterator[tuple[int, int, str]]:
    with open(part.file, "rb") as log:
        ms = int(os.fstat(log.fileno()).st_mtime * 1000)
        # A line that begins before the range belongs to the range before.
        if part.start > 0:
            log.seek(part.start - 1)
            log.readline()
        at = log.tell() if part.start > 0 else 0
        while at < part.stop:
            line = log.readline()
            if not line:
                break
            text = line.rstrip(b"\r\n").decode("utf-8", "replace")
            if text:
                yield part.before + at, ms, text
            at += len(line)


class BatchReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[Range]:
        return ranges(self.path, 0, sum(size for _, size in log_files(self.path)), self.part_bytes)

    def read(self, partition: Range) -> Iterator[tuple[int, int, str]]:
        return read_range(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def initialOffset(self) -> dict:
        return {"bytes": 0}

    def latestOffset(self) -> dict:
        return {"bytes": log_end(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.path, start["bytes"], end["bytes"], self.part_bytes)

    def read(self, partition: Range) -> Iterator[tuple[int, int, str]]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        pass


class ChangeEventSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _settings(self) -> tuple[str, int]:
        return self.options["path"].removeprefix("file:"), int(self.options.get("partBytes", PART_BYTES))

    def reader(self, schema) -> BatchReader:
        return BatchReader(*self._settings())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._settings())


def read_events(spark: SparkSession, path: str, stream: bool = False, **options) -> DataFrame:
    """Lines (seq, ms, value) of a change log; ``ms`` is the time of the last change of its file."""
    spark.dataSource.register(ChangeEventSource)
    reader = (spark.readStream if stream else spark.read).format(NAME)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.option("path", path).load()
