"""Rows made in Python tasks, handed to Spark in frames of bounded size."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MAX_ROWS, MAX_BYTES = 4096, 16 * 1024 * 1024
# Rows that are Python objects at one time in ``map_rows``, and bytes of texts that are held for its output.
PIECE_ROWS, PIECE_BYTES = 256, 4 * 1024 * 1024


def field_names(schema: str) -> list[str]:
    """Top-level field names of a schema text."""
    names, depth, field = [], 0, ""
    for char in schema + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            names.append(field.split()[0].strip("`"))
            field = ""
        else:
            field += char
    return names


def frames(rows: Iterable[tuple], schema: str) -> Iterator[pd.DataFrame]:
    """Frames of at most 4096 rows, or of about 16 MiB of texts and bytes."""
    names, held, size = field_names(schema), [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= MAX_ROWS or size >= MAX_BYTES:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=names)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Named tuples of the rows; only a piece of a batch becomes Python objects at a time."""
    for batch in batches:
        row = namedtuple("Row", batch.schema.names)
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield from map(row._make, zip(*(column.to_pylist() for column in batch.slice(at, PIECE_ROWS).columns)))


def pieces(batches: Iterable[pa.RecordBatch], make: Callable[[Iterator[tuple]], Iterable[tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows ``make`` gives for the rows of the batches, in small batches that leave as soon as they are full."""
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
    for row in make(_rows(batches)):
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= PIECE_ROWS or size >= PIECE_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def map_rows(df: DataFrame, make: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that ``make`` gives for the rows of each task, as a Python task of bounded memory.

    Of an input batch, which Spark fills with up to 10,000 rows, only a piece is unpacked at a time.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: pieces(batches, make, arrow), schema)
