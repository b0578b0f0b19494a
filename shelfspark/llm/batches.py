"""Arrow batches cut to a bounded number of text bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTES = 4 << 20


def cut(batches: Iterable[pa.RecordBatch], column: int, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes in a text column; a longer text has a batch of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(lengths) // size
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(edges, edges[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)
