"""Embedding whitening: principal components of integer vectors by Jacobi-Davidson, from distributed products.

The covariance is never formed: the solver asks for its products with blocks of vectors, and each is one
Spark job in which every task adds z (z . b) over its centred vectors z. Only sums of (length of a vector) x
(columns of the block) numbers reach the driver, whatever the number of rows. The vectors lie packed in the
checkpoint folder, so a lost executor costs the tasks that it ran.

Centring loses nothing: x - S / n is taken as (x - S div n) - (S mod n) / n, whose first part is an exact
integer however large the common offset is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.jacobi_davidson import leading
from shelfspark.session import checkpointed

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
# Entries are held to this many in size, so that integers stay exact.
LARGEST = 2.0**31
# Eigenvalues below this part of the largest one are taken for zero: whitening cannot divide by them.
NOTHING = 1e-11
PACKED_ROWS = 4096
# Bytes of packed vectors for a task. Every product is a job over all of them, so tasks of next to nothing cost more than their work.
TASK_BYTES = 16 << 20
LONG = 2**63 - 1


def lattice(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, x: the entries as integers. Vectors that are null, empty or hold null or non-finite entries are left out."""
    values = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = vectors.select(F.col(key).alias("vec_id"), values.alias("x"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.filter(F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", finite))
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    return rows.withColumn("x", F.transform("x", lambda c: F.floor(held(c)) + SHIFT))


def integers(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Fit:
    """What the distinct vectors of one length say: ``n`` of them with ``sums``, and the components found."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n for s in self.sums], np.float64) / self.n
        return (x - whole).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each vector, exactly; null beyond 64 bits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n for s in self.sums], np.int64)
        near = x - whole
        bound = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if bound * bound * x.shape[1] <= LONG:
            return ((near * self.n - part) ** 2).sum(axis=1).tolist()
        exact = [sum((a * self.n - b) ** 2 for a, b in zip(row, part.tolist())) for row in near.tolist()]
        return [e if e <= LONG else None for e in exact]


def pack(fit_rows: DataFrame) -> DataFrame:
    """size, x: up to ``PACKED_ROWS`` vectors of one length in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED_ROWS):
                x = integers(batch.column(0).slice(at, PACKED_ROWS)).astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["size", "x"])

    return fit_rows.mapInArrow(run, "size int, x binary")


def summed(packed: DataFrame, part: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """Sum over all packed vectors of ``part(vectors)``, an array of fixed shape. One job."""
    kind, arrow = ("decimal(38,0)", pa.int64()) if exact else ("double", pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for size, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                added = part(np.frombuffer(x, "<i8").reshape(-1, size))
                total = added if total is None else total + added
                if exact:
                    # Sums of 64 bits are handed on before they can overflow.
                    yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), arrow)], ["place", "value"])
                    total = None
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel(), arrow)], ["place", "value"])

    rows = packed.mapInArrow(run, f"place int, value {'long' if exact else 'double'}")
    # As many sums for each task as there are places: few rows, whatever the number of shuffle partitions.
    found = rows.groupBy("place").agg(F.sum(F.col("value").cast(kind)).alias("value")).coalesce(1).toArrow()
    order = np.argsort(found.column("place").to_numpy())
    values = [int(v) for v in found.column("value").to_pylist()] if exact else found.column("value").to_numpy()
    return np.array(values, dtype=object if exact else float)[order]


def tasks_for(count: int, size: int, cores: int) -> int:
    """Tasks for ``count`` vectors of length ``size``: one for each ``TASK_BYTES``, and all cores if every one gets a full pack."""
    return max(-(-count * size * 8 // TASK_BYTES), min(cores, -(-count // PACKED_ROWS)))


def fit_whitening(rows: DataFrame, size: int, count: int, wanted: int = COMPONENTS) -> Fit:
    """Components of the distinct vectors of length ``size`` among ``rows`` (column x), of which there are ``count``."""
    distinct = rows.filter(F.size("x") == size).select("x").distinct()
    packed = checkpointed(pack(distinct.coalesce(tasks_for(count, size, rows.sparkSession.sparkContext.defaultParallelism))))
    counted = summed(packed, lambda x: np.append(x.sum(axis=0), len(x)), exact=True)
    fit = Fit(counted[-1], list(counted[:-1]), np.zeros(0), np.zeros((size, 0)), 0.0, 0.0)
    n, centred = fit.n, fit.centred

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            z = centred(x)
            return z.T @ (z @ block)

        return summed(packed, part).reshape(block.shape) / n

    fit.trace = float(summed(packed, lambda x: (centred(x) ** 2).sum(axis=0)).sum()) / n
    if fit.trace == 0:
        return fit
    values, vectors = leading(product, size, wanted)
    real = values > NOTHING * values[0]
    fit.values, fit.vectors = values[real], vectors[:, real]
    made = fit.whitened
    mean = summed(packed, lambda x: made(x).sum(axis=0)) / n

    def part(x: np.ndarray) -> np.ndarray:
        y = made(x) - mean
        return y.T @ y

    covariance = summed(packed, part).reshape(len(mean), -1) / n
    fit.identity_error = float(np.abs(covariance - np.eye(len(mean))).max())
    return fit


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, wanted: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row of ``vectors`` and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries take no part; all other rows do, with
    equal or null ids too. Vectors of each length are whitened among their own. Repeated vectors count
    once in the fit and are whitened alike. There are at most as many components as the vectors have
    dimensions with variance: directions with an eigenvalue below ``NOTHING`` of the largest one have no
    rows, so a single distinct vector has none, nor has an empty table. Equal eigenvalues have some
    orthonormal basis. Entries of more than 2^31 steps count as 2^31; a deviation beyond 64 bits is null.
    Other columns are not read.
    """
    rows = lattice(vectors, key, vector)
    key_type = vectors.schema[key].dataType.simpleString()
    # One row per length that occurs: as a rule a single one.
    sizes = sorted(map(tuple, rows.groupBy(F.size("x")).count().collect()))
    parts = []
    for size, rows_of_size in sizes:
        fit = fit_whitening(rows, size, rows_of_size, wanted)

        def run(batches: Iterator[pa.RecordBatch], fit: Fit = fit) -> Iterator[pa.RecordBatch]:
            count = len(fit.values)
            for batch in batches:
                if not batch.num_rows or not count:
                    continue
                x = integers(batch.column(1))
                m = len(x)
                each = np.repeat(np.arange(m), count)
                tiled = lambda values, kind: pa.array(np.tile(values, m), kind)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(each)), tiled(np.arange(1, count + 1), pa.int32()), tiled(np.full(count, fit.n), pa.int64()),
                    pa.array(fit.deviations(x), pa.int64()).take(pa.array(each)), pa.array(fit.whitened(x).ravel(), pa.float64()),
                    tiled(fit.values / fit.trace, pa.float64()), tiled(np.full(count, fit.identity_error), pa.float64()),
                ], ["vec_id", *(c.split(" ")[0] for c in OUT.split(", "))])

        parts.append(rows.filter(F.size("x") == size).mapInArrow(run, f"vec_id {key_type}, {OUT}"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], f"vec_id {key_type}, {OUT}")
    return reduce(DataFrame.union, parts)
