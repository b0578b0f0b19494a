"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Codes: the vectors are centred, rotated and cut at zero; the rotations are learned on a bounded
sample of each vector length so that the rotated vectors lie close to the corners of the cube (iterative quantisation).
Several rotations give ``BITS`` bits in all.

Index: a code is split into substrings of one byte, and each substring has its own table from byte to
rows. Two codes at distance r agree in some substring up to r // substrings bits (pigeonhole), so
probing every table with all bytes within t bits finds every code within substrings * (t + 1) - 1.
t grows until that radius holds ``WANTED`` codes of the slice; then all codes as near as the last of
them are compared with the query as floats. Every row is indexed; the search is done per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.blocks import SLICE_ROWS, own_rows, search_blocks, usable

BITS = 256
# Codes per slice that are compared as floats, at least.
WANTED = 320
# Rows that the rotations are learned from: those with the smallest hash of their id.
SAMPLE = 8192
ROUNDS = 25
SEED = 5
FAR = 1 << 20

ALL_BYTES = np.arange(256, dtype=np.uint8)
# Bytes with at most t bits set.
WITHIN = [ALL_BYTES[np.bitwise_count(ALL_BYTES) <= t] for t in range(9)]


def learn(sample: np.ndarray, bits: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and rotations side by side as one matrix with ``bits`` columns."""
    mean = sample.mean(axis=0)
    centred, size, random = sample - mean, sample.shape[1], np.random.default_rng(seed)
    rotations = []
    for _ in range(-(-bits // size)):
        rotation = np.linalg.qr(random.normal(size=(size, size)))[0]
        for _ in range(ROUNDS):
            corners = np.where(centred @ rotation > 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(corners.T @ centred)
            rotation = (u @ v).T
        rotations.append(rotation)
    return mean, np.concatenate(rotations, axis=1)[:, :bits]


class SubstringTables:
    """For each byte of the codes: rows in the order of that byte, and where each value starts."""

    def __init__(self, codes: np.ndarray):
        n, self.width = codes.shape
        self.codes = codes
        self.rows = np.concatenate([np.argsort(codes[:, j], kind="stable") for j in range(self.width)])
        starts = [np.searchsorted(np.sort(codes[:, j]), np.arange(257)) + j * n for j in range(self.width)]
        self.starts = np.stack(starts)

    def probe(self, code: np.ndarray, within: int) -> np.ndarray:
        """Rows that agree with ``code`` in some byte up to ``within`` bits."""
        values = code[:, None] ^ WITHIN[within][None, :]
        tables = np.arange(self.width)[:, None]
        low = self.starts[tables, values].ravel()
        count = self.starts[tables, values.astype(np.int64) + 1].ravel() - low
        ends = np.cumsum(count)
        at = np.repeat(low - (ends - count), count) + np.arange(ends[-1])
        met = np.zeros(len(self.codes), dtype=bool)
        met[self.rows[at]] = True
        return np.flatnonzero(met)

    def within_radius(self, code: np.ndarray, own: np.ndarray, wanted: int) -> np.ndarray:
        """All rows but ``own`` within the smallest Hamming radius that holds ``wanted`` of them."""
        for t in range(9):
            rows = self.probe(code, t)
            far = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1, dtype=np.int64)
            far[np.isin(rows, own)] = FAR
            complete = self.width * (t + 1) - 1
            inside = far <= complete
            if inside.sum() >= wanted or t == 8:
                rows, far = rows[inside], far[inside]
                if len(rows) > wanted:
                    rows = rows[far <= np.partition(far, wanted - 1)[wanted - 1]]
                return rows
        raise AssertionError("a byte has eight bits")


def nearest_kernel(k: int, learnt: dict[int, tuple[np.ndarray, np.ndarray]], wanted: int):
    def kernel(asking, qs, ids, xs) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        mean, rotations = learnt[xs.shape[1]]
        encode = lambda v: np.packbits((v - mean) @ rotations > 0, axis=1)
        tables, codes = SubstringTables(encode(xs)), encode(qs)
        for i, own in enumerate(own_rows(asking, ids)):
            rows = tables.within_radius(codes[i], own, max(k, wanted))
            score = np.sqrt(((xs[rows] - qs[i]) ** 2).sum(axis=1))
            best = np.lexsort((ids[rows], score))[:k]
            yield i, rows[best], score[best]

    return kernel


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 10, bits: int = BITS, wanted: int = WANTED, sample: int = SAMPLE,
    key: str = "vec_id", vector: str = "embedding", slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: about the k nearest by Euclidean distance, nearest first.

    Rows with a null id, a null, empty or zero vector, null or non-finite components take no part.
    Vectors of each length are searched among their own. Rows with the query's id are its own. Repeated rows are candidates each, and a
    repeated query id asks once, with its smallest vector. An empty table gives no rows; a table of
    fewer than k others gives all of them. Other columns are not read.
    """
    rows = usable(vectors, key, vector, False)
    learnt = {}
    for length in sorted(r["size"] for r in rows.select(F.size("vector").alias("size")).distinct().collect()):
        picked = rows.filter(F.size("vector") == length).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
        learnt[length] = learn(np.array([r["vector"] for r in picked.select("vector").collect()]), bits)
    kernel = nearest_kernel(k, learnt, wanted)
    return search_blocks(vectors, is_query, k, kernel, "double", False, key, vector, False, slice_rows)
