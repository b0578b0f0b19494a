"""Exact top-k by integer inner product over vector-approximation files.

Each slice of vectors is quantised to ``BITS`` bits per component on a grid of its own. A scan of
the cells bounds every inner product from both sides. The k-th largest lower bound rules most vectors
out; the exact vectors of the others are read in the order of their upper bounds, in growing steps,
until no unread vector can reach the k-th exact score. The result is exact, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame

from shelfspark.llm.blocks import SLICE_ROWS, own_rows, search_blocks

BITS = 6
SCALE = 1024.0
STEP = 64
# Whole numbers up to here are exact as doubles.
EXACT = 1 << 53
LONG = 1 << 63


def approximate(xs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells (one byte or two per component), and low edge, width and half width of the cells."""
    low, high = xs.min(axis=0), xs.max(axis=0)
    width = np.maximum(1, np.ceil((high - low + 1) / (1 << bits)))
    cells = ((xs - low) // width).astype(np.uint8 if bits <= 8 else np.uint16)
    return cells, low, width, (width - 1) / 2


def certain_top(query: np.ndarray, upper: np.ndarray, spread: float, xs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and exact scores of all vectors that may be among the k best. ``-inf`` bounds take no part."""
    open_rows = np.flatnonzero(upper > -np.inf)
    if len(open_rows) > k:
        kth_lower = np.partition(upper, -k)[-k] - 2 * spread
        open_rows = np.flatnonzero(upper >= kth_lower)
    open_rows = open_rows[np.argsort(-upper[open_rows], kind="stable")]
    at, scores, step = 0, np.zeros(0), 4 * k
    while at < len(open_rows):
        if len(scores) >= k and upper[open_rows[at]] < np.partition(scores, -k)[-k]:
            break
        scores = np.concatenate([scores, xs[open_rows[at : at + step]] @ query])
        at, step = at + step, 2 * step
    return open_rows[: len(scores)], scores


def inner_product_kernel(k: int, bits: int):
    def kernel(asking, qs, ids, xs) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        q, x = np.floor(qs * SCALE), np.floor(xs * SCALE)
        own = own_rows(asking, ids)
        if float(np.abs(q).max()) * float(np.abs(x).max()) * x.shape[1] >= EXACT:
            yield from by_whole_numbers(q, x, own, ids, k)
            return
        cells, low, width, half = approximate(x, bits)
        centres = low + cells * width + half
        for start in range(0, len(q), STEP):
            part = q[start : start + STEP]
            spreads = np.abs(part) @ half
            uppers = part @ centres.T + spreads[:, None]
            for i, upper in enumerate(uppers):
                upper[own[start + i]] = -np.inf
                at, scores = certain_top(part[i], upper, spreads[i], x, k)
                best = np.lexsort((ids[at], -scores))[:k]
                yield start + i, at[best], scores[best].astype(np.int64)

    return kernel


def by_whole_numbers(q, x, own, ids, k) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For components too large for doubles: Python's whole numbers, cut to 64 bits at the end."""
    whole = [[int(v) for v in row] for row in x]
    for i, query in enumerate(q):
        query, skip = [int(v) for v in query], set(own[i].tolist())
        scored = [(-sum(a * b for a, b in zip(query, row, strict=True)), ids[j], j) for j, row in enumerate(whole) if j not in skip]
        best = sorted(scored)[:k]
        values = [max(-LONG, min(LONG - 1, -s)) for s, _, _ in best]
        yield i, np.array([j for _, _, j in best], dtype=np.int64), np.array(values, dtype=np.int64)


def top_inner_products(
    vectors: DataFrame, is_query: Column, k: int = 10, bits: int = BITS, key: str = "vec_id", vector: str = "embedding",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(1024 x) vectors.

    Rows with a null id, a null or empty vector, null or non-finite components take no part. Vectors
    of each length are searched among their own. Rows with the query's id are its own. Repeated rows are candidates each, and a
    repeated query id asks once, with its smallest vector. Scores beyond 64 bits are cut to them.
    An empty table gives no rows; other columns are not read.
    """
    kernel = inner_product_kernel(k, bits)
    return search_blocks(vectors, is_query, k, kernel, "long", True, key, vector, True, slice_rows)
