"""Shards by a Feistel permutation of global row numbers, with cycle walking.

Rows are numbered 0 to N - 1 in the order of their key, so the numbers depend on the rows alone. A
balanced Feistel network permutes the smallest range of an even number of bits that holds N; a value
beyond N is permuted again until it falls below (a walk along its cycle, which always ends as the
cycle starts below N). The permuted number p gives shard ``p % shards`` and slot ``p // shards``:
shard sizes differ by one at most, slots have no gaps, and anyone who knows N, the seed and a row
number can compute the place of a row, and back (``unpermute``).

The numbering sorts keys only, spread over all tasks by range; texts are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.numbering import numbered

ROUNDS = 6
# Modulus and multipliers of the round function (fixed values).
PRIME = 2_147_483_647
STEP, START, CURVE = 1_103_515_245, 12_345, 69_069


def half_bits(n: int) -> int:
    """Bits of one half of the smallest balanced range that holds 0 to n - 1."""
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, seed: int, number: int, mask: int) -> np.ndarray:
    shift = (seed * CURVE + (number + 1) * STEP + START) % PRIME
    mixed = (half * (STEP % PRIME) + shift) % PRIME
    return ((mixed * mixed + shift) % PRIME >> 3) & mask


def _pass(values: np.ndarray, bits: int, seed: int, backwards: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = values >> bits, values & mask
    for number in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        if backwards:
            left, right = right ^ _round(left, seed, number, mask), left
        else:
            left, right = right, left ^ _round(right, seed, number, mask)
    return left << bits | right


def permute(values: np.ndarray, n: int, seed: int, backwards: bool = False) -> np.ndarray:
    """Permutation of 0 to n - 1 (n up to 2 ** 62), or its inverse."""
    bits = half_bits(n)
    out = _pass(np.asarray(values, dtype=np.int64), bits, seed, backwards)
    while (beyond := np.flatnonzero(out >= n)).size:
        out[beyond] = _pass(out[beyond], bits, seed, backwards)
    return out


def unpermute(values: np.ndarray, n: int, seed: int) -> np.ndarray:
    return permute(values, n, seed, backwards=True)


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, row_number, shard, slot.

    ``size`` is the length of the text in bytes plus 1, 1 for null, whose check sum is that of an
    empty text. Rows are numbered by key (null first), check sum and size, so repeated keys with
    different texts have a fixed order, and of equal rows it does not matter. A text counts whole, however
    long; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col(key).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"], "row_number")

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for numbers in batches:
            yield pd.Series(permute(numbers.to_numpy(), n, seed))

    rows = rows.withColumn("place", place("row_number"))
    return rows.select(
        "doc_id", "size", "text_crc32", "row_number",
        (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"),
    )
