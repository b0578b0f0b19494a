"""Searches of a set of query vectors against all vectors, in blocks of bounded size.

Vectors are dealt to slices and queries to blocks. Each pair (query block, slice) is one group of a
cogroup: it holds at most about ``QUERY_ROWS`` queries and ``SLICE_ROWS`` vectors of one length,
however large or repetitive the table is, and returns at most k rows per query. The k best of all slices are then
chosen per query. Vectors are copied once per query block and queries once per slice; nothing is
broadcast or collected but two counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 4096
QUERY_ROWS = 8192


def usable(vectors: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """Rows (vec_id, vector of doubles) that can take part.

    Left out are rows with a null id, null vectors, empty ones, those with a null or non-finite component and, unless
    ``zero``, zero vectors.
    """
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), values.alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite))
    if not zero:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    return rows


def search_blocks(
    vectors: DataFrame, is_query: Column, k: int, kernel: Callable, score_type: str, largest: bool,
    key: str, vector: str, zero: bool, slice_rows: int = SLICE_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` of each query, ties to the smaller vec_id.

    ``kernel(query ids, query vectors, ids, vectors)`` yields (query position, positions of vectors,
    scores) for one slice. Vectors of each length are searched among their own. A query's own rows,
    those with its id, take no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector, zero)
    n = rows.count()
    schema = f"query_id long, vec_id long, score {score_type}"
    if not n:
        found = spark.createDataFrame([], schema)
    else:
        n_slices = -(-n // slice_rows)
        # One row per query id: of rows with the same id, the smallest vector asks.
        queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        n_blocks = max(1, -(-queries.count() // query_rows))
        # Dealt by place, so that equal ids are spread as well.
        sliced = rows.withColumn("length", F.size("vector")).withColumn("slice", (F.monotonically_increasing_id() % n_slices).cast("int"))
        sliced = sliced.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        asked = queries.withColumn("length", F.size("vector")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
        asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))

        def arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            values = t.column("vector").combine_chunks()
            return t.column("vec_id").to_numpy(), values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)

        def search(left: pa.Table, right: pa.Table) -> pa.Table:
            asked_ids, found_ids, scores = [], [], []
            if left.num_rows and right.num_rows:
                (ids, xs), (asking, qs) = arrays(left), arrays(right)
                for q, at, values in kernel(asking, qs, ids, xs):
                    asked_ids.append(np.full(len(at), asking[q]))
                    found_ids.append(ids[at])
                    scores.append(values)
            joined = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
            kind = pa.int64() if score_type == "long" else pa.float64()
            return pa.table({"query_id": joined(asked_ids, pa.int64()), "vec_id": joined(found_ids, pa.int64()), "score": joined(scores, kind)})

        found = sliced.groupBy("length", "block", "slice").cogroup(asked.groupBy("length", "block", "slice")).applyInArrow(search, schema)
    best = F.desc("score") if largest else F.asc("score")
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def own_rows(asking: np.ndarray, ids: np.ndarray) -> list[np.ndarray]:
    """Positions in ``ids`` of each asking id."""
    order = np.argsort(ids, kind="stable")
    low, high = (np.searchsorted(ids[order], asking, side) for side in ("left", "right"))
    return [order[a:b] for a, b in zip(low, high, strict=True)]
