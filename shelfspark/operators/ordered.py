"""Ordered computations inside groups of any size: numbering, running sums, carry-forward, as-of.

A plain window sends each group to one task, which is wrong for a folder, book or key that holds a
large part of all rows. Here rows are always range-partitioned by group and order, so any group may
be spread over several tasks (blocks). The window runs inside a block, and what the earlier blocks
of the group add is joined from a table of block totals. Neighbouring blocks share at most one
group, hence that table has at most two rows per block and is safe to broadcast. There is one way
for all sizes: the only job that runs while the plan is built is the one that writes the blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import checkpointed, shuffle_partitions

BLOCK = "__block"


@dataclass
class Ordered:
    """Rows with a block number."""

    df: DataFrame
    group: list[str]
    order: list[Column]

    def window(self):
        return Window.partitionBy(*self.group, BLOCK).orderBy(*self.order)

    def plain(self) -> DataFrame:
        return self.df.drop(BLOCK)


def ordered(df: DataFrame, group: list[str], order: list[Column]) -> Ordered:
    """Prepare rows for the functions below. ``order`` must be total inside a group."""
    n = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *[F.col(g) for g in group], *order)
    # The range bounds come from a sample, so the blocks are written once and then only read.
    return Ordered(checkpointed(ranged.withColumn(BLOCK, F.spark_partition_id())), group, order)


def _with_offsets(rows: Ordered, total: Column, merge, name: str) -> DataFrame:
    """Join ``merge(total, window of earlier blocks)`` of each block that is not the first of its group."""
    keys = [*rows.group, BLOCK]
    totals = rows.df.groupBy(*keys).agg(total.alias("__total"))
    earlier = Window.partitionBy(*rows.group).orderBy(BLOCK)
    whole = Window.partitionBy(*rows.group)
    if not rows.group:
        # One row per block: a bounded table, so a single-task window over it is fine.
        earlier, whole = Window.orderBy(BLOCK), Window.partitionBy()
    offsets = (
        totals.withColumn("__blocks", F.count(F.lit(1)).over(whole))
        .filter("__blocks > 1")
        .withColumn(name, merge("__total", earlier.rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, name)
    )
    # Null-safe equality: a null group is a group too.
    offsets = offsets.select(*[F.col(k).alias(f"__o_{k}") for k in keys], name)
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__o_{k}"))
    joined = rows.df.join(F.broadcast(offsets), condition, "left")
    return joined.drop(*[f"__o_{k}" for k in keys])


def number_rows(rows: Ordered, name: str) -> Ordered:
    """1-based position of each row in its group."""
    number = F.row_number().over(rows.window()).cast("long")
    merge = lambda c, w: F.sum(c).over(w)
    df = _with_offsets(rows, F.count(F.lit(1)), merge, "__offset")
    df = df.withColumn(name, number + F.coalesce("__offset", F.lit(0))).drop("__offset")
    return Ordered(df, rows.group, rows.order)


def running_sum(rows: Ordered, value: Column, name: str) -> Ordered:
    """Sum of ``value`` from the first row of the group up to and including each row.

    Nulls count nothing; before the first value that is not null the sum is null.
    """
    inside = F.sum(value).over(rows.window().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merge = lambda c, w: F.sum(c).over(w)
    df = _with_offsets(rows, F.sum(value), merge, "__offset").withColumn("__inside", inside)
    both = F.coalesce(F.col("__inside") + F.col("__offset"), "__inside", "__offset")
    return Ordered(df.withColumn(name, both).drop("__offset", "__inside"), rows.group, rows.order)


def carry_forward(rows: Ordered, value: Column, name: str) -> Ordered:
    """Last value that is not null, at or before each row of the group."""
    upto = rows.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Position inside a block, to take the last value of the block by a plain aggregate.
    marked = rows.df.withColumn("__at", F.row_number().over(rows.window())).withColumn("__value", value)
    prepared = Ordered(marked, rows.group, rows.order)
    last = F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("__at")))
    merge = lambda c, w: F.last(c, ignorenulls=True).over(w)
    df = _with_offsets(prepared, last, merge, "__carried")
    inside = F.last("__value", ignorenulls=True).over(upto)
    df = df.withColumn(name, F.coalesce(inside, F.col("__carried"))).drop("__carried", "__at", "__value")
    return Ordered(df, rows.group, rows.order)


def as_of(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_on: str,
    right_on: str,
    payload: str,
    tie: list[str],
) -> DataFrame:
    """Each left row with the ``payload`` of the last right row at or before it.

    Both sides are laid on one axis and the payload is carried forward, so the cost is one sort and
    no key, however large, is multiplied. ``tie`` orders right rows at one position; left rows
    without a match keep a null payload. ``payload`` must not be null in ``right``.
    """
    names = left.columns
    l = left.select(
        *by, F.col(left_on).alias("__pos"), F.lit(1).alias("__side"), F.struct(*names).alias("__row"),
        F.lit(None).cast(right.schema[payload].dataType).alias(payload),
        *[F.lit(None).cast(right.schema[t].dataType).alias(f"__tie{i}") for i, t in enumerate(tie)],
    )
    r = right.select(
        *by, F.col(right_on).alias("__pos"), F.lit(0).alias("__side"),
        F.lit(None).cast(l.schema["__row"].dataType).alias("__row"), payload,
        *[F.col(t).alias(f"__tie{i}") for i, t in enumerate(tie)],
    )
    both = l.unionByName(r)
    order = [F.col("__pos"), F.col("__side"), *[F.col(f"__tie{i}") for i in range(len(tie))], F.xxhash64("__row")]
    found = carry_forward(ordered(both, by, order), F.col(payload), "__found").plain()
    kept = found.filter("__side = 1")
    return kept.select("__row.*", F.col("__found").alias(payload))
