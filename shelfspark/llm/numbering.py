"""Consecutive numbers over all rows in a given order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.session import checkpointed, shuffle_partitions

# monotonically_increasing_id holds the partition above this bit and the place in it below.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list, name: str) -> tuple[DataFrame, int]:
    """``df`` with 0-based positions in ``order``, and the number of rows.

    Rows are range-partitioned by the order and sorted inside each partition, so a position is the
    place in the partition plus the rows of the partitions before. The rows are written to the
    checkpoint folder once, as the range bounds come from a sample. Ties are spread over partitions by
    an arbitrary last key; their numbers are arbitrary too.
    """
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    n = shuffle_partitions(df.sparkSession)
    ranged = tied.repartitionByRange(n, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    rows = checkpointed(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", PLACE_BITS).alias("__part")
    counts = rows.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    # One row per partition: bounded by the number of partitions.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    held = offsets.collect()
    total = sum(r["__n"] for r in held)
    table = df.sparkSession.createDataFrame([(r["__part"], r["__before"]) for r in held], "__part long, __before long")
    place = F.col("__id").bitwiseAND((1 << PLACE_BITS) - 1)
    joined = rows.withColumn("__part", part).join(F.broadcast(table), "__part")
    return joined.withColumn(name, F.col("__before") + place).drop("__id", "__part", "__before"), total
