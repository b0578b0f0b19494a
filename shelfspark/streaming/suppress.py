"""Suppression of repeated events in a stream.

Two clocks. *Live*: processing time, one state value per key that expires when the key is idle.
*Replay*: the time column of the events, so that a replayed stream and the batch form give equal
rows; it runs per micro-batch on the batch form, which spreads large keys over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfspark.constants import SUPPRESS_IDLE_MS, SUPPRESS_INTERVAL_MS
from shelfspark.operators.events import suppress
from shelfspark.sinks.tables import publish, read_version, version_before

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LiveSuppressor(StatefulProcessor):
    """Lets an event of a key through if the last one let through is an interval ago."""

    def __init__(self, columns: list[str], seq: str, interval: int, idle: int):
        self.columns, self.seq, self.interval, self.idle = columns, seq, interval, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last_ms long", ttlDurationMs=self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Rows of one micro-batch arrive at one time, so at most the first of them can pass.
        first = None
        for pdf in rows:
            top = pdf.nsmallest(1, self.seq)
            if first is None or top[self.seq].iloc[0] < first[self.seq].iloc[0]:
                first = top
        now = timerValues.getCurrentProcessingTimeInMs()
        if first is not None and (not self.last.exists() or now - self.last.get()[0] >= self.interval):
            self.last.update((now,))
            yield first[self.columns]

    def close(self) -> None:
        pass


def suppress_live(
    events: DataFrame, key: str = "key", seq: str = "seq", interval: int = SUPPRESS_INTERVAL_MS, idle: int = SUPPRESS_IDLE_MS
) -> DataFrame:
    """Accepted events of a stream by arrival time. Needs the RocksDB state store (``STATE_PROVIDER``).

    With a trigger that ends by itself, switch ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    processor = LiveSuppressor(events.columns, seq, interval, max(idle, interval))
    return events.groupBy(key).transformWithStateInPandas(
        processor, outputStructType=events.schema, outputMode="Append", timeMode="ProcessingTime"
    )


def replay_batch(
    batch: DataFrame, batch_id: int, state_table: str, key: str = "key", ms: str = "ms", seq: str = "seq",
    interval: int = SUPPRESS_INTERVAL_MS,
) -> DataFrame:
    """Accepted events of one micro-batch; the state table (key, last_ms) gets a version per batch.

    State is read from the latest version before this batch, so a repeated batch gives the same rows and
    a batch without events in between loses nothing.
    """
    spark = batch.sparkSession
    before = version_before(spark, state_table, "v", batch_id)
    state = read_version(spark, state_table, before) if before else None
    accepted = suppress(batch, key, ms, seq, interval, state=state)
    last = accepted.groupBy(F.col(key).alias("key")).agg(F.max(F.col(ms).cast("long")).alias("last_ms"))
    if state is not None:
        last = state.unionByName(last).groupBy("key").agg(F.max("last_ms").alias("last_ms"))
    publish(last, state_table, f"v{batch_id}")
    return accepted


def suppress_replay(
    events: DataFrame, state_table: str, write: Callable[[DataFrame, int], None], checkpoint: str,
    key: str = "key", ms: str = "ms", seq: str = "seq", interval: int = SUPPRESS_INTERVAL_MS,
):
    """Start a stream that hands the accepted events of each micro-batch to ``write(rows, batch_id)``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(replay_batch(batch, batch_id, state_table, key, ms, seq, interval), batch_id)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
