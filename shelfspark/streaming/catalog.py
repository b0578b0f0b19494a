"""The catalog as a stream job: events in, entries and feeds kept up to date.

Each micro-batch is validated, classified, suppressed, applied to the entries table, and the folders
it touches are rebuilt once, after all its changes; of both tables only the buckets that hold them are rewritten. Events whose handler fails go to a dead-letter
table one by one: the other events of their batch are applied and the stream goes on. When a handler fails, its
changes are first written as they are; if that fails too (storage, lost executors), the query ends and
repeats the batch when it is started again. What handlers did is kept as rows of a structured log. A marker (lost events) rebuilds everything from a listing.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.constants import SUPPRESS_INTERVAL_MS
from shelfspark.functions.paths import relative_to
from shelfspark.operators.events import (
    apply_changes,
    cascade,
    classify,
    delete_subtrees,
    event_path,
    handler_log,
    valid_events,
)
from shelfspark.operators.feeds import order_entries
from shelfspark.plans.sync import plan
from shelfspark.session import checkpointed
from shelfspark.sinks.buckets import BUCKETS, BucketedTable, apply_to_buckets
from shelfspark.sinks.tables import append_log, expire_versions
from shelfspark.sources.files import scan_mirror
from shelfspark.streaming.suppress import replay_batch

OVERFLOW = "IN_Q_OVERFLOW"
# Column of an entry with the time at which it was written, and the shortest interval of resyncs in seconds.
WRITTEN, LEAST_RESYNC = "entry_mtime_ms", 60

# A handler turns the changes of one tag (path, tag, seq) into entry rows, which it may enrich.
Handler = Callable[[DataFrame], DataFrame]


@dataclass
class CatalogStream:
    """Where the tables are and how changes become entries."""

    root: str
    tables: str
    interval: int = SUPPRESS_INTERVAL_MS
    compat: bool = False
    resync: Callable[[SparkSession], DataFrame] | None = None
    handlers: dict[str, Handler] = field(default_factory=dict)
    keep_versions: int = 5
    buckets: int = BUCKETS
    busy: threading.Lock = field(default_factory=threading.Lock, repr=False)

    def register(self, tag: str, handler: Handler) -> None:
        self.handlers[tag] = handler

    def table(self, name: str) -> str:
        return f"{self.tables}/{name}"

    # --- one micro-batch --------------------------------------------------------------------------

    def typed(self, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Lines (seq, ms, value) to (typed events with key and path, rejected lines)."""
        good, bad = valid_events(lines)
        typed = classify(good).withColumn("path", F.lit(None).cast("string"))
        return typed.withColumn("path", relative_to(self.root, event_path())), bad

    def entry_rows(self, changes: DataFrame) -> tuple[DataFrame, list[DataFrame], dict[str, int]]:
        """Changes with their entry columns, each tag through its handler, those that failed, and milliseconds per tag."""
        known, failed, durations = list(self.handlers), [], {}
        rows = changes.filter(~F.col("tag").isin(known)) if known else changes
        for tag, handler in self.handlers.items():
            begun = time.monotonic()
            for part in self.handled(handler, changes.filter(F.col("tag") == tag), failed):
                rows = rows.unionByName(part, allowMissingColumns=True)
            durations[tag] = int(1000 * (time.monotonic() - begun))
        return rows, failed, durations

    def handled(self, handler: Handler, changes: DataFrame, failed: list[DataFrame], whole: bool = True) -> list[DataFrame]:
        """Results of a handler. If it fails, the changes are halved until the failing ones stand alone."""
        try:
            return [checkpointed(handler(changes))]
        except PySparkException as error:
            if whole:
                # Fails as well where the fault is not the handler's.
                changes = checkpointed(changes)
            low, middle, high = changes.agg(F.min("seq"), F.percentile_approx("seq", 0.5), F.max("seq")).first()
            if low == high:
                failed.append(changes.withColumn("error", F.lit(str(error))))
                return []
            cut = middle if middle < high else high - 1
            halves = (changes.filter(F.col("seq") <= cut), changes.filter(F.col("seq") > cut))
            return [part for half in halves for part in self.handled(handler, half, failed, whole=False)]

    def buckets_of(self, spark: SparkSession, name: str) -> BucketedTable:
        """The table of entries or of feeds: rows in buckets of folders."""
        return BucketedTable(spark, self.table(name), buckets=self.buckets)

    def full_rebuild(self, spark: SparkSession) -> None:
        with self.busy:
            self.buckets_of(spark, "entries").rewrite(self.resync(spark).withColumn(WRITTEN, written_ms(None)))
            self.rebuild_feeds(spark, None)

    def rebuild_feeds(self, spark: SparkSession, changes: DataFrame | None) -> None:
        """Feeds of the folders that changes touch replace the old ones; None rebuilds all.

        Feeds of deleted folders, and of the folders below them, go away. Only the buckets of these folders are
        read and written.
        """
        entries, feeds = self.buckets_of(spark, "entries"), self.buckets_of(spark, "feeds")
        listed = lambda rows: order_entries(rows).select("folder", "pos", "kind", "name", "title", "author", "path")
        if changes is None:
            return feeds.rewrite(listed(entries.read()))
        touched = checkpointed(cascade(changes, self.compat).select("folder"))
        deleted = changes.filter("tag = 'FolderDeleted'")
        buckets = feeds.touched(touched.union(feeds.below(deleted)))
        rows = listed(entries.read(entries.touched(touched)).join(touched, "folder", "left_semi"))
        old = feeds.read(buckets)
        if old is not None:
            rows = rows.unionByName(delete_subtrees(old, deleted, "folder").join(touched, "folder", "left_anti"))
        feeds.replace(rows, buckets)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The marker is the whole line or one of the event kinds of a line; a name may contain the word.
        kinds = F.split(F.coalesce(F.get_json_object("value", "$.events"), F.lit("")), ",")
        overflow = F.coalesce((F.trim("value") == OVERFLOW) | F.array_contains(kinds, OVERFLOW), F.lit(False))
        if self.resync is not None and not batch.filter(overflow).limit(1).isEmpty():
            return self.full_rebuild(spark)
        # Without a listing to rebuild from, markers are kept with the rejected lines.
        typed, bad = self.typed(batch.filter(~overflow))
        bad = bad.unionByName(batch.filter(overflow).select(*bad.columns))
        append_log(bad, self.table("rejected"), batch_id)
        accepted = checkpointed(replay_batch(typed, batch_id, self.table("state"), interval=self.interval))
        append_log(accepted.select("seq", "ms", "tag", "path"), self.table("event_log"), batch_id)
        if accepted.isEmpty():
            return None
        changes = accepted.select("path", "tag", "seq")
        with self.busy:
            self.apply(spark, changes, batch_id)
        expire_versions(spark, self.table("state"), self.keep_versions)

    def apply(self, spark: SparkSession, changes: DataFrame, batch_id: int, now_ms: int | None = None, log: str = "handler_log") -> None:
        """Apply changes (path, tag, seq) to the entries and rebuild the feeds that they touch.

        The table ``log`` gets the rows of ``operators.events.handler_log``; the changes of a tag are handled
        together, so their duration is that of all.
        """
        rows, failed, durations = self.entry_rows(changes)
        done = changes
        if failed:
            dead = reduce(DataFrame.unionByName, failed)
            append_log(dead, self.table("dead_letters"), batch_id)
            changes = changes.join(rows.select("seq", "path"), ["seq", "path"], "left_semi")
            done = changes.unionByName(dead, allowMissingColumns=True)
        append_log(handler_log(done, durations, self.compat), self.table(log), batch_id)
        if failed and changes.isEmpty():
            return
        table = self.buckets_of(spark, "entries")
        known = table.read()
        missing = [] if known is None else [f for f in known.schema if f.name not in (*rows.columns, WRITTEN)]
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
        rows = checkpointed(rows.withColumn(WRITTEN, written_ms(now_ms)))
        apply_to_buckets(table, rows)
        self.rebuild_feeds(spark, changes)

    # --- resync -----------------------------------------------------------------------------------

    def resynchronize(self, files: DataFrame, number: int, now_ms: int | None = None) -> bool:
        """Bring the entries in line with a listing (path, size, mtime_ms); False while a batch is being applied.

        The refresh plan of the listing against the entries is applied as one batch, without suppression: entries
        of paths that are gone go, folders without an entry and files newer than theirs get one.
        """
        if not self.busy.acquire(blocking=False):
            return False
        try:
            spark = files.sparkSession
            entries = self.buckets_of(spark, "entries").read()
            if entries is None:
                entries = spark.createDataFrame([], f"path string, kind string, {WRITTEN} double")
            state = checkpointed(scan_mirror(entries))
            actions = checkpointed(plan(files.select("path", "size", "mtime_ms"), state))
            known = state.filter("kind = 'folder'").select("path")
            fresh = actions.filter("action = 'folder' AND path <> ''").join(known, "path", "left_anti")
            wanted = actions.filter("action <> 'folder'").unionByName(fresh)
            tag = F.when(F.col("action") == "delete", "BookDeleted").when(F.col("action") == "folder", "FolderCreated").otherwise("BookCreated")
            changes = checkpointed(wanted.select("path", tag.alias("tag"), F.col("seq").cast("long").alias("seq")))
            if not changes.isEmpty():
                self.apply(spark, changes, number, now_ms, log="resync_log")
            return True
        finally:
            self.busy.release()

    def start_resync(self, spark: SparkSession, listing: Callable[[SparkSession], DataFrame], seconds: int, checkpoint: str):
        """Resynchronize with ``listing(spark)`` at a fixed interval of at least ``LEAST_RESYNC`` seconds; 0 is off.

        A time that comes while the last resync still runs, or while events are applied, is passed over.
        """
        if seconds == 0:
            return None
        if seconds < LEAST_RESYNC:
            raise ValueError(f"resync every {LEAST_RESYNC} seconds at most")
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        run = lambda tick, number: self.resynchronize(listing(tick.sparkSession), number) and None
        return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

    def start(self, lines: DataFrame, checkpoint: str, **trigger):
        """Start on a stream of lines (seq, ms, value); by default all that is there, then stop."""

        writer = lines.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def written_ms(now_ms: int | None) -> Column:
    """Time at which an entry is written."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    return now.cast("double")


def default_entries(changes: DataFrame) -> DataFrame:
    """Entry columns from the path alone; registered handlers replace this per tag."""
    from shelfspark.functions.paths import parent_path, path_name, strip_extension
    from shelfspark.functions.text import normalize_title

    is_folder = F.col("tag").startswith("Folder")
    name = path_name("path")
    return changes.withColumns({
        "folder": parent_path("path"),
        "name": name,
        "kind": F.when(is_folder, "folder").otherwise("book"),
        "title": normalize_title(F.when(is_folder, name).otherwise(strip_extension(name))),
        "author": F.lit(None).cast("string"),
    })
