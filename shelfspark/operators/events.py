"""Events as tables: classification, keys, suppression, coalescing, cascades, applying, statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.constants import (
    BOOK_EXTENSIONS,
    ENTRY_FILE,
    FOLDER_ENTRY_FILE,
    SAMPLE_EVERY,
    SUPPRESS_INTERVAL_MS,
)
from shelfspark.functions.paths import ancestor_paths, join_path, loose_extension, parent_path
from shelfspark.operators.ordered import number_rows, ordered
from shelfspark.session import checkpointed

IGNORED = "Ignored"
RAW_EVENT = "parent string, name string, events string"


def content_tag() -> Column:
    """Tag of a raw event of the source tree (columns name, events)."""
    tokens = F.split("events", ",")
    is_dir = F.array_contains(tokens, "ISDIR")
    event = F.coalesce(F.try_element_at(F.filter(tokens, lambda t: t != "ISDIR"), F.lit(1)), F.lit(""))
    book = loose_extension("name").isin(BOOK_EXTENSIONS)
    made = F.when(is_dir & event.isin("CREATE", "MOVED_TO"), "FolderCreated")
    made = made.when(is_dir & event.isin("DELETE", "MOVED_FROM"), "FolderDeleted")
    made = made.when(book & (event == "CLOSE_WRITE"), "BookCreated")
    made = made.when(book & ~is_dir & (event == "MOVED_TO"), "BookCreated")
    made = made.when(book & ~is_dir & event.isin("DELETE", "MOVED_FROM"), "BookDeleted")
    return F.when(F.col("name").startswith("."), IGNORED).otherwise(F.coalesce(made, F.lit(IGNORED)))


def mirror_tag() -> Column:
    """Tag of a raw event of the catalog tree: the file name alone decides."""
    return (
        F.when(F.col("name") == ENTRY_FILE, "EntryXmlChanged")
        .when(F.col("name") == FOLDER_ENTRY_FILE, "FolderEntryXmlChanged")
        .otherwise(IGNORED)
    )


def event_key() -> Column:
    """Key under which repeated events are suppressed (columns tag, parent, name)."""
    whole = F.col("tag").isin("BookCreated", "BookDeleted", "FolderCreated", "FolderDeleted")
    by_parent = F.col("tag").isin("EntryXmlChanged", "FolderEntryXmlChanged")
    return (
        F.when(whole, F.concat_ws(":", "tag", "parent", "name"))
        .when(by_parent, F.concat_ws(":", "tag", "parent"))
        .when(F.col("tag") == IGNORED, IGNORED)
        .otherwise(F.concat_ws(":", "tag", F.lit("unknown")))
    )


def event_path() -> Column:
    """Path an event is about (columns path, parent, name; null where absent)."""
    joined = F.when(F.col("parent").isNotNull() & F.col("name").isNotNull(), join_path("parent", "name"))
    return F.coalesce("path", joined, "parent")


def classify(events: DataFrame, mirror: bool = False) -> DataFrame:
    """Raw events to typed events; ignored ones leave before suppression."""
    typed = events.withColumn("tag", mirror_tag() if mirror else content_tag())
    typed = typed.filter(F.col("tag") != IGNORED)
    if mirror:
        typed = typed.withColumn("name", F.lit(None).cast("string"))
    return typed.withColumn("key", event_key())


def valid_events(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON lines to (good events, rejected lines): the three fields must be there and be texts."""
    text = F.col(value)
    parsed = lines.withColumn("__e", F.from_json(text, RAW_EVENT, {"mode": "PERMISSIVE"}))
    # The parser turns numbers and booleans into texts, so the kind of the value itself is asked for.
    variant = F.try_parse_json(text)
    is_text = lambda f: F.schema_of_variant(F.try_variant_get(variant, f"$.{f}", "variant")) == "STRING"
    fine = F.lit(True)
    for field in ("parent", "name", "events"):
        fine = fine & F.col(f"__e.{field}").isNotNull() & is_text(field)
    fine = F.coalesce(fine, F.lit(False))
    others = [c for c in lines.columns if c != value]
    return parsed.filter(fine).select(*others, "__e.*"), parsed.filter(~fine).select(*lines.columns)


# --- suppression -------------------------------------------------------------------------------


# Width of a slice of time, in intervals, and number of slices that are composed at a time.
SLICE_INTERVALS = 8
FAN_IN = 32
LOWEST = np.iinfo(np.int64).min
STEPS = "array<struct<from_ms:long,exit_ms:long>>"


def _following(times: np.ndarray, interval: int) -> np.ndarray:
    """For each time, the index of the first later time that is accepted after it."""
    return np.searchsorted(times, times + interval, side="left")


def _accepted(times: np.ndarray, seqs: np.ndarray, allowed: float | None, interval: int) -> np.ndarray:
    """Numbers of the accepted events of one slice, of which none before ``allowed`` may pass."""
    at = 0 if pd.isna(allowed) else int(np.searchsorted(times, int(allowed), side="left"))
    following, taken = _following(times, interval), []
    while at < len(times):
        taken.append(at)
        at = following[at]
    return seqs[taken]


def _steps(starts: np.ndarray, exits: np.ndarray, reach: int) -> list[dict]:
    """A step function as (from_ms, exit_ms): equal neighbours are one step, none begins beyond ``reach``."""
    keep = np.concatenate(([True], exits[1:] != exits[:-1])) & (starts <= reach)
    return [{"from_ms": int(a), "exit_ms": int(b)} for a, b in zip(starts[keep], exits[keep])]


def _transfer(times: np.ndarray, reach: int, interval: int) -> list[dict]:
    """What a slice makes of any earlier state, as steps (from_ms, exit_ms).

    If events may pass from time t on, the last one that passes in this slice is the exit of the last
    step whose ``from_ms`` is at or before t. Paths that merge share a step. No earlier event blocks
    beyond ``reach``.
    """
    following, exits = _following(times, interval), times.copy()
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            exits[i] = exits[following[i]]
    # Starting after times[i - 1] and not after times[i] means that times[i] is accepted first.
    return _steps(np.concatenate(([LOWEST], times[:-1] + 1)), exits, reach)


def _tables(slices: list) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(last_ms, starts, exits) of slices in order."""
    column = lambda part, name: np.array([s[name] for s in part["steps"]], dtype=np.int64)
    return [(part["last_ms"], column(part, "from_ms"), column(part, "exit_ms")) for part in slices]


def _through(table: tuple[int, np.ndarray, np.ndarray], allowed: np.ndarray, interval: int) -> np.ndarray:
    """From when on events may pass after a slice, for each time from which they may pass before it."""
    last_ms, starts, exits = table
    exit_ms = exits[np.searchsorted(starts, allowed, side="right") - 1]
    return np.where(allowed <= last_ms, exit_ms + interval, allowed)


def _compose(slices: list, reach: int, interval: int) -> list[dict]:
    """The steps of neighbouring slices taken as one. slices: (slice, last_ms, steps) in order."""
    tables = _tables(slices)
    # Between two of these times all entries take the same way.
    starts = np.unique(np.concatenate([np.append(t[1], t[0] + 1) for t in tables]))
    starts = starts[starts <= min(reach, tables[-1][0])]
    allowed = starts
    for table in tables:
        allowed = _through(table, allowed, interval)
    return _steps(starts, allowed - interval, reach)


def _entries(slices: list, allowed: float | None, interval: int) -> list[dict]:
    """From when on events may pass in each of neighbouring slices, given that of the first."""
    at, out = np.array([LOWEST if pd.isna(allowed) else int(allowed)]), []
    for part, table in zip(slices, _tables(slices)):
        out.append({"slice": part["slice"], "allowed": None if at[0] == LOWEST else int(at[0])})
        at = _through(table, at, interval)
    return out


def suppress(
    events: DataFrame, key: str = "key", ms: str = "ms", seq: str = "seq", interval: int = SUPPRESS_INTERVAL_MS,
    state: DataFrame | None = None,
) -> DataFrame:
    """Events accepted when one is let through per key and interval, counted from the last accepted one.

    Events are taken in the order of time, then ``seq`` (unique, integer). ``state`` (key, last_ms)
    continues an earlier run. Repeats within one millisecond are dropped on the map side. A null key
    is a key like any other.

    Whether an event is accepted depends on all events of its key before it, yet no task reads a key as
    a whole. Time is cut in slices of ``SLICE_INTERVALS`` intervals. A slice that begins at least an
    interval after the event before it depends on nothing, so only stretches of slices that hang
    together go on: each slice is reduced to the step function that it makes of any earlier state, at
    most one step per millisecond of an interval; ``FAN_IN`` neighbours are composed into one, level
    by level, and the states are then handed down the same tree. At the end each slice is decided alone.
    """
    # A struct around the key: null keys are then equal in joins.
    first = events.groupBy(F.struct(F.col(key)).alias("key"), F.col(ms).cast("long").alias("ms")).agg(
        F.min(F.col(seq).cast("long")).alias("seq")
    )
    if state is not None:
        # What the state blocks leaves no trace.
        known = state.select(F.struct(F.col("key").alias(key)).alias("key"), "last_ms")
        open_from = F.col("last_ms") + interval
        first = first.join(known, "key", "left").filter(F.col("last_ms").isNull() | (F.col("ms") >= open_from)).drop("last_ms")
    taken = _accepted_by_slices(first, interval)
    winners = taken.select(F.col("key").alias("__k"), F.col("seq").alias("__seq"))
    return events.join(winners, (F.struct(F.col(key)) == F.col("__k")) & (F.col(seq) == F.col("__seq")), "left_semi")


def _decide(groups: DataFrame, interval: int) -> DataFrame:
    """key, seq of the accepted events of slices (key, times, seqs, allowed)."""

    def run(times: pd.Series, seqs: pd.Series, allowed: pd.Series) -> pd.Series:
        return pd.Series([_accepted(t, s, a, interval) for t, s, a in zip(times, seqs, allowed)], dtype=object)

    return groups.select("key", F.explode(F.pandas_udf(run, "array<long>")("times", "seqs", "allowed")).alias("seq"))


def _accepted_by_slices(rows: DataFrame, interval: int) -> DataFrame:
    width = SLICE_INTERVALS * interval
    sliced = rows.withColumn("slice", F.floor(F.col("ms") / width))
    listed = sliced.groupBy("key", "slice").agg(F.array_sort(F.collect_list(F.struct("ms", "seq"))).alias("__e"))
    groups = checkpointed(listed.select("key", "slice", F.col("__e.ms").alias("times"), F.col("__e.seq").alias("seqs")))
    # A slice hangs on the one before it if less than an interval lies between their events.
    bounds = groups.select("key", "slice", F.element_at("times", 1).alias("low"), F.element_at("times", -1).alias("high"))
    before = bounds.select("key", (F.col("slice") + 1).alias("slice"), F.col("high").alias("before"))
    hanging = bounds.join(before, ["key", "slice"]).filter(F.col("low") - F.col("before") < interval)
    dense = hanging.select("key", F.explode(F.array(F.col("slice") - 1, F.col("slice"))).alias("slice")).distinct()
    dense = checkpointed(dense)
    span = dense.agg(F.min("slice").alias("low"), F.max("slice").alias("high")).first()
    alone = groups.join(dense, ["key", "slice"], "left_anti").withColumn("allowed", F.lit(None).cast("long"))
    # The only event of a slice that hangs on nothing passes.
    single = alone.filter(F.size("seqs") == 1).select("key", F.element_at("seqs", 1).alias("seq"))
    alone = alone.filter(F.size("seqs") > 1)
    if span["low"] is None:
        return single.union(_decide(alone, interval))
    # Slices are counted from the first one, so that the tree is no higher than their span asks for.
    chained = groups.join(dense, ["key", "slice"]).withColumn("slice", F.col("slice") - span["low"])
    allowed = _states(chained, span["low"] * width, span["high"] - span["low"] + 1, interval)
    known = chained.join(allowed, ["key", "slice"]).select("key", "times", "seqs", "allowed")
    return single.union(_decide(alone.select("key", "times", "seqs", "allowed").union(known), interval))


def _states(chained: DataFrame, origin: int, slices: int, interval: int) -> DataFrame:
    """key, slice, allowed: from when on events may pass in each slice (null: from its start)."""
    width = SLICE_INTERVALS * interval

    def reduce(times: pd.Series, number: pd.Series) -> pd.Series:
        return pd.Series([_transfer(t, origin + n * width + interval, interval) for t, n in zip(times, number)], dtype=object)

    steps = F.pandas_udf(reduce, STEPS)("times", "slice")
    table = checkpointed(chained.select("key", "slice", F.array_max("times").alias("last_ms"), steps.alias("steps")))
    levels, covered = [], 1
    while covered < slices:
        covered *= FAN_IN
        children = F.array_sort(F.collect_list(F.struct("slice", "last_ms", "steps"))).alias("children")
        level = checkpointed(table.groupBy("key", F.floor(F.col("slice") / FAN_IN).alias("slice")).agg(children))
        levels.append(level)
        if covered < slices:
            table = checkpointed(level.select("key", "slice", F.array_max("children.last_ms").alias("last_ms"),
                                              _composed(origin, covered * width, interval)("children", "slice").alias("steps")))

    def hand_down(children: pd.Series, allowed: pd.Series) -> pd.Series:
        return pd.Series([_entries(c, a, interval) for c, a in zip(children, allowed)], dtype=object)

    entries = F.pandas_udf(hand_down, "array<struct<slice:long,allowed:long>>")
    state = None
    for level in reversed(levels):
        known = level.withColumn("allowed", F.lit(None).cast("long")) if state is None else level.join(state, ["key", "slice"])
        state = known.select("key", F.explode(entries("children", "allowed")).alias("x")).select("key", "x.*")
    return state


def _composed(origin: int, width: int, interval: int):
    def compose(children: pd.Series, number: pd.Series) -> pd.Series:
        reach = (origin + n * width + interval for n in number)
        return pd.Series([_compose(c, r, interval) for c, r in zip(children, reach)], dtype=object)

    return F.pandas_udf(compose, STEPS)


# --- coalescing, cascades, applying ------------------------------------------------------------


def coalesce_requests(requests: DataFrame, batch: str = "batch", folder: str = "folder", seq: str = "seq") -> DataFrame:
    """One rebuild per folder and batch, placed where the last request for it stood."""
    return requests.groupBy(batch, folder).agg(F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("requests"))


def cascade(changes: DataFrame, compat: bool = False) -> DataFrame:
    """Folders to rebuild after changes, deepest first. changes: path, tag.

    A changed entry touches the folder that lists it and, as its counts change, every folder above.
    Deletion of a top-level folder touches the root as well; with ``compat`` it touches nothing.
    """
    if compat:
        changes = changes.filter(~((F.col("tag") == "FolderDeleted") & (parent_path("path") == "")))
    own = F.when(F.col("tag") == "FolderCreated", F.col("path")).otherwise(parent_path("path"))
    touched = changes.select(own.alias("folder")).distinct()
    folders = touched.select(F.explode(ancestor_paths("folder")).alias("folder")).distinct()
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    return folders.withColumn("depth", depth)


def last_changes(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """The last change of each path wins."""
    others = [c for c in changes.columns if c != "path"]
    row = F.max_by(F.struct(*others), seq).alias("r")
    return changes.groupBy("path").agg(row).select("path", "r.*")


def _deleted_above(rows: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """Folders in or below a deleted path: folder, seq of the last such deletion.

    Works on the distinct folders of the rows, not on the rows, so a folder with very many entries
    costs no more than any other. deleted: path, __deleted. The root is never deleted.
    """
    folders = rows.select(parent_path(column).alias("__folder")).distinct()
    above = folders.select("__folder", F.explode(F.array_remove(ancestor_paths("__folder"), "")).alias("path"))
    return above.join(deleted, "path").groupBy("__folder").agg(F.max("__deleted").alias("__above"))


def apply_changes(entries: DataFrame, changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Entries after a batch of changes. entries: path, ...; changes: path, tag, seq and entry columns.

    The same as taking the changes one by one in the order of seq: a deletion takes the whole subtree, also
    if its folder is created again later; an entry created after the last deletion above it stays.
    """
    last = last_changes(changes, seq)
    gone = changes.filter(F.col("tag").isin("BookDeleted", "FolderDeleted"))
    deleted = gone.groupBy("path").agg(F.max(F.col(seq).cast("long")).alias("__deleted"))
    created = last.filter(F.col("tag").isin("BookCreated", "FolderCreated"))
    columns = entries.columns
    # Every path with a change of its own leaves the old entries, be it created or deleted.
    kept = entries.join(last, "path", "left_anti").withColumn("__made", F.lit(None).cast("long"))
    rows = kept.unionByName(created.select(*columns, F.col(seq).cast("long").alias("__made")))
    rows = rows.withColumn("__folder", parent_path("path"))
    found = rows.join(_deleted_above(rows, deleted, "path"), "__folder", "left")
    alive = F.col("__above").isNull() | (F.col("__made") > F.col("__above"))
    return found.filter(F.coalesce(alive, F.lit(False))).select(*columns)


def delete_subtrees(entries: DataFrame, paths: DataFrame, column: str = "path") -> DataFrame:
    """Entries without the given paths and all below them; unknown paths do no harm."""
    gone = paths.select("path").distinct().withColumn("__deleted", F.lit(0).cast("long"))
    kept = entries.join(gone.select(F.col("path").alias(column)), column, "left_anti")
    below = _deleted_above(kept, gone, column).select("__folder")
    return kept.withColumn("__folder", parent_path(column)).join(below, "__folder", "left_anti").drop("__folder")


# --- statistics --------------------------------------------------------------------------------


def sample_every(events: DataFrame, order: list[Column], every: int = SAMPLE_EVERY) -> DataFrame:
    """Every n-th event in order, with its number."""
    numbered = number_rows(ordered(events, [], order), "event_no").plain()
    return numbered.filter(F.col("event_no") % every == 0)


def handler_log(changes: DataFrame, durations: dict[str, int], compat: bool = False) -> DataFrame:
    """Structured log of handled changes (path, tag, seq, error): event_id, step, event_type, event_tag, path, duration_ms,
    cascade_count, cascade_tags, error.

    Each event starts. If its tag has a handler, which has a duration in milliseconds, it completes, or fails where
    it has an error. One that completes asks for the feed of its folder, if it is not a top-level folder deleted under ``compat``.
    """
    if "error" not in changes.columns:
        changes = changes.withColumn("error", F.lit(None).cast("string"))
    asks = ["FolderMetaSyncRequested"]
    silent = (F.col("tag") == "FolderDeleted") & (parent_path("path") == "") if compat else F.lit(False)
    tags = F.when(silent, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, asks)))
    took = F.lit(None).cast("long")
    for tag, milliseconds in durations.items():
        took = F.when(F.col("tag") == tag, F.lit(milliseconds).cast("long")).otherwise(took)
    none = {"duration_ms": F.lit(None).cast("long"), "cascade_count": F.lit(None).cast("int"), "cascade_tags": F.lit(None).cast("array<string>")}

    def row(step: int, kind: Column, **values: Column) -> Column:
        fields = {**none, "error": F.lit(None).cast("string"), **values}
        return F.struct(F.lit(step).alias("step"), kind.alias("event_type"), *[v.alias(n) for n, v in fields.items()])

    failed = F.col("error").isNotNull()
    kind = F.when(failed, "handler_error").when(took.isNotNull(), "handler_complete")
    count = F.when(kind == "handler_complete", F.size(tags))
    steps = F.array(
        row(0, F.lit("handler_start")),
        row(1, kind, duration_ms=took, cascade_count=count, error=F.col("error")),
        row(2, F.when(count > 0, "cascades_generated"), cascade_count=count, cascade_tags=tags),
    )
    rows = changes.select(F.col("seq").cast("string").alias("event_id"), F.col("tag").alias("event_tag"), "path", F.explode(steps).alias("s"))
    return rows.filter("s.event_type is not null").select("event_id", "s.step", "s.event_type", "event_tag", "path", *[f"s.{n}" for n in (*none, "error")])


def handler_statistics(log: DataFrame) -> DataFrame:
    """Per event tag: starts, completions, errors, durations and cascades of a structured log."""
    is_type = lambda t: F.col("event_type") == t
    done = is_type("handler_complete")
    return log.filter(F.col("event_tag").isNotNull()).groupBy("event_tag").agg(
        F.count_if(is_type("handler_start")).alias("started"),
        F.count_if(done).alias("completed"),
        F.count_if(is_type("handler_error")).alias("failed"),
        F.avg(F.when(done, F.col("duration_ms"))).alias("avg_ms"),
        F.max(F.when(done, F.col("duration_ms"))).alias("max_ms"),
        F.coalesce(F.sum(F.when(is_type("cascades_generated"), F.col("cascade_count"))), F.lit(0)).alias("cascades"),
    )


def filter_log(log: DataFrame, tag: str, path_part: str | None = None, handler_only: bool = False) -> DataFrame:
    """Log rows of one event tag, of paths that contain a text, of handler starts and ends only."""
    kept = log.filter(F.col("event_tag") == tag)
    if handler_only:
        kept = kept.filter(F.col("event_type").isin("handler_start", "handler_complete"))
    return kept.filter(F.col("path").contains(path_part)) if path_part else kept


def trend(samples: DataFrame, by: list[str], x: str, y: str, scale: float = 1024.0) -> DataFrame:
    """Least-squares slope, slope between first and last sample, and the smaller of the two."""
    span = F.max(x) - F.min(x)
    rows = samples.groupBy(*by).agg(
        (F.regr_slope(F.col(y), F.col(x)) * scale).alias("slope"),
        F.try_divide((F.max_by(y, x) - F.min_by(y, x)) * scale, span).alias("two_point"),
    )
    return rows.withColumn("verdict", F.least("slope", "two_point"))
