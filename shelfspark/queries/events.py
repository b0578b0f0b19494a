"""Events: the driver's events stand for raw file changes of one folder per user."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.paths import parent_path, relative_to, url_to_path
from shelfspark.operators import events as ev
from shelfspark.queries.base import PATH, parent_sql, query, table
from shelfspark.session import shared_dir
from shelfspark.sinks.buckets import BucketedTable, apply_to_buckets
from shelfspark.sinks.tables import append_log
from shelfspark.sources.event_source import read_events
from shelfspark.sources.text import parse_log
from shelfspark.streaming.suppress import suppress_replay

HOURS = 3_600_000
INTERVAL = 4 * HOURS

RAW = """(SELECT event_id, epoch_ms(ts) AS ms, '/books/u' || user_id || '/' AS parent, user_id, event_type,
  CASE WHEN event_id % 11 = 0 THEN '.' ELSE '' END || 'b' || (event_id % 20) || CASE event_id % 3 WHEN 0 THEN '.epub' WHEN 1 THEN '.md' ELSE '.PDF' END AS name,
  CASE event_type WHEN 'click' THEN 'CLOSE_WRITE' WHEN 'purchase' THEN 'MOVED_TO' WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'CREATE,ISDIR'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'CREATE' ELSE 'ISDIR,MOVED_FROM' END END AS events FROM events)"""
_BOOK = "(name LIKE '%.epub' OR name LIKE '%.PDF')"
TYPED = f"""(SELECT *, tag || ':' || parent || ':' || name AS key FROM (SELECT *, CASE WHEN name LIKE '.%' THEN NULL
  WHEN events = 'CREATE,ISDIR' THEN 'FolderCreated' WHEN events = 'ISDIR,MOVED_FROM' THEN 'FolderDeleted'
  WHEN events IN ('CLOSE_WRITE', 'MOVED_TO') AND {_BOOK} THEN 'BookCreated' WHEN events = 'DELETE' AND {_BOOK} THEN 'BookDeleted' END AS tag FROM {RAW})
  WHERE tag IS NOT NULL)"""


def millis(c: str):
    """Milliseconds of a time column; the tables carry times without a zone, read as UTC."""
    return F.unix_millis(F.col(c).cast("timestamp"))


def raw_events(spark, sf_dir) -> DataFrame:
    """Raw change events: event_id, ms, parent, name, events."""
    e, kind = F.col("event_id"), F.col("event_type")
    extension = F.element_at(F.array(F.lit(".epub"), F.lit(".md"), F.lit(".PDF")), (e % 3 + 1).cast("int"))
    name = F.concat(F.when(e % 11 == 0, ".").otherwise(""), F.lit("b"), (e % 20).cast("string"), extension)
    tokens = (
        F.when(kind == "click", "CLOSE_WRITE").when(kind == "purchase", "MOVED_TO").when(kind == "error", "DELETE")
        .when(kind == "signup", "CREATE,ISDIR").when(e % 2 == 0, "CREATE").otherwise("ISDIR,MOVED_FROM")
    )
    parent = F.concat(F.lit("/books/u"), F.col("user_id").cast("string"), F.lit("/"))
    return table(spark, sf_dir, "events").select(
        "event_id", millis("ts").alias("ms"), "user_id", parent.alias("parent"), name.alias("name"), tokens.alias("events")
    )


@query(f"SELECT event_id, tag, key FROM {TYPED}")
def classify_events(spark, sf_dir) -> DataFrame:
    return ev.classify(raw_events(spark, sf_dir)).select("event_id", "tag", "key")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'EntryXmlChanged' ELSE 'FolderEntryXmlChanged' END AS tag,
  CASE event_id % 3 WHEN 0 THEN 'EntryXmlChanged:/data/u' ELSE 'FolderEntryXmlChanged:/data/u' END || user_id || '/' AS key,
  '/data/u' || user_id || '/' AS path FROM events WHERE event_id % 3 < 2""")
def mirror_events(spark, sf_dir) -> DataFrame:
    name = F.element_at(F.array(F.lit("entry.xml"), F.lit("_entry.xml"), F.lit("feed.xml")), (F.col("event_id") % 3 + 1).cast("int"))
    raw = raw_events(spark, sf_dir).withColumn("name", name).withColumn("parent", F.replace("parent", F.lit("/books/"), F.lit("/data/")))
    typed = ev.classify(raw, mirror=True).withColumn("path", F.lit(None).cast("string"))
    return typed.select("event_id", "tag", "key", ev.event_path().alias("path"))


@query(f"""SELECT event_id, event_id % 5 < 3 AS good FROM events""")
def event_validation(spark, sf_dir) -> DataFrame:
    raw, k = raw_events(spark, sf_dir), F.col("event_id") % 5
    whole = F.to_json(F.struct("parent", "name", "events"))
    value = F.when(k < 3, whole).when(k == 3, F.concat(F.lit('{"parent":"a","name":'), F.col("event_id").cast("string"), F.lit(',"events":"x"}'))).otherwise(F.substring(whole, 1, 20))
    good, bad = ev.valid_events(raw.select("event_id", value.alias("value")))
    mark = lambda df, flag: df.select("event_id", F.lit(flag).alias("good"))
    return mark(good, True).unionByName(mark(bad, False))


def keyed_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", millis("ts").alias("ms"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key")
    )


SUPPRESSED = f"""WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, epoch_ms(ts) AS ms, min(event_id) AS event_id FROM events GROUP BY 1, 2),
  a AS (SELECT key, min(ms) AS ms FROM e GROUP BY key UNION ALL SELECT a.key, min(e.ms) FROM a JOIN e ON e.key = a.key AND e.ms >= a.ms + {INTERVAL} GROUP BY a.key)
  SELECT e.event_id, e.key FROM e JOIN a USING (key, ms)"""


@query(SUPPRESSED)
def suppress_events(spark, sf_dir) -> DataFrame:
    return ev.suppress(keyed_events(spark, sf_dir), seq="event_id", interval=INTERVAL).select("event_id", "key")


@query(SUPPRESSED)
def suppress_events_stream(spark, sf_dir) -> DataFrame:
    """The same rows from a stream that is stopped and started again; state goes from run to run."""
    run = f"{shared_dir(spark)}/suppress-{uuid.uuid4().hex}"
    events = keyed_events(spark, sf_dir)
    write = lambda rows, batch_id: append_log(rows.select("event_id", "key"), f"{run}/out", batch_id)
    middle = events.agg(F.percentile_approx("ms", 0.5)).first()[0]
    for part in (F.col("ms") < middle, F.col("ms") >= middle):
        events.filter(part).write.mode("append").parquet(f"{run}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{run}/in")
        suppress_replay(stream, f"{run}/state", write, f"{run}/checkpoint", seq="event_id", interval=INTERVAL).awaitTermination()
    return spark.read.parquet(f"{run}/out").select("event_id", "key")


# One hot key: all events of the tree under one key, one accepted per hour.
@query(f"""WITH RECURSIVE e AS (SELECT epoch_ms(ts) AS ms, min(event_id) AS event_id FROM events GROUP BY 1),
  a AS (SELECT min(ms) AS ms FROM e UNION ALL SELECT * FROM (SELECT min(e.ms) AS ms FROM a JOIN e ON e.ms >= a.ms + {HOURS}) WHERE ms IS NOT NULL)
  SELECT e.event_id FROM e JOIN a USING (ms)""")
def suppress_one_key(spark, sf_dir) -> DataFrame:
    one = keyed_events(spark, sf_dir).withColumn("key", F.lit("all"))
    return ev.suppress(one, seq="event_id", interval=HOURS).select("event_id")


@query(f"SELECT event_id, parent, name, events FROM {RAW}")
def change_event_rows(spark, sf_dir) -> DataFrame:
    """The raw events written as a change log and read again by its source, in ranges of a part of a file."""
    log = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    raw_events(spark, sf_dir).select(F.to_json(F.struct("parent", "name", "events", "event_id"))).write.text(log)
    good, _ = ev.valid_events(read_events(spark, log, partBytes=1 << 20).withColumn("event_id", F.get_json_object("value", "$.event_id").cast("long")))
    return good.select("event_id", "parent", "name", "events")


# Two of the four tags have handlers, every tenth event fails.
@query(f"""WITH h AS (SELECT event_id::VARCHAR AS event_id, tag AS event_tag, 'u' || user_id || '/' || name AS path, tag IN ('BookCreated', 'FolderDeleted') AS known,
    CASE tag WHEN 'BookCreated' THEN 5::BIGINT WHEN 'FolderDeleted' THEN 7::BIGINT END AS ms, event_id % 10 = 0 AS failed FROM {TYPED})
  SELECT event_id, 0 AS step, 'handler_start' AS event_type, event_tag, path, NULL::BIGINT AS duration_ms, NULL::INTEGER AS cascade_count, NULL AS cascade_tags, NULL AS error FROM h
  UNION ALL SELECT event_id, 1, 'handler_error', event_tag, path, ms, NULL, NULL, 'no book' FROM h WHERE failed
  UNION ALL SELECT event_id, 1, 'handler_complete', event_tag, path, ms, 1, NULL, NULL FROM h WHERE known AND NOT failed
  UNION ALL SELECT event_id, 2, 'cascades_generated', event_tag, path, NULL, 1, 'FolderMetaSyncRequested', NULL FROM h WHERE known AND NOT failed""")
def event_log_rows(spark, sf_dir) -> DataFrame:
    typed = ev.classify(raw_events(spark, sf_dir)).withColumn("path", F.lit(None).cast("string"))
    path = relative_to("/books", ev.event_path())
    changes = typed.select(F.col("event_id").alias("seq"), "tag", path.alias("path"))
    changes = changes.withColumn("error", F.when(F.col("seq") % 10 == 0, "no book"))
    log = ev.handler_log(changes, {"BookCreated": 5, "FolderDeleted": 7})
    return log.withColumn("cascade_tags", F.array_join("cascade_tags", ","))


@query("SELECT event_id // 1000 AS batch, 'u' || user_id AS folder, max(event_id) AS last_seq, count(*) AS requests FROM events GROUP BY 1, 2")
def coalesce_requests(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.floor(F.col("event_id") / 1000).alias("batch"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("folder"), F.col("event_id").alias("seq")
    )
    return ev.coalesce_requests(rows)


_CHANGED = f"(SELECT DISTINCT {PATH} AS path FROM pages)"


@query(f"""SELECT DISTINCT folder, CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END::INTEGER AS depth FROM (
  SELECT array_to_string(parts[1:i], '/') AS folder FROM (
    SELECT parts, unnest(range(0, len(parts) + 1)) AS i FROM (SELECT string_split({parent_sql('path')}, '/') AS parts FROM {_CHANGED})))""")
def cascade_folders(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(url_to_path("url").alias("path"), F.lit("BookCreated").alias("tag"))
    return ev.cascade(pages)


# What the events of the tree leave behind: the last creation of each path, unless a deletion of it or above it came later.
_EVENTS = f"""typed AS (SELECT event_id, tag, 'u' || user_id || CASE WHEN tag LIKE 'Folder%' THEN '' ELSE '/' || name END AS path FROM {TYPED}),
  last AS (SELECT path, arg_max(tag, event_id) AS tag, max(event_id) AS event_id FROM typed GROUP BY path),
  gone AS (SELECT path AS folder, max(event_id) AS deleted FROM typed WHERE tag = 'FolderDeleted' GROUP BY path),
  made AS (SELECT path, event_id AS source FROM last LEFT JOIN gone ON folder = split_part(path, '/', 1) WHERE tag LIKE '%Created' AND (folder IS NULL OR event_id > deleted))"""
_APPLIED = f"""WITH {_EVENTS}, old AS (SELECT DISTINCT 'u' || user_id || '/b' || (event_id % 20) || '.epub' AS path, -1 AS source FROM events)
  SELECT path, source FROM old LEFT JOIN gone ON folder = split_part(path, '/', 1) WHERE folder IS NULL AND path NOT IN (SELECT path FROM last)
  UNION ALL SELECT path, source FROM made"""


def path_changes(raw: DataFrame) -> DataFrame:
    """Changes (path, tag, seq, source) of raw events: folders are users, books lie in them."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    path = F.when(F.col("tag").startswith("Folder"), user).otherwise(F.concat_ws("/", user, "name"))
    return ev.classify(raw).select(path.alias("path"), "tag", F.col("event_id").alias("seq"), F.col("event_id").alias("source"))


def old_entries(raw: DataFrame) -> DataFrame:
    """Entries (path, source) that are there before the events."""
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    path = F.concat(user, F.lit("/b"), (F.col("event_id") % 20).cast("string"), F.lit(".epub"))
    return raw.select(path.alias("path")).distinct().withColumn("source", F.lit(-1).cast("long"))


@query(_APPLIED)
def apply_events(spark, sf_dir) -> DataFrame:
    raw = raw_events(spark, sf_dir)
    return ev.apply_changes(old_entries(raw), path_changes(raw))


@query(f"WITH {_EVENTS} SELECT path, source FROM made")
def apply_folder_events(spark, sf_dir) -> DataFrame:
    changes = path_changes(raw_events(spark, sf_dir))
    return ev.apply_changes(changes.select("path", "source").limit(0), changes)


@query(_APPLIED)
def applied_buckets(spark, sf_dir) -> DataFrame:
    """The same from a table in buckets of folders, to which the events are applied in three batches."""
    raw = raw_events(spark, sf_dir)
    entries = BucketedTable(spark, f"{shared_dir(spark)}/entries-{uuid.uuid4().hex}", buckets=16)
    with_folder = lambda rows: rows.withColumn("folder", parent_path("path"))
    entries.rewrite(with_folder(old_entries(raw)))
    changes = with_folder(path_changes(raw))
    first, last = changes.agg(F.min("seq"), F.max("seq")).first()
    if first is not None:
        number = F.floor((F.col("seq") - first) * 3 / (last - first + 1))
        for batch in range(3):
            apply_to_buckets(entries, changes.filter(number == batch))
    return entries.read().select("path", "source")


@query("SELECT event_id, event_no FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS event_no FROM events) WHERE event_no % 50 = 0")
def sample_every_n(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return ev.sample_every(events, [F.col("ts"), F.col("event_id")]).select("event_id", "event_no")


# Log lines made of the events, some coloured, some broken.
_LOG_TYPES = ["handler_start", "handler_complete", "handler_error", "cascades_generated"]


def log_lines(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, _LOG_TYPES)), (e % 4 + 1).cast("int"))
    line = F.to_json(F.struct(
        F.col("ts").cast("string").alias("ts"), F.lit("info").alias("level"), F.lit("Consumer").alias("tag"), F.lit("m").alias("msg"),
        e.cast("string").alias("event_id"), F.col("event_type").alias("event_tag"), kind.alias("event_type"),
        F.concat(F.lit("/u"), F.col("user_id").cast("string")).alias("path"), (e % 100).alias("duration_ms"), (e % 3).cast("int").alias("cascade_count"),
    ))
    broken = F.when(e % 10 == 9, F.substring(line, 1, 40)).when(e % 10 == 8, F.concat(F.lit("note "), line))
    return table(spark, sf_dir, "events").select(F.coalesce(broken, F.concat(F.lit("\x1b[32m"), line, F.lit("\x1b[0m"))).alias("value"))


_LOG = "(SELECT *, event_id % 4 AS k FROM events WHERE event_id % 10 < 8)"


@query(f"""SELECT event_type AS event_tag, count(*) FILTER (k = 0) AS started, count(*) FILTER (k = 1) AS completed, count(*) FILTER (k = 2) AS failed,
  round(avg(event_id % 100) FILTER (k = 1), 6) AS avg_ms, max(event_id % 100) FILTER (k = 1) AS max_ms, coalesce(sum(event_id % 3) FILTER (k = 3), 0)::BIGINT AS cascades
  FROM {_LOG} GROUP BY 1""")
def event_log_stats(spark, sf_dir) -> DataFrame:
    return ev.handler_statistics(parse_log(log_lines(spark, sf_dir))).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"SELECT event_id::VARCHAR AS event_id, '/u' || user_id AS path FROM {_LOG} WHERE event_type = 'click' AND contains('/u' || user_id, '/u1') AND k < 2")
def event_log_filter(spark, sf_dir) -> DataFrame:
    return ev.filter_log(parse_log(log_lines(spark, sf_dir)), "click", "/u1", handler_only=True).select("event_id", "path")


@query("""SELECT event_type, round(slope, 6) AS slope, round(two_point, 6) AS two_point, round(least(slope, two_point), 6) AS verdict FROM (
  SELECT event_type, regr_slope(v, h) * 1024 AS slope, (arg_max(v, h) - arg_min(v, h)) * 1024 / (max(h) - min(h)) AS two_point FROM (
    SELECT event_type, (epoch_ms(ts) // 3600000) AS h, avg(value) AS v FROM events GROUP BY 1, 2) GROUP BY 1)""")
def trend_slope(spark, sf_dir) -> DataFrame:
    hour = F.floor(millis("ts") / HOURS)
    samples = table(spark, sf_dir, "events").groupBy("event_type", hour.alias("h")).agg(F.avg("value").alias("v"))
    rows = ev.trend(samples, ["event_type"], "h", "v")
    return rows.select("event_type", *[F.round(c, 6).alias(c) for c in ("slope", "two_point", "verdict")])
