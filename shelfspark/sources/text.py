"""Sources of text documents: feeds, change events, structured logs, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.text import col

LOG_FIELDS = (
    "ts string, level string, tag string, msg string, event_id string, event_tag string, event_type string, "
    "path string, parent string, name string, handler string, duration_ms long, cascade_count int, "
    "cascade_tags array<string>, books_found int, books_process int, books_delete int, folders_count int, "
    "has_cover boolean, entries_count int, subfolders int, books int, error string, error_stack string, "
    "file string, tool string, port int, raw_event string"
)
# Digits of the numbers in a dictionary index (fixed value).
INDEX_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Feed documents below a directory: path, xml. Empty files have no row."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Structured log rows: colour codes removed, lines that are not JSON objects dropped."""
    text = F.regexp_replace(value, r"\x1b\[[0-9;]*m", "")
    parsed = lines.select(text.alias("__t")).filter(F.col("__t").startswith("{"))
    schema = f"{LOG_FIELDS}, _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = parsed.select(F.from_json("__t", schema, options).alias("l")).select("l.*")
    return rows.filter("_corrupt is null").drop("_corrupt")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def decode_index_number(c: Column | str) -> Column:
    """Number written in 64 digits, most significant first; null when it does not fit into a long."""
    digits = F.filter(F.split(col(c), ""), lambda d: d != "")
    step = lambda acc, d: F.try_add(F.try_multiply(acc, F.lit(64)), F.instr(F.lit(INDEX_DIGITS), d).cast("long") - 1)
    return F.aggregate(digits, F.lit(0).cast("long"), step)


def parse_dictionary(lines: DataFrame, value: str = "value") -> DataFrame:
    """Index lines (word, offset, size separated by tabs) to rows."""
    parts = F.split(value, "\t")
    at = lambda i: F.try_element_at(parts, F.lit(i))
    return lines.filter(F.col(value) != "").select(
        at(1).alias("word"), decode_index_number(at(2)).alias("offset"), decode_index_number(at(3)).alias("size")
    )


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_dictionary(spark.read.text(path))


def read_change_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream of raw JSON event lines from a directory, hidden paths left out. Validate before use."""
    lines = spark.readStream.text(path)
    hidden = F.get_json_object("value", "$.parent").contains("/.") | F.get_json_object("value", "$.name").startswith(".")
    return lines.filter(~F.coalesce(hidden, F.lit(False)))


def read_mirror_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream of raw JSON event lines of the catalog tree, its own logs and pages left out."""
    name = F.get_json_object("value", "$.name")
    own = name.isin("events.jsonl", "errors.jsonl", "index.html")
    return read_change_events(spark, path).filter(~F.coalesce(own, F.lit(False)))
