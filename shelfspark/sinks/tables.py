"""Catalog tables on shared storage: entries, event log, dead letters, full rebuilds.

A table is a directory of versions. A version is written whole, then a pointer file naming it is
replaced by rename, so a reader sees the old rows or the new ones and never half of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, table: str) -> str | None:
    fs, path = _fs(spark, table)
    pointer = path(f"{table}/{POINTER}")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(df: DataFrame, table: str, version: str, partition_by: list[str] | None = None) -> None:
    """Write a version and make it current. Writing the same version again is harmless."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{table}/{version}")
    fs, path = _fs(spark, table)
    staged, pointer = path(f"{table}/{POINTER}.{version}"), path(f"{table}/{POINTER}")
    stream = fs.create(staged, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    if not fs.rename(staged, pointer):
        fs.delete(pointer, False)
        fs.rename(staged, pointer)


def read_table(spark: SparkSession, table: str) -> DataFrame | None:
    """Rows of the current version; None before the first one."""
    version = current_version(spark, table)
    return spark.read.parquet(f"{table}/{version}") if version else None


def read_version(spark: SparkSession, table: str, version: str) -> DataFrame | None:
    """Rows of a named version; None when it was never written."""
    fs, path = _fs(spark, table)
    return spark.read.parquet(f"{table}/{version}") if fs.exists(path(f"{table}/{version}/_SUCCESS")) else None


def version_before(spark: SparkSession, table: str, prefix: str, number: int) -> str | None:
    """The written version with the largest number below ``number`` (names: prefix and number)."""
    fs, path = _fs(spark, table)
    if not fs.exists(path(table)):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path(table))]
    numbers = [int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit()]
    for found in sorted((n for n in numbers if n < number), reverse=True):
        if fs.exists(path(f"{table}/{prefix}{found}/_SUCCESS")):
            return f"{prefix}{found}"
    return None


def expire_versions(spark: SparkSession, table: str, keep: int) -> None:
    """Delete all but the newest ``keep`` versions; the current one always stays."""
    fs, path = _fs(spark, table)
    current = current_version(spark, table)
    folders = [s for s in fs.listStatus(path(table)) if s.isDirectory() and s.getPath().getName() != current]
    folders.sort(key=lambda s: s.getModificationTime(), reverse=True)
    for old in folders[max(keep - 1, 0) :]:
        fs.delete(old.getPath(), True)


def append_log(rows: DataFrame, table: str, batch_id: int) -> None:
    """Rows of a batch in a directory of their own, so a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def seed_root(feeds: DataFrame) -> DataFrame:
    """Feeds with an empty root feed when there is none."""
    root = feeds.sparkSession.range(1).select(
        F.lit("").alias("folder"), F.lit("urn:opds:catalog:root").alias("id"), F.lit("Catalog").alias("title"),
        F.lit("").alias("updated"), F.lit("navigation").alias("kind"), F.lit("/feed.xml").alias("self_href"),
        F.lit("/feed.xml").alias("start_href"),
    )
    return feeds.unionByName(root.join(feeds.select("folder"), "folder", "left_anti"), allowMissingColumns=True)
