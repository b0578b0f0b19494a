"""Session helpers: a session with sensible settings, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_DIRS: dict[str, str] = {}


def session(app: str = "shelfspark", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings by keyword (dots as ``__``)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local folder in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _LOCAL_DIRS[context.applicationId]


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and cut the lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as a table in the shared folder and read from there.

    Unlike a checkpoint the table is compressed and its size is known to the planner, so joins with small
    ones need no shuffle.
    """
    table = Appended(df, name)
    table.add(df)
    return table.read().drop("part")


class Appended:
    """A table in the shared folder to which parts are added one by one; column ``part`` is the number of the part."""

    def __init__(self, like: DataFrame, name: str):
        self.spark, self.schema = like.sparkSession, like.schema
        self.path, self.parts = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}", 0

    def add(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/part={self.parts}")
        self.parts += 1

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema.toDDL()}, part int").parquet(self.path)

    def latest(self) -> DataFrame:
        return self.read().filter(F.col("part") == self.parts - 1).drop("part")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread over all cores when they come in fewer partitions than there are cores.

    For costly work per row on an input of few files. A large input has partitions enough and is
    left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
