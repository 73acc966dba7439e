"""One way to open a session: UTC, adaptive execution, durable checkpoints when the cluster names a folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a broadcast side is chosen by the planner from its measured size, never forced by a hint
    "spark.sql.autoBroadcastJoinThreshold": "32m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(app: str = "figtrail", cores: int | str = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench. On a cluster use the session you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                       "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a fresh local one only where it is unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = named or tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the pages, as the other does: both are shuffled and merged. The planner knows such a
    table only by its compressed files or by what it was exploded from (1.5 MB for 100 MB of rows), and would send it whole
    through the driver and to every executor."""
    return df.hint("merge")


def parted(df: DataFrame, *keys: str, finer: int = 1) -> DataFrame:
    """Rows of one key together, in as many parts as the session shuffles into. Windows and counts within the keys need no other
    shuffle; and the parts stay apart, where adaptive execution would join them by their compressed bytes, which tell
    too little of what short, like words take up when they are sorted. ``finer`` makes that many times the parts, for rows
    that are sorted again and again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * finer, *keys)


def cut(df: DataFrame) -> DataFrame:
    """A table several steps read, written once as Parquet under the checkpoint folder and read back: the steps after it
    do not repeat it, read only the columns and rows they need, and a lost executor costs a read."""
    if any(isinstance(f.dataType, NullType) for f in df.schema.fields):  # Parquet has no column without a type
        checkpoint_folder(df.sparkSession)
        return df.checkpoint()
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/figtrail/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
