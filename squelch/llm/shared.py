"""Reading tables, the folder that all executors share, and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000
#: Rows of texts that go to a Python worker at once: the JVM and the worker hold such batches in full, in both directions.
BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may go without it: there one
    machine is the cluster, and a temporary folder serves.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> str:
    """From now on at most ``rows`` rows come in one Arrow batch; returns the setting before. Spark
    reads it when a plan runs, so it stays set, and a smaller one of the session is kept.
    """
    before = spark.conf.get(BATCH_SETTING)
    if not 0 < int(before) <= rows:
        spark.conf.set(BATCH_SETTING, str(rows))
    return before


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder: computed once, no lineage, survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as Parquet and read back: like ``cut``, for large tables."""
    folder = fresh_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def with_small(large: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join on ``on``: ``small`` (already materialised, two narrow columns at most) is broadcast
    if it has at most ``MAX_BROADCAST_ROWS`` rows; otherwise the join shuffles both sides.
    """
    if small.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        small = F.broadcast(small)
    return large.join(small, on, how)
