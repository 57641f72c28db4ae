"""Incremental versions of the counters, capture windows and transmissions.

Every job is a streaming DataFrame in and out. ``run_available`` drains a stream into a parquet
table on shared storage, one folder per micro-batch, so a batch that is run again replaces its
own output and nothing passes through the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from squelch import schemas
from squelch.sources import readers

_MERGE_LOCALLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint directory of the session. Only a local session, where one
    machine is the cluster, may go without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="squelch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_table_stream(
    spark: SparkSession, folder: str, glob: str, schema: StructType | str,
    max_files: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


def read_stored_stream(
    spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None
) -> DataFrame:
    """One parquet table as a stream, be it a single file or a folder of part files.

    A stream starts from a folder, so a single file is taken out of its folder by name; a name
    filter on a folder of part files would match none of them.
    """
    path = path.rstrip("/")
    place = "/" + path.split(":", 1)[-1].lstrip("/")
    # listed as binary files: the plan of a table that is cached names no files
    files = spark.read.format("binaryFile").load(path).inputFiles()
    if len(files) == 1 and unquote(files[0]).endswith(place):
        folder, name = path.rsplit("/", 1)
        return read_table_stream(spark, folder, name, schema, max_files)
    return read_table_stream(spark, path, "*", schema, max_files)


def new_segment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Segmentation documents that arrive in a folder, as segment rows."""
    documents = (
        spark.readStream.schema(schemas.SEGMENTATION).option("multiLine", "true").json(folder)
    )
    return readers.segmentation_rows(documents)


def new_audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """Audio files that arrive in a folder; only path, size and time are read."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("pathGlobFilter", "*.{mp3,wav,m4a,flac}")
        .load(folder)
        .select("path", "modificationTime", "length")
    )


def capture_chunks(
    activity: DataFrame, feed: str, moment: str, value: str, length: str = "10 minutes",
    late: str | None = None,
) -> DataFrame:
    """Fixed-length capture chunks per feed: events and their total.

    With ``late`` the stream gets a watermark, so closed chunks leave the state.
    """
    if late is not None:
        activity = activity.withWatermark(moment, late)
    return (
        activity.groupBy(F.window(moment, length).alias("w"), feed)
        .agg(F.count("*").alias("events"), F.sum(value).alias("total"))
        .select(
            feed, F.col("w.start").alias("chunk_start"), F.col("w.end").alias("chunk_end"),
            "events", "total",
        )
    )


def transmissions(
    activity: DataFrame, key: Sequence[str], moment: str, gap: str = "500 milliseconds",
    late: str | None = None,
) -> DataFrame:
    """Activity cut at silences of at least ``gap``."""
    if late is not None:
        activity = activity.withWatermark(moment, late)
    return (
        activity.groupBy(F.session_window(moment, gap).alias("w"), *key)
        .agg(F.count("*").alias("events"))
        .select(
            *key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events"
        )
    )


def running_counts(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Maintained child counts: rows per key so far."""
    return rows.groupBy(*key).agg(F.count("*").alias("rows"))


def run_available(
    stream: DataFrame, mode: str, name: str, key: Sequence[str] = ()
) -> DataFrame:
    """Drain a stream and return its result table.

    ``complete`` keeps the last batch, ``append`` all batches; in ``update`` mode the newest row
    per ``key`` wins.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    table = f"{folder}/table"

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    before = spark.conf.get(_MERGE_LOCALLY, "false")
    spark.conf.set(_MERGE_LOCALLY, "true")
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(store)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(_MERGE_LOCALLY, before)
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], stream.schema)
    schema = StructType([*stream.schema.fields, StructField("batch_id", LongType())])
    stored = spark.read.schema(schema).parquet(table)
    if mode == "append":
        return stored.drop("batch_id")
    if mode == "complete":
        last = stored.agg(F.max("batch_id")).scalar()
        return stored.filter(F.col("batch_id") == last).drop("batch_id")
    rest = [c for c in stream.columns if c not in key]
    newest = F.max_by(F.struct(*rest), "batch_id")
    return stored.groupBy(*key).agg(newest.alias("_row")).select(*key, "_row.*")


def drain_queue(
    stream: DataFrame, process: Callable[[DataFrame], DataFrame], name: str
) -> DataFrame:
    """Process queued rows batch by batch; ``process`` adds an ``error`` column, null on success.

    A queue without files is drained at once: an empty table.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark, name)
    table = f"{folder}/table"

    def drained(batch: DataFrame) -> DataFrame:
        status = F.when(F.col("error").isNull(), "processed").otherwise("failed")
        return process(batch).withColumn("queue_status", status)

    batches = []

    def store(batch: DataFrame, batch_id: int) -> None:
        batches.append(batch_id)
        drained(batch).write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(store)
        .start()
    )
    query.awaitTermination()
    if not batches:
        return drained(spark.createDataFrame([], stream.schema))
    return spark.read.parquet(table).drop("batch_id")


def to_timestamp(moment: Column) -> Column:
    """Event times without a zone as instants, which windows on streams need."""
    return moment.cast("timestamp")
