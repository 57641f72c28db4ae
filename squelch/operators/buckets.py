"""Tables in buckets of the key's hash, changed bucket by bucket.

A table is a folder of Parquet files partitioned by bucket. A change reads the buckets that its
keys fall into, and writes these with dynamic partition overwrite; all other buckets keep their
files. A changed bucket carries one marker row, since an overwrite without rows would leave the old
ones where a bucket loses its last row.

The number of buckets is chosen once, so that a bucket is a task's work; a change sends at most
that many bucket numbers to the driver, where they prune the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squelch.operators import tables

BUCKET = "_bucket"
LIVE = "_live"
#: Takes the old rows of the touched buckets, gives their new rows.
Change = Callable[[DataFrame], DataFrame]


def bucket_of(key: Column, buckets: int, by_hash: bool = True) -> Column:
    """The bucket of a key; integer keys that are spread evenly may do without the hash."""
    return F.pmod(F.xxhash64(key) if by_hash else key, F.lit(buckets)).cast("int")


def _write(rows: DataFrame, folder: str) -> None:
    (
        rows.repartition(BUCKET)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET)
        .parquet(folder)
    )


def write_buckets(table: DataFrame, folder: str, key: str, buckets: int, by_hash: bool = True) -> None:
    """A new table; ``folder`` is empty or does not exist."""
    _write(table.withColumns({LIVE: F.lit(True), BUCKET: bucket_of(F.col(key), buckets, by_hash)}), folder)


def _all_rows(spark: SparkSession, folder: str) -> DataFrame:
    spark.catalog.refreshByPath(folder)
    return spark.read.parquet(folder)


def read_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _all_rows(spark, folder).filter(LIVE).drop(LIVE, BUCKET)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """bucket, file and its time of writing: one row per file that has rows."""
    where = F.col("_metadata")
    rows = _all_rows(spark, folder).select(
        F.col(BUCKET).alias("bucket"), where["file_path"].alias("file"), where["file_modification_time"].alias("written")
    )
    return rows.distinct()


def change_buckets(
    spark: SparkSession, folder: str, keys: DataFrame, key: str, buckets: int, change: Change, by_hash: bool = True
) -> list[int]:
    """Replace the rows of the buckets that ``keys`` (column ``key``) fall into by what ``change``
    makes of them; the numbers of these buckets.
    """
    at = bucket_of(F.col(key), buckets, by_hash)
    touched = sorted(r[0] for r in keys.select(at.alias("b")).distinct().collect() if r[0] is not None)
    if not touched:
        return touched
    old = _all_rows(spark, folder).filter(F.col(BUCKET).isin(touched))
    rows = change(old.filter(LIVE).drop(LIVE, BUCKET)).withColumns({LIVE: F.lit(True), BUCKET: at})
    marker = spark.createDataFrame([(b, False) for b in touched], f"{BUCKET} int, {LIVE} boolean")
    _write(rows.unionByName(marker, allowMissingColumns=True), folder)
    return touched


def merge(
    spark: SparkSession, folder: str, updates: DataFrame, key: str, buckets: int, nullable: Sequence[str] = (),
    by_hash: bool = True,
) -> list[int]:
    """``tables.merge_updates`` on the touched buckets only."""
    return change_buckets(
        spark, folder, updates, key, buckets, lambda old: tables.merge_updates(old, updates, key, nullable), by_hash
    )


def upsert(
    spark: SparkSession, folder: str, incoming: DataFrame, key: str, buckets: int, by_hash: bool = True
) -> list[int]:
    """Whole rows replace those of their key, others are added."""

    def change(old: DataFrame) -> DataFrame:
        return old.join(incoming.select(key), key, "left_anti").unionByName(incoming)

    return change_buckets(spark, folder, incoming, key, buckets, change, by_hash)


def delete(spark: SparkSession, folder: str, doomed: DataFrame, key: str, buckets: int, by_hash: bool = True) -> list[int]:
    """Rows without the keys of ``doomed``."""
    ids = doomed.select(key)
    return change_buckets(spark, folder, ids, key, buckets, lambda old: old.join(ids, key, "left_anti"), by_hash)
