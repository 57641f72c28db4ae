"""Pages of a long list by stored ranges, so that page n reads only the ranges that hold it.

A range is one folder while there are few; beyond that a folder holds many, each a page of its
sorted file, and the position stored with every row finds them there by the file's index. So tasks
and files follow the size of the table, not the size of a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 100_000
#: Folders that any table may have, and rows of one when there are more.
FEW_FOLDERS = 100
ROWS_PER_FOLDER = 500_000
#: Positions count from ``range * _FIRST`` in each folder, as monotonically_increasing_id does.
_FIRST = 1 << 33


def store_pages(df: DataFrame, order: Sequence[Column], folder: str, rows_per_range: int = ROWS_PER_RANGE) -> None:
    """Store ``df`` in ranges of a total order, by one range exchange, with the number of rows
    before each folder. An empty table is stored as one without ranges.
    """
    rows = df.count()
    folders = max(1, min(-(-rows // rows_per_range), max(FEW_FOLDERS, -(-rows // ROWS_PER_FOLDER))))
    ranged = df.repartitionByRange(folders, *order).withColumn("range", F.spark_partition_id())
    placed = ranged.sortWithinPartitions("range", *order).withColumn("_at", F.monotonically_increasing_id())
    written = placed.write.option("parquet.page.row.count.limit", rows_per_range)
    written.partitionBy("range").parquet(f"{folder}/rows")
    stored = stored_rows(df.sparkSession, folder, df)
    counts = stored.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # one row per folder, a small table
    counts.withColumn("before", F.coalesce(before, F.lit(0))).write.parquet(f"{folder}/ranges")


def stored_rows(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """The stored rows with their position and range; an empty table has no files to take a schema from."""
    schema = like.withColumn("_at", F.lit(0).cast("long")).withColumn("range", F.lit(0)).schema
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def read_page(like: DataFrame, order: Sequence[Column], folder: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the stored order, with the columns of ``like``.

    Only the ranges that hold the page are read and only its rows are sorted; the folders are at
    most ``limit``, as none is empty. A page beyond the end is empty.
    """
    spark = like.sparkSession
    ranges = spark.read.parquet(f"{folder}/ranges")
    held = ranges.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))
    found = sorted(held.select("range", "before").collect())
    rows = stored_rows(spark, folder, like).filter(F.col("range").isin([r["range"] for r in found]))
    if found:
        (first, skipped), (last, through) = found[0], found[-1]
        begin = first * _FIRST + max(0, offset - skipped)
        end = last * _FIRST + offset + limit - through
        rows = rows.filter((F.col("_at") >= begin) & (F.col("_at") < end))
    return rows.drop("range", "_at").orderBy(*order)
