"""Sinks: JSON lines, single documents, append tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row, one file per task."""
    df.write.mode("overwrite").json(path)


def as_json_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON text, for sinks that take text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_document(summary: DataFrame, path: str) -> None:
    """One-row aggregate as a single JSON file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def append_table(df: DataFrame, path: str) -> None:
    """Append rows to a parquet table (matches, preference pairs)."""
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version of a table; never overwrite the path the plan reads from."""
    df.write.mode("overwrite").parquet(path)
