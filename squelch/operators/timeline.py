"""Ordered operators that stay parallel when one timeline holds most of the rows.

A window partitioned by timeline puts a whole timeline into one task. Here a timeline with more
than ``rows_per_block`` rows is first cut into ordered blocks, the window runs per block, and
what must cross a block border (the last row, the maximum, the count of the blocks before) is
carried over from a per-block summary. Results equal the plain window.

Blocks come from the data alone (row count and value range), so recomputed tasks agree. A heavy
timeline is cut evenly over its position range; a block that is still heavy is cut again over its
own range, by position or, where all positions are equal, by the tie-break column, twice at most.
Null positions come first, as in the plain window, and null keys form a timeline like any other.
Levels after the first read the heavy rows only. ``order`` should end in a column without repeats.

``add_blocks`` first counts the rows per timeline. When none is heavy it adds nothing, and the
other functions are plain windows.

What is broadcast has a bound: a heavy group has more than ``rows_per_block`` rows, so there are
at most rows / rows_per_block of them, and at most twice as many blocks per level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 2_000_000
LEVELS = ["_b1", "_b2", "_b3"]
HOT = "_hot"


def add_blocks(
    df: DataFrame, key: Sequence[str], order: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Add block columns if any timeline is heavy; ``order`` is (position, tie-break, ...), the
    first two numeric.
    """
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n"))
    if sizes.filter(F.col("_n") > rows_per_block).isEmpty():
        return df
    position, tie = order[0], order[min(1, len(order) - 1)]
    df = df.withColumn(HOT, F.lit(True))
    group = list(key)
    for level in LEVELS:
        ranges = (
            df.filter(HOT)
            .groupBy(*group)
            .agg(
                F.count("*").alias("_n"),
                F.count(position).alias("_set"),
                F.min(F.col(position).cast("double")).alias("_lo"),
                F.max(F.col(position).cast("double")).alias("_hi"),
                F.min(F.col(tie).cast("double")).alias("_tie_lo"),
                F.max(F.col(tie).cast("double")).alias("_tie_hi"),
            )
            .filter(F.col("_n") > rows_per_block)
        )
        blocks = F.ceil(F.col("_n") / rows_per_block)

        def piece(at: Column, low: Column, high: Column) -> Column:
            part = F.floor((at.cast("double") - low) / (high - low) * blocks)
            return F.when(at.isNotNull() & (high > low), F.least(blocks - 1, part)).otherwise(0)

        here = F.col(position)
        by_position = piece(here, F.col("_lo"), F.col("_hi"))
        block = (
            F.when(F.col("_n").isNull(), 0)
            .when((F.col("_set") > 0) & (F.col("_set") < F.col("_n")), F.when(here.isNull(), 0).otherwise(by_position + 1))
            .when(F.col("_hi") > F.col("_lo"), by_position)
            .otherwise(piece(F.col(tie), F.col("_tie_lo"), F.col("_tie_hi")))
            .cast("bigint")
        )
        df = (
            _left_join(df, ranges, group)
            .withColumn(level, block)
            .withColumn(HOT, F.col("_n").isNotNull() if level == LEVELS[0] else F.col(HOT))
            .drop("_n", "_set", "_lo", "_hi", "_tie_lo", "_tie_hi")
        )
        group = [*group, level]
    return df


def _left_join(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with a broadcast side on columns that may be null on both sides."""
    renamed = small.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return df.join(F.broadcast(renamed), same, "left").drop(*[f"_on_{c}" for c in on])


def drop_blocks(df: DataFrame) -> DataFrame:
    return df.drop(HOT, *LEVELS)


def block_columns(df: DataFrame) -> list[str]:
    """The block columns of a frame, none when no timeline is heavy.

    The heavy flag follows from the key; as a partition column it lets filters on it pass below
    a window.
    """
    return [c for c in (HOT, *LEVELS) if c in df.columns]


def _local(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*key, *block_columns(df)).orderBy(*order)


def _with_carry(
    out: DataFrame, df: DataFrame, key: Sequence[str], name: str, aggregates: dict, carried
) -> DataFrame:
    """Add to ``out`` as ``name`` what each block inherits from the blocks before it: null in light
    timelines and in first blocks. The summary is computed from ``df``.
    """
    if not block_columns(df):
        kind = df.agg(*[v.alias(n) for n, v in aggregates.items()]).schema[0].dataType
        return out.withColumn(name, F.lit(None).cast(kind))
    across = Window.partitionBy(*key).orderBy(*LEVELS)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        df.filter(HOT)
        .groupBy(*key, *LEVELS)
        .agg(*[value.alias(name) for name, value in aggregates.items()])
    )
    carry = summary.select(*key, *LEVELS, carried(across, before).alias(name))
    return _left_join(out, carry, [*key, *LEVELS])


def with_previous(
    df: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Add ``prev_<column>``: the value in the row before, null in the first row of a timeline."""
    local = _local(df, key, order)
    first = F.row_number().over(local) == 1
    out = df.withColumn("_first", first)
    for c in columns:
        out = out.withColumn(f"_lag_{c}", F.lag(c).over(local))
    out = _with_carry(
        out,
        df,
        key,
        "_before",
        {"_last": F.max_by(F.struct(*columns), F.struct(*order))},
        lambda across, _: F.lag("_last").over(across),
    )
    for c in columns:
        out = out.withColumn(
            f"prev_{c}",
            F.when(F.col("_first"), F.col("_before")[c]).otherwise(F.col(f"_lag_{c}")),
        )
    return out.drop("_first", "_before", *[f"_lag_{c}" for c in columns])


def with_max_before(
    df: DataFrame, key: Sequence[str], order: Sequence[str], column: str, out: str
) -> DataFrame:
    """Add the maximum of ``column`` over all earlier rows, null in the first row."""
    local = _local(df, key, order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _with_carry(
            df.withColumn("_here", F.max(column).over(local)),
            df,
            key,
            "_before",
            {"_max": F.max(column)},
            lambda _, before: F.max("_max").over(before),
        )
        .withColumn(out, F.greatest("_here", "_before"))
        .drop("_here", "_before")
    )


def with_running_count(
    df: DataFrame, key: Sequence[str], order: Sequence[str], flag: Column, out: str
) -> DataFrame:
    """Add how many rows up to and including this one satisfy ``flag``."""
    local = _local(df, key, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_one", F.when(flag, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    return (
        _with_carry(
            df.withColumn("_here", F.sum("_one").over(local)),
            df,
            key,
            "_before",
            {"_sum": F.sum("_one")},
            lambda _, before: F.sum("_sum").over(before),
        )
        .withColumn(out, F.col("_here") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_here", "_before", "_one")
    )


def with_row_index(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add the 0-based position of a row in its timeline."""
    return with_running_count(df, key, order, F.lit(True), out).withColumn(out, F.col(out) - 1)


__all__ = [
    "HOT",
    "LEVELS",
    "ROWS_PER_BLOCK",
    "add_blocks",
    "block_columns",
    "drop_blocks",
    "with_max_before",
    "with_previous",
    "with_row_index",
    "with_running_count",
]
