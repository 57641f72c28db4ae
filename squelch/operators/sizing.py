"""Broadcast only what is known to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 500_000


def broadcast_if_small(side: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a dimension of at most ``max_rows`` rows; leave a bigger one to a shuffled join,
    whose heavy keys adaptive execution splits.

    The check counts at most ``max_rows`` + 1 rows.
    """
    fits = side.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(side) if fits else side


def spread(df: DataFrame) -> DataFrame:
    """Give work that is heavy per row to all cores when the scan has fewer splits than cores.

    A table of a few files reads as a few tasks. On a big table there are more splits than cores and
    the frame is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
