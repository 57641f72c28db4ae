"""Child counters kept by signed changes.

A change of a child row is its key with the parent before and after: an insert has no parent
before, a delete none after, a move both. Each change is at most two rows (parent, -1 or +1);
their sums, added to the counters so far, are the counters after it. Sums are mergeable, so batches
may come in any order, a hot parent costs one row per task, and a stream keeps one number per
parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions.expr import unnest


def signed(changes: DataFrame, old: str = "old_parent", new: str = "new_parent") -> DataFrame:
    """parent, delta: -1 for the parent before and +1 for the one after, nothing where they agree."""

    def entry(parent: str, delta: int) -> Column:
        moved = ~F.col(old).eqNullSafe(F.col(new)) & F.col(parent).isNotNull()
        return F.when(moved, F.struct(F.col(parent).alias("parent"), F.lit(delta).cast("bigint").alias("delta")))

    rows = unnest(changes, F.array_compact(F.array(entry(old, -1), entry(new, 1))), "c")
    return rows.select("c.parent", "c.delta")


def changed_counts(changes: DataFrame, old: str = "old_parent", new: str = "new_parent") -> DataFrame:
    """parent, delta summed over ``changes``; batch or stream."""
    return signed(changes, old, new).groupBy("parent").agg(F.sum("delta").alias("delta"))


def count_children(children: DataFrame, parent: str) -> DataFrame:
    """parent, n by counting the rows."""
    return children.groupBy(F.col(parent).alias("parent")).agg(F.count("*").alias("n")).filter(F.col("parent").isNotNull())


def apply_changes(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """parent, n after ``deltas`` (parent, delta); parents without children drop out."""
    both = counts.select("parent", "n").unionByName(deltas.select("parent", F.col("delta").alias("n")))
    return both.groupBy("parent").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def deleted(children: DataFrame, key: str, parent: str) -> DataFrame:
    """Change rows of deleted children."""
    return children.select(F.col(key).alias("id"), F.col(parent).alias("old_parent"), F.lit(None).cast(children.schema[parent].dataType).alias("new_parent"))


def cascade(
    doomed: DataFrame, segments: DataFrame, labels: DataFrame, recording: str = "recording_id", segment: str = "segment_id"
) -> tuple[DataFrame, DataFrame]:
    """Change rows of the segments and of the labels that go with the recordings in ``doomed``
    (column ``recording``). ``segments``: id and recording; ``labels``: id and segment.
    """
    gone = segments.join(doomed.select(recording).distinct(), recording, "left_semi")
    of_gone = labels.join(gone.select(F.col("id").alias(segment)), segment, "left_semi")
    return deleted(gone, "id", recording), deleted(of_gone, "id", segment)
