"""Table maintenance as functions of whole tables: merge, append, delete, check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions.expr import unnest
from squelch.operators import sizing, timeline


def merge_updates(
    table: DataFrame, updates: DataFrame, key: str, nullable: Sequence[str] = ()
) -> DataFrame:
    """Keyed field update: set fields replace old ones.

    A null in ``updates`` keeps the old value, except for the ``nullable`` columns, which are taken
    as they are for every updated row. ``updates`` has one row per key.
    """
    changed = [c for c in updates.columns if c != key and c in table.columns]
    new = updates.select(key, F.struct(*changed).alias("_new"))
    hit = F.col("_new").isNotNull()
    columns = []
    for c in table.columns:
        if c in nullable and c in changed:
            value = F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c))
        elif c in changed:
            value = F.coalesce(F.col(f"_new.{c}"), F.col(c))
        else:
            value = F.col(c)
        columns.append(value.alias(c))
    return table.join(new, key, "left").select(*columns)


def delete_cascade(
    segments: DataFrame, labels: DataFrame, doomed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Segments and labels left after deleting the ids in ``doomed``."""
    ids = doomed.select("id")
    return (
        segments.join(ids, "id", "left_anti"),
        labels.join(ids.withColumnRenamed("id", "segment_id"), "segment_id", "left_anti"),
    )


def append_uploads(
    segments: DataFrame,
    uploads: DataFrame,
    order: Sequence[str],
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """New segment rows that continue the index of their recording at count + 1.

    ``uploads`` has recording_id, file_path, size and numeric ``order`` columns.
    """
    existing = segments.join(
        uploads.select("recording_id").distinct(), "recording_id", "left_semi"
    )
    counts = existing.groupBy("recording_id").agg(F.count("*").alias("_n"))
    blocked = timeline.add_blocks(uploads, ["recording_id"], order, rows_per_block)
    numbered = timeline.with_row_index(blocked, ["recording_id"], order, "_index")
    return numbered.join(counts, "recording_id", "left").select(
        "recording_id",
        (F.coalesce(F.col("_n"), F.lit(0)) + 1 + F.col("_index")).alias("segment_index"),
        "file_path",
        F.lit(0.0).alias("duration"),
        F.lit(0.0).alias("start_time"),
        "size",
        F.lit("active").alias("status"),
    )


def default_recording(recordings: DataFrame, now: Column) -> DataFrame:
    """Recording table with the manual-upload recording, added when it is missing."""
    wanted = recordings.sparkSession.range(1).select(
        F.lit("UPLOAD").alias("airport"),
        F.lit("manual").alias("facility"),
        F.lit("manual-upload").alias("source_url"),
        now.alias("recorded_at"),
        F.lit(0).alias("duration_seconds"),
        F.lit("segmented").alias("status"),
        F.lit("upload-manual").alias("id"),
    )
    new = wanted.join(recordings.select("airport", "facility"), ["airport", "facility"], "left_anti")
    return recordings.unionByName(new, allowMissingColumns=True)


def apply_reviews(
    segments: DataFrame, reviews: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Segments after review, and the labels that approvals create.

    ``reviews``: id, reviewed, approved, notes, manual_text, context, reviewer. A text replaces the
    transcript; approved with a text makes a high-confidence label and clears the review flag.
    """
    has_text = F.coalesce(F.col("manual_text"), F.lit("")) != ""
    approved = F.coalesce("approved", F.lit(False)) & has_text
    updates = reviews.select(
        "id",
        "reviewed",
        F.when(F.col("reviewed"), now).alias("reviewed_at"),
        F.nullif(F.col("notes"), F.lit("")).alias("review_notes"),
        F.nullif(F.col("reviewer"), F.lit("")).alias("reviewed_by"),
        F.when(has_text, F.col("manual_text")).alias("text"),
        F.when(approved, F.lit(False)).alias("needs_human_review"),
    )
    labels = reviews.filter(approved).select(
        F.col("id").alias("segment_id"),
        F.col("manual_text").alias("transcription"),
        F.nullif(F.col("context"), F.lit("")).alias("response"),
        F.lit("high").alias("confidence"),
        F.nullif(F.col("reviewer"), F.lit("")).alias("user_id"),
        now.alias("created_at"),
    )
    merged = merge_updates(
        segments, updates, "id", nullable=["reviewed", "reviewed_at", "review_notes", "reviewed_by"]
    )
    return merged, labels


def approval_without_text(approved: Column, manual_text: Column) -> Column:
    return F.coalesce(approved, F.lit(False)) & (
        F.trim(F.coalesce(manual_text, F.lit(""))) == ""
    )


def recording_length_ok(seconds: Column, low: int = 30, high: int = 3600) -> Column:
    return (seconds >= low) & (seconds <= high)


def duplicate_keys(table: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose key exists already."""
    return incoming.join(table.select(key), key, "left_semi")


def constraint_violations(
    segments: DataFrame, recordings: DataFrame, labels: DataFrame, statuses: Sequence[str]
) -> DataFrame:
    """(rule, id) rows for every broken range, enum, unique or foreign-key rule."""

    def out_of_unit(c: str) -> Column:
        return ~F.col(c).between(0, 1)

    checks = {
        "quality_range": out_of_unit("quality"),
        "confidence_range": out_of_unit("confidence"),
        "status_enum": ~F.col("status").isin(list(statuses)),
    }
    found = F.array_compact(
        F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    )
    rows = unnest(segments, found, "rule", F.col("id").cast("string").alias("id"))
    rows = rows.select("rule", "id")
    twice = (
        segments.groupBy("recording_id", "segment_index")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
        .select(
            F.lit("unique_index").alias("rule"),
            F.concat_ws("/", "recording_id", F.col("segment_index").cast("string")).alias("id"),
        )
    )
    known = sizing.broadcast_if_small(recordings.select("recording_id"))
    no_recording = segments.join(known, "recording_id", "left_anti")
    no_segment = labels.join(
        segments.select(F.col("id").alias("segment_id")), "segment_id", "left_anti"
    )
    return (
        rows.unionByName(twice)
        .unionByName(
            no_recording.select(
                F.lit("recording_fk").alias("rule"), F.col("id").cast("string").alias("id")
            )
        )
        .unionByName(
            no_segment.select(
                F.lit("segment_fk").alias("rule"), F.col("segment_id").cast("string").alias("id")
            )
        )
    )
