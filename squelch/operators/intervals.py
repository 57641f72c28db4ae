"""Interval algebra inside recordings: pairing, gaps, kept regions, free space.

``regions`` frames hold one row per interval with a clip key, ``start``, ``end`` and a numeric
tie-break column; ``clips`` frames hold one row per clip with its ``duration``. The cursor rules
of the four gap operators differ on purpose: W2 and W3 take the end of the previous region, W4
that end limited to the clip, W5 the running maximum of ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.operators import sizing, timeline


def pair_events(
    events: DataFrame,
    key: str = "clip",
    time: str = "t",
    tie: str = "seq",
    kind: str = "kind",
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Pair each end event with the open start event.

    A repeated start overwrites and an unclosed tail drops, so with only start and end events an
    end closes exactly when the event right before it is a start.
    """
    only = events.filter(F.col(kind).isin("start", "end"))
    blocked = timeline.add_blocks(only, [key], [time, tie], rows_per_block)
    paired = timeline.with_previous(blocked, [key], [time, tie], [kind, time])
    return paired.filter(
        (F.col(kind) == "end") & (F.col(f"prev_{kind}") == "start")
    ).select(
        key,
        F.col(f"prev_{time}").alias("start"),
        F.col(time).alias("end"),
        (F.col(time) - F.col(f"prev_{time}")).alias("duration"),
    )


def _gaps(
    regions: DataFrame,
    clips: DataFrame,
    key: str,
    tie: str,
    cursor_end: Column,
    keep_gap: Column,
    keep_tail: Column,
    rows_per_block: int,
) -> tuple[DataFrame, DataFrame]:
    """Gaps before regions and the gap after the last one, with block columns on the first."""
    order = ["start", tie]
    blocked = timeline.add_blocks(regions, [key], order, rows_per_block)
    cursor = F.coalesce(F.col("prev_cursor_end"), F.lit(0.0))
    inner = (
        timeline.with_previous(
            blocked.withColumn("cursor_end", cursor_end), [key], order, ["cursor_end"]
        )
        .withColumn("gap_start", cursor)
        .withColumn("gap_end", F.col("start"))
        .filter(keep_gap)
    )
    last = regions.groupBy(key).agg(
        F.max_by(cursor_end, F.struct("start", tie)).alias("gap_start")
    )
    tail = (
        clips.select(key, "duration")
        .join(last, key, "left")
        .withColumn("gap_start", F.coalesce(F.col("gap_start"), F.lit(0.0)))
        .withColumn("gap_end", F.col("duration"))
        .filter(keep_tail)
    )
    return inner, tail


def _shape(inner: DataFrame, tail: DataFrame, key: str) -> DataFrame:
    columns = [
        F.col(key),
        F.col("gap_start").alias("start"),
        F.col("gap_end").alias("end"),
        (F.col("gap_end") - F.col("gap_start")).alias("duration"),
    ]
    return inner.select(*columns).unionByName(tail.select(*columns))


def _numbered(inner: DataFrame, tail: DataFrame, key: str, tie: str, out: str) -> DataFrame:
    """0-based index in region order; the tail comes last, so its index is the count of the others."""
    indexed = timeline.with_row_index(inner, [key], ["start", tie], out)
    counts = inner.groupBy(key).agg(F.count("*").alias(out))
    last = tail.join(counts, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))
    columns = [
        F.col(key),
        F.col(out).cast("bigint").alias(out),
        F.col("gap_start").alias("start"),
        F.col("gap_end").alias("end"),
        (F.col("gap_end") - F.col("gap_start")).alias("duration"),
    ]
    return indexed.select(*columns).unionByName(last.select(*columns))


def speech_segments(
    silences: DataFrame,
    clips: DataFrame,
    key: str = "clip",
    tie: str = "seq",
    min_duration: float = 2.0,
    max_duration: float = 20.0,
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Speech between silences with a duration in range, numbered and named per clip."""
    length = F.col("gap_end") - F.col("gap_start")
    keep = (length >= min_duration) & (length <= max_duration)
    inner, tail = _gaps(silences, clips, key, tie, F.col("end"), keep, keep, rows_per_block)
    return _numbered(inner, tail, key, tie, "segment_index").withColumn(
        "filename", segment_name(F.col("segment_index"))
    )


def segment_name(index: Column) -> Column:
    """``seg_001.mp3`` for index 0; longer numbers keep all digits."""
    return F.format_string("seg_%03d.mp3", index + 1)


def clean_chunks(
    unknown_regions: DataFrame,
    clips: DataFrame,
    key: str = "clip",
    tie: str = "seq",
    min_duration: float = 0.5,
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Audio between unknown regions of at least ``min_duration`` seconds."""
    length = F.col("gap_end") - F.col("gap_start")
    keep = (F.col("gap_start") < F.col("gap_end")) & (length >= min_duration)
    inner, tail = _gaps(unknown_regions, clips, key, tie, F.col("end"), keep, keep, rows_per_block)
    return _numbered(inner, tail, key, tie, "chunk_index")


def kept_regions(
    removed: DataFrame,
    clips: DataFrame,
    key: str = "clip",
    tie: str = "seq",
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """What a trim leaves: regions that start past the clip are ignored, ends are limited to it."""
    lengths = sizing.broadcast_if_small(clips.select(key, F.col("duration").alias("clip_duration")))
    inside = removed.join(lengths, key).filter(F.col("start") < F.col("clip_duration"))
    keep = F.col("gap_start") < F.col("gap_end")
    inner, tail = _gaps(
        inside,
        clips,
        key,
        tie,
        F.least(F.col("end"), F.col("clip_duration")),
        keep,
        keep,
        rows_per_block,
    )
    return _shape(inner, tail, key)


def first_free_gap(
    regions: DataFrame,
    clips: DataFrame,
    key: str = "clip",
    tie: str = "seq",
    min_gap: float = 0.1,
    length: float = 5.0,
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Earliest free gap of a clip, at most ``length`` long; clips without room drop out."""
    order = ["start", tie]
    blocked = timeline.add_blocks(regions, [key], order, rows_per_block)
    seen = timeline.with_max_before(blocked, [key], order, "end", "max_end")
    cursor = F.greatest(F.coalesce(F.col("max_end"), F.lit(0.0)), F.lit(0.0))
    inner = (
        seen.withColumn("gap_start", cursor)
        .filter(F.col("start") - F.col("gap_start") >= min_gap)
        .groupBy(key)
        .agg(
            F.min_by(
                F.struct("gap_start", F.col("start").alias("gap_end")), F.struct(*order)
            ).alias("gap")
        )
    )
    last = regions.groupBy(key).agg(F.max("end").alias("max_end"))
    tail = F.struct(cursor.alias("gap_start"), F.col("duration").alias("gap_end"))
    return (
        clips.select(key, "duration")
        .join(last, key, "left")
        .join(inner, key, "left")
        .withColumn(
            "gap",
            F.coalesce(
                F.col("gap"), F.when(F.col("duration") - cursor >= min_gap, tail)
            ),
        )
        .filter(F.col("gap").isNotNull() & (F.col("duration") > 0))
        .select(
            key,
            F.col("gap.gap_start").alias("start"),
            F.least(F.col("gap.gap_start") + length, F.col("gap.gap_end")).alias("end"),
        )
    )


def chunk_durations(
    unknown_regions: DataFrame,
    clips: DataFrame,
    key: str = "clip",
    tie: str = "seq",
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Length of the i-th gap with no filter; an index without a row counts as 0 seconds."""
    everything = F.lit(True)
    inner, tail = _gaps(
        unknown_regions, clips, key, tie, F.col("end"), everything, everything, rows_per_block
    )
    return _numbered(inner, tail, key, tie, "chunk_index").select(key, "chunk_index", "duration")


def clamp_region(start: Column, end: Column, duration: Column, minimum: float = 0.1) -> Column:
    """Edited bounds: the start is limited first, the end against the limited start."""
    new_start = F.greatest(F.lit(0.0), F.least(start, end - minimum))
    new_end = F.least(duration, F.greatest(end, new_start + minimum))
    return F.struct(new_start.alias("start"), new_end.alias("end"))


def removed_and_kept(
    regions: DataFrame, clips: DataFrame, key: str = "clip"
) -> DataFrame:
    """Removed seconds, kept seconds as they are and limited to zero, per clip."""
    removed = regions.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("removed"))
    total = F.coalesce(F.col("removed"), F.lit(0.0))
    return (
        clips.select(key, "duration")
        .join(removed, key, "left")
        .select(
            key,
            total.alias("removed"),
            (F.col("duration") - total).alias("kept"),
            F.greatest(F.lit(0.0), F.col("duration") - total).alias("kept_clamped"),
        )
    )


def silence_totals(silences: DataFrame, clips: DataFrame, key: str = "clip") -> DataFrame:
    """Count and total length of silences, and the share of speech (0 for an empty clip)."""
    totals = silences.groupBy(key).agg(
        F.count("*").alias("silence_count"),
        F.sum(F.col("end") - F.col("start")).alias("silence_total"),
    )
    total = F.coalesce(F.col("silence_total"), F.lit(0.0))
    return (
        clips.select(key, "duration")
        .join(totals, key, "left")
        .select(
            key,
            F.coalesce(F.col("silence_count"), F.lit(0)).alias("silence_count"),
            total.alias("silence_total"),
            F.when(F.col("duration") == 0, F.lit(0.0))
            .otherwise((F.col("duration") - total) / F.nullif(F.col("duration"), F.lit(0.0)))
            .alias("speech_density"),
        )
    )


def valid_regions(regions: Column) -> Column:
    """Keep array entries with both bounds set."""
    return F.filter(regions, lambda r: r["start"].isNotNull() & r["end"].isNotNull())


def clean_chunks_of_array(regions: Column, duration: Column, min_duration: float = 0.5) -> Column:
    """``clean_chunks`` on a region array of one row: no shuffle, for segments of ordinary size."""
    ordered = F.array_sort(
        valid_regions(regions),
        lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0),
    )
    starts = F.concat(F.array(F.lit(0.0)), F.transform(ordered, lambda r: r["end"]))
    ends = F.concat(F.transform(ordered, lambda r: r["start"]), F.array(duration))
    return F.filter(
        F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(s.alias("start"), e.alias("end"), (e - s).alias("duration")),
        ),
        lambda g: (g["start"] < g["end"]) & (g["duration"] >= min_duration),
    )
