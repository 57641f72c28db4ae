"""Scores, bands and routing: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from squelch.functions.expr import let

TOP_WEIGHTS = [0.6, 0.25, 0.15]
PRIORITY_WEIGHTS = {"low": 0.3, "medium": 0.6, "high": 0.9, "critical": 1.0}


def _bands(value: Column, cuts: list[tuple[float, str]], otherwise: str) -> Column:
    """First label whose lower bound the value reaches; null gets the last one."""
    out = F.when(value >= cuts[0][0], cuts[0][1])
    for bound, label in cuts[1:]:
        out = out.when(value >= bound, label)
    return out.otherwise(otherwise)


def confidence_band(c: Column) -> Column:
    return _bands(c, [(0.85, "HIGH"), (0.70, "MEDIUM"), (0.50, "LOW")], "VERY LOW")


def severity_level(score: Column) -> Column:
    return _bands(score, [(0.85, "critical"), (0.70, "high"), (0.50, "medium")], "low")


def severity_from_confidence(c: Column) -> Column:
    return _bands(c, [(0.85, "low"), (0.70, "medium"), (0.50, "high")], "critical")


def word_band(c: Column) -> Column:
    return F.when(c.isNull(), "no data").otherwise(
        _bands(c, [(0.90, "high"), (0.70, "medium")], "low")
    )


def quality_label(score: Column) -> Column:
    return F.when(score.isNull() | (score == 0), "N/A").otherwise(
        _bands(score, [(0.8, "Excellent"), (0.6, "Good"), (0.4, "Fair")], "Poor")
    )


def interest_label(score: Column) -> Column:
    return F.when(score >= 0.65, "INTERESTING").otherwise("ROUTINE")


def custom_match_severity(priority: Column) -> Column:
    return (
        F.when(priority == "critical", 1.0)
        .when(priority == "high", 0.8)
        .when(priority == "medium", 0.6)
        .otherwise(0.4)
    )


def lifecycle_label(
    label_count: Column, rlhf_candidate: Column, needs_review: Column, status: Column
) -> Column:
    """Where a segment stands between arrival and training use."""
    ranking = status.eqNullSafe(F.lit("needs_ranking"))
    candidate = F.coalesce(rlhf_candidate, F.lit(False))
    labelled = (
        F.when(candidate & ranking, "READY_FOR_RANKING")
        .when(candidate, "LABELED_RLHF")
        .otherwise("LABELED_SFT")
    )
    return (
        F.when(label_count > 0, labelled)
        .when(F.coalesce(needs_review, F.lit(False)), "NEEDS_REVIEW")
        .when(ranking, "PENDING_RANKING")
        .otherwise(F.upper(F.coalesce(F.nullif(status, F.lit("")), F.lit("pending"))))
    )


def quality_from_volume(mean_volume: Column) -> Column:
    """-60 dB maps to 0, -20 dB to 1; 0.5 when the volume is unknown."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (mean_volume + 60) / 40))
    return F.when(mean_volume.isNull(), 0.5).otherwise(scaled)


def volume_variance(mean_volume: Column, max_volume: Column) -> Column:
    """|max - mean|; a missing or zero volume counts as no variance."""
    known = (F.coalesce(mean_volume, F.lit(0.0)) != 0) & (F.coalesce(max_volume, F.lit(0.0)) != 0)
    return F.when(known, F.abs(max_volume - mean_volume)).otherwise(0.0)


def overlap(variance: Column, peak: Column) -> Column:
    """Stepped-on transmission heuristic."""
    high_peak = F.coalesce((peak != 0) & (peak > -3), F.lit(False))
    detected = (variance > 10) & high_peak
    return F.struct(
        detected.alias("detected"),
        F.when(detected, 0.7).otherwise(0.3).alias("confidence"),
        (variance > 10).alias("high_variance"),
        high_peak.alias("high_peak"),
    )


def communication_quality(
    confidence: Column, speech_density: Column, variance: Column, overlapping: Column
) -> Column:
    """Score from 1 downwards with the reasons; a null confidence counts as low."""
    low_confidence = confidence.isNull() | (confidence < 0.7)
    low_density = F.coalesce(speech_density < 0.5, F.lit(False))
    loud = F.coalesce(variance > 15, F.lit(False))
    stepped_on = F.coalesce(overlapping, F.lit(False))
    checks = [
        (low_confidence, 0.2, "low_transcription_confidence"),
        (low_density, 0.1, "low_speech_density"),
        (loud, 0.15, "high_volume_variance"),
        (stepped_on, 0.2, "overlapping_transmissions"),
    ]
    score = F.lit(1.0)
    for met, penalty, _ in checks:
        score = score - F.when(met, penalty).otherwise(0.0)
    return F.struct(
        F.greatest(F.lit(0.0), score).alias("score"),
        F.array_compact(F.array(*[F.when(met, name) for met, _, name in checks])).alias("issues"),
        confidence.alias("clarity"),
        (1 - variance / 30).alias("audio_quality"),
    )


def route(confidence: Column, threshold: float = 0.85) -> Column:
    """One-threshold routing decision of the detector."""
    sure = F.coalesce(confidence >= threshold, F.lit(False))
    return F.struct(
        (~sure).alias("is_edge_case"),
        F.when(sure, "generate_rlhf_variations").otherwise("human_labeling").alias("route"),
        (~sure).alias("needs_human_review"),
        sure.alias("rlhf_candidate"),
        F.when(sure, "high_confidence_transcription")
        .otherwise("low_confidence_transcription")
        .alias("reason"),
    )


def top_weighted(values: Column, weights: list[float] = TOP_WEIGHTS) -> Column:
    """Weighted sum of the largest values of an array; missing places add nothing."""

    def total(best: Column) -> Column:
        out = F.lit(0.0)
        for i, weight in enumerate(weights):
            out = out + F.coalesce(F.get(best, F.lit(i)) * weight, F.lit(0.0))
        return out

    return let(F.sort_array(values, asc=False), total)


def format_duration(seconds: Column) -> Column:
    """``h:mm:ss`` from one hour on, else ``m:ss``; nothing counts as ``0:00``."""
    s = F.floor(F.coalesce(seconds, F.lit(0.0))).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%d:%02d", minutes, rest)
    )


def format_size(size: Column) -> Column:
    """Two decimals in B, KB, MB or GB (1024 steps)."""
    size = size.cast("double")
    return (
        F.when(size.isNull() | (size == 0), "0 B")
        .when(size < 1024, F.format_string("%.2f B", size))
        .when(size < 1024**2, F.format_string("%.2f KB", size / 1024))
        .when(size < 1024**3, F.format_string("%.2f MB", size / 1024**2))
        .otherwise(F.format_string("%.2f GB", size / 1024**3))
    )


def format_date(moment: Column) -> Column:
    """``Jan 5, 2025, 03:07 PM``."""
    return F.date_format(moment, "MMM d, yyyy, hh:mm a")


def parse_clock(clock: Column) -> Column:
    """``HH:MM:SS.ss`` to seconds, null when malformed."""
    parts = [F.regexp_extract(clock, r"^(\d+):(\d{2}):(\d{2}(?:\.\d+)?)$", i) for i in (1, 2, 3)]
    hours, minutes, seconds = [F.nullif(p, F.lit("")).cast("double") for p in parts]
    return hours * 3600 + minutes * 60 + seconds


def effective_path(trimmed: Column, original: Column) -> Column:
    """Trimmed file when there is one."""
    return F.coalesce(F.nullif(trimmed, F.lit("")), original)


def is_audio_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(mp3|wav|m4a|flac)$")


def queue_status(queued: Column) -> Column:
    return F.when(queued, "pending").otherwise("active")


def words_per_minute(word_count: Column, duration: Column) -> Column:
    """Infinite for words in no time, null when there is neither."""
    return (
        F.when(duration != 0, word_count / (F.nullif(duration, F.lit(0.0)) / 60))
        .when(word_count > 0, F.lit(float("inf")))
        .otherwise(F.lit(None).cast("double"))
    )
