"""Training-set assembly: samples, augmentation plan, split, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions import scoring, text
from squelch.operators import intervals, queues, timeline

# Augmentation parameters chosen at each multiplier, in output order.
AUGMENTATIONS = {
    1: {"time_stretch": [0.9]},
    2: {"time_stretch": [0.9], "pitch_shift": [-2]},
    4: {"time_stretch": [0.9, 1.1], "pitch_shift": [-2, 2]},
    8: {
        "time_stretch": [0.9, 1.1],
        "pitch_shift": [-2, 2],
        "volume": [-3, 3],
        "noise": [0.02, 0.05],
    },
    16: {
        "time_stretch": [0.85, 0.9, 1.1],
        "pitch_shift": [-4, -2, 2, 4],
        "volume": [-6, -3, 3, 6],
        "noise": [0.01, 0.02, 0.03, 0.05, 0.08],
    },
}


def plan(multiplier: int) -> list[tuple[str, float]]:
    """(type, parameter) of every augmented copy; a step in between acts like the lower one."""
    steps = [m for m in AUGMENTATIONS if m <= multiplier]
    if not steps:
        return []
    return [(kind, p) for kind, ps in AUGMENTATIONS[max(steps)].items() for p in ps]


def _suffix(kind: str, parameter: float) -> str:
    if kind == "time_stretch":
        return f"_tempo{parameter:.2f}".replace(".", "_")
    if kind == "noise":
        return f"_noise{parameter * 100:.0f}pct"
    sign = "p" if parameter > 0 else "m"
    unit, name = ("st", "pitch") if kind == "pitch_shift" else ("dB", "vol")
    return f"_{name}{sign}{abs(parameter):.0f}{unit}"


def clean_samples(
    labels: DataFrame, segments: DataFrame, normalized: bool = True, airband: bool = True
) -> DataFrame:
    """Labels without the unknown marker, joined to their segment, as original samples."""
    usable = labels.filter(text.without_marker(F.col("transcription")))
    return usable.join(segments, "segment_id").select(
        F.format_string("audio/seg_%s.mp3", F.col("segment_id").cast("string")).alias("audio"),
        scoring.effective_path(F.col("trimmed_file_path"), F.col("file_path")).alias("input_path"),
        F.col("transcription").alias("text"),
        "duration",
        F.lit("original").alias("source"),
        F.struct(
            F.lit(normalized).alias("normalized"), F.lit(airband).alias("airband_filtered")
        ).alias("processing"),
        "segment_id",
        "label_id",
        F.nullif(F.col("response"), F.lit("")).alias("context"),
        "created_at",
    )


def augmented_samples(samples: DataFrame, multiplier: int) -> DataFrame:
    """Exactly the planned copies of every sample; the plan is a constant array, no join.

    A tempo copy lasts duration / factor, the others as long as the original.
    """
    copies = [
        F.struct(
            F.lit(kind).alias("type"),
            F.lit(_suffix(kind, p)).alias("suffix"),
            F.lit(p if kind == "time_stretch" else None).cast("double").alias("factor"),
            F.lit(p if kind == "pitch_shift" else None).cast("int").alias("semitones"),
            F.lit(p if kind == "volume" else None).cast("int").alias("db_change"),
            F.lit(p if kind == "noise" else None).cast("double").alias("noise_level"),
        )
        for kind, p in plan(multiplier)
    ]
    if not copies:
        return samples.withColumn("aug", F.lit(None)).filter(F.lit(False))
    return (
        samples.withColumn("aug", F.explode(F.array(*copies)))
        .withColumn("original_audio", F.col("audio"))
        .withColumn("audio", F.concat(F.regexp_replace("audio", r"\.mp3$", ""), "aug.suffix", F.lit(".mp3")))
        .withColumn("duration", F.col("duration") / F.coalesce("aug.factor", F.lit(1.0)))
        .withColumn("source", F.lit("augmented"))
    )


def manifest(samples: DataFrame, multiplier: int) -> DataFrame:
    """Originals and their augmented copies."""
    return samples.unionByName(augmented_samples(samples, multiplier), allowMissingColumns=True)


def chunk_samples(
    segments: DataFrame,
    labels: DataFrame,
    regions: DataFrame,
    apply_min_gap: bool = False,
    min_duration: float = 0.5,
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> DataFrame:
    """Chunk samples of split segments: i-th chunk with the i-th text piece, '' when absent.

    ``segments``: segment_id, chunks, duration; ``labels``: segment_id, label_id, transcription,
    response (the first label counts); ``regions``: segment_id, seq, start, end. Chunk lengths
    ignore the minimum gap unless ``apply_min_gap``; a chunk without a gap lasts 0 seconds.
    """
    split = segments.filter(F.col("chunks") > 0)
    clips = split.select("segment_id", "duration")
    own = regions.join(clips.select("segment_id"), "segment_id", "left_semi")
    if apply_min_gap:
        lengths = intervals.clean_chunks(
            own, clips, "segment_id", "seq", min_duration, rows_per_block
        ).select("segment_id", "chunk_index", "duration")
    else:
        lengths = intervals.chunk_durations(own, clips, "segment_id", "seq", rows_per_block)
    marked = own.groupBy("segment_id").agg(F.count("*").alias("_regions"))
    first_label = labels.groupBy("segment_id").agg(
        F.min_by(F.struct("transcription", "response"), "label_id").alias("label")
    )
    pieces = F.when(
        F.coalesce(F.col("_regions"), F.lit(0)) == 0, F.array("label.transcription")
    ).otherwise(text.split_at_marker(F.col("label.transcription")))
    return (
        split.join(first_label, "segment_id")
        .filter(F.coalesce("label.transcription", F.lit("")) != "")
        .join(marked, "segment_id", "left")
        .withColumn("_pieces", pieces)
        .withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("chunk_index", F.col("chunk_index").cast("bigint"))
        .drop("duration")
        .join(lengths, ["segment_id", "chunk_index"], "left")
        .select(
            F.format_string(
                "audio/chunk_%s_%d.mp3", F.col("segment_id").cast("string"), "chunk_index"
            ).alias("audio"),
            F.coalesce(F.get("_pieces", F.col("chunk_index").cast("int")), F.lit("")).alias("text"),
            F.coalesce("duration", F.lit(0.0)).alias("duration"),
            F.lit("split_chunk").alias("source"),
            "segment_id",
            "chunk_index",
            F.nullif(F.col("label.response"), F.lit("")).alias("context"),
        )
    )


def split_segments(
    segments: DataFrame,
    labels: DataFrame,
    regions: DataFrame,
    now: Column,
    min_duration: float = 0.5,
    rows_per_block: int = timeline.ROWS_PER_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """Chunk segments and their labels, cut around unknown regions.

    Labels copy the newest label of the parent; the i-th chunk takes the i-th text piece. A
    parent without a label gets neither, and a parent without a clean chunk none.
    """
    chunks = intervals.clean_chunks(
        regions,
        segments.select("segment_id", "duration"),
        "segment_id",
        "seq",
        min_duration,
        rows_per_block,
    )
    newest = queues.latest(
        labels, "segment_id", "created_at", "label_id",
        ["transcription", "response", "confidence", "user_id"],
    )
    owned = regions.select("segment_id").distinct()
    labelled = chunks.join(owned, "segment_id", "left_semi").join(newest, "segment_id")
    new_id = F.concat_ws(
        "_chunk", F.col("segment_id").cast("string"), F.col("chunk_index").cast("string")
    )
    pieces = text.split_at_marker(F.col("transcription"))
    return (
        labelled.select(
            new_id.alias("segment_id"),
            F.col("segment_id").alias("parent_segment_id"),
            "chunk_index",
            "start",
            "duration",
            F.lit(True).alias("is_chunk"),
        ),
        labelled.select(
            new_id.alias("segment_id"),
            F.coalesce(F.get(pieces, F.col("chunk_index").cast("int")), F.lit("")).alias(
                "transcription"
            ),
            "response",
            "confidence",
            "user_id",
            now.alias("created_at"),
        ),
    )


def union_samples(
    clean: DataFrame, chunks: DataFrame, segments: DataFrame, dedup: bool = False
) -> DataFrame:
    """Clean samples and chunk samples; ``dedup`` drops clean samples that are chunks themselves."""
    if dedup:
        own = segments.filter("is_chunk").select("segment_id")
        clean = clean.join(own, "segment_id", "left_anti")
    return clean.unionByName(chunks, allowMissingColumns=True)


def with_split(
    samples: DataFrame, key: str, validation_percent: int = 15, seed: int = 42
) -> DataFrame:
    """Train / validation by a hash of the clip, so copies of a clip stay on one side."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(100))
    return samples.withColumn(
        "split", F.when(bucket < validation_percent, "validation").otherwise("train")
    )


def with_arithmetic_split(
    samples: DataFrame, key: str, validation_percent: int = 15, seed: int = 42
) -> DataFrame:
    """The same for integer keys with a multiplicative hash that any SQL engine can repeat."""
    bucket = F.pmod(
        F.shiftright(
            F.pmod(
                F.pmod(F.col(key) + seed, F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32)
            ),
            16,
        ),
        F.lit(100),
    )
    return samples.withColumn(
        "split", F.when(bucket < validation_percent, "validation").otherwise("train")
    )


def training_steps(
    rows: Column, batch: int, accumulation: int, epochs: int, warmup: float
) -> Column:
    """Steps per epoch (at least 1), in all, and for warm-up."""
    per_epoch = F.greatest(F.lit(1), F.floor(rows / F.lit(batch * accumulation)))
    total = per_epoch * epochs
    return F.struct(
        per_epoch.cast("bigint").alias("steps_per_epoch"),
        total.cast("bigint").alias("total_steps"),
        F.floor(total * warmup).cast("bigint").alias("warmup_steps"),
    )


def composition(samples: DataFrame, *by: str) -> DataFrame:
    """Samples by origin and minutes."""
    return samples.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.count_if(F.col("source") == "original").alias("original"),
        F.count_if(F.col("source") == "augmented").alias("augmented"),
        F.coalesce(F.sum("duration") / 60, F.lit(0.0)).alias("minutes"),
    )


def export_summary(samples: DataFrame, *by: str) -> DataFrame:
    duration = F.coalesce(F.col("duration"), F.lit(0.0))
    return samples.groupBy(*by).agg(
        F.count("*").alias("total_samples"),
        F.count_if(F.col("source") == "original").alias("original_samples"),
        F.count_if(F.col("source") == "augmented").alias("augmented_samples"),
        F.coalesce(F.sum(duration), F.lit(0.0)).alias("total_duration_seconds"),
        F.coalesce(F.avg(duration), F.lit(0.0)).alias("average_duration_seconds"),
    )


def export_preview(samples: DataFrame, multiplier: int = 8) -> DataFrame:
    """What an export would hold, with estimates for the augmented set."""
    counted = samples.agg(
        F.count("*").alias("labeled_segments"),
        F.coalesce(F.sum(F.coalesce("duration", F.lit(0.0))), F.lit(0.0)).alias("total_seconds"),
    )
    return counted.select(
        "*",
        F.round(F.col("total_seconds") / 60, 1).alias("total_minutes"),
        (F.col("labeled_segments") * (1 + multiplier)).alias("estimated_samples"),
        (F.col("total_seconds") * (1 + multiplier)).alias("estimated_seconds"),
    )
