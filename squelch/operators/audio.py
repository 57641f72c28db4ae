"""Audio features on decoded sample arrays, one clip per row: no shuffle, no Python.

Clips are seconds long, so a clip is a row and its samples an array; frames are slices of it.
Frame starts run up to, not including, ``len - frame``, so a clip of exactly one frame has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions.expr import let

FRAME, HOP = 2048, 512


def frame_energies(samples: Column, frame: int = FRAME, hop: int = HOP) -> Column:
    """Sum of squares per frame.

    When the hop divides the frame, every sample is squared once: hop blocks are summed first and
    a frame is the sum of its blocks.
    """

    def energy(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def frames(y: Column) -> Column:
        starts = F.sequence(
            F.lit(0), F.floor(F.greatest(F.size(y) - frame - 1, F.lit(0)) / hop).cast("int")
        )
        if frame % hop:
            return F.transform(starts, lambda i: energy(F.slice(y, i * hop + 1, frame)))
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(F.size(y) / hop).cast("int")),
            lambda b: energy(F.slice(y, b * hop + 1, hop)),
        )
        return let(
            blocks,
            lambda bs: F.transform(starts, lambda i: total(F.slice(bs, i + 1, frame // hop))),
        )

    return let(
        samples,
        lambda y: F.when(F.size(y) > frame, frames(y)).otherwise(
            F.array().cast("array<double>")
        ),
    )


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(values) > 0, total / F.greatest(F.size(values), F.lit(1)))


def std(values: Column, average: Column) -> Column:
    """Population standard deviation around a known mean."""

    def squares(mu: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mu) * (x - mu))

    n = F.size(values)
    return F.when(n > 0, F.sqrt(let(average, squares) / F.greatest(n, F.lit(1))))


def percentile(values: Column, p: float) -> Column:
    """Linear interpolation between the two nearest ranks."""

    def at(ordered: Column) -> Column:
        rank = (F.size(ordered) - 1) * F.lit(p)
        low = F.floor(rank).cast("int")
        below = F.get(ordered, low)
        above = F.coalesce(F.get(ordered, low + 1), below)
        return below + (above - below) * (rank - low)

    return let(F.sort_array(values), at)


def with_frame_features(
    clips: DataFrame, samples: str = "samples", frame: int = FRAME, hop: int = HOP
) -> DataFrame:
    """Adds frame energies with their spike and drop shares, RMS variation, amplitude statistics."""
    e, m, s = F.col("energies"), F.col("energy_mean"), F.col("energy_std")

    def share(limit: Column, test) -> Column:
        hits = let(limit, lambda cut: F.size(F.filter(e, lambda x: test(x, cut))))
        return F.when(F.size(e) > 0, hits / F.greatest(F.size(e), F.lit(1))).otherwise(0.0)

    return (
        clips.withColumn("energies", frame_energies(F.col(samples), frame, hop))
        .withColumn("energy_mean", mean(e))
        .withColumn("energy_std", std(e, m))
        .withColumn("spike_ratio", share(m + s * 1.8, lambda x, cut: x > cut))
        .withColumn("drop_ratio", F.when(m > 0, share(m - s * 1.5, lambda x, cut: x < cut)).otherwise(0.0))
        .withColumn("_rms", F.transform(e, lambda x: F.sqrt(x / frame)))
        .withColumn("_rms_mean", mean(F.col("_rms")))
        .withColumn(
            "energy_variation",
            F.coalesce(
                std(F.col("_rms"), F.col("_rms_mean")) / (F.col("_rms_mean") + 1e-6), F.lit(0.0)
            ),
        )
        .withColumn("_abs", F.transform(samples, lambda x: F.abs(x.cast("double"))))
        .withColumn("_abs_mean", mean(F.col("_abs")))
        .withColumn("volume_variance", std(F.col("_abs"), F.col("_abs_mean")))
        .withColumn("max_amplitude", F.array_max("_abs"))
        .drop("_rms", "_rms_mean", "_abs", "_abs_mean")
    )


def _pattern(value: Column, name: Column) -> Column:
    return F.struct(value.cast("double").alias("value"), name.cast("string").alias("pattern"))


def _none(value) -> Column:
    return _pattern(value if isinstance(value, Column) else F.lit(value), F.lit(None))


def duration_pattern(duration: Column) -> Column:
    return (
        F.when(duration > 20, _pattern(F.lit(0.3), F.lit("long_duration")))
        .when(duration < 2, _pattern(F.lit(0.4), F.lit("cut_off")))
        .otherwise(_none(0.0))
    )


def spike_pattern(spike_ratio: Column, drop_ratio: Column) -> Column:
    return (
        F.when(spike_ratio > 0.08, _pattern(F.lit(0.4), F.lit("volume_spike")))
        .when(drop_ratio > 0.12, _pattern(F.lit(0.35), F.lit("audio_distortion")))
        .otherwise(_none(0.0))
    )


def tempo_pattern(tempo: Column) -> Column:
    return (
        F.when(tempo > 200, _pattern(F.lit(0.25), F.lit("rapid_speech")))
        .when(tempo < 80, _pattern(F.lit(0.15), F.lit("slow_speech")))
        .otherwise(_none(0.0))
    )


def silence_pattern(silence_ratio: Column, duration: Column) -> Column:
    """The plain ratio is the value when no pattern fires."""
    return (
        F.when(silence_ratio.isNull(), _none(0.0))
        .when(silence_ratio > 0.6, _pattern(F.lit(0.2), F.lit("excessive_silence")))
        .when(
            (silence_ratio < 0.1) & (duration > 5),
            _pattern(F.lit(0.25), F.lit("continuous_speech")),
        )
        .otherwise(_none(silence_ratio))
    )


def snr(magnitudes: Column) -> Column:
    """Mean spectral magnitude over its 15th percentile; infinite without a noise floor."""
    floor = percentile(magnitudes, 0.15)
    return F.when(floor > 0, mean(magnitudes) / F.nullif(floor, F.lit(0.0))).otherwise(
        F.lit(float("inf"))
    )


def snr_pattern(ratio: Column) -> Column:
    return (
        F.when(ratio < 6, _pattern(F.lit(0.55), F.lit("poor_quality")))
        .when(ratio < 10, _pattern(F.lit(0.45), F.lit("moderate_interference")))
        .when(ratio < 15, _pattern(F.lit(0.35), F.lit("light_interference")))
        .otherwise(_none(F.least(ratio / 25, F.lit(1.0))))
    )


def variation_pattern(variation: Column) -> Column:
    return (
        F.when(variation > 1.0, _pattern(F.lit(0.45), F.lit("severe_interference")))
        .when(variation > 0.7, _pattern(F.lit(0.4), F.lit("stepped_on")))
        .when(variation > 0.5, _pattern(F.lit(0.3), F.lit("audio_instability")))
        .otherwise(_none(variation))
    )


def composite(
    clips: DataFrame, threshold: float = 0.65, seconds_of_audio: str = "duration"
) -> DataFrame:
    """Sum of the fired patterns, at most 1; feature columns keep each test's returned value.

    Needs the columns of ``with_frame_features`` and tempo, silence_ratio and snr.
    """
    duration = F.col(seconds_of_audio)
    tests = {
        "_duration": duration_pattern(duration),
        "_spike": spike_pattern(F.col("spike_ratio"), F.col("drop_ratio")),
        "_tempo": tempo_pattern(F.col("tempo")),
        "_silence": silence_pattern(F.col("silence_ratio"), duration),
        "_snr": snr_pattern(F.col("snr")),
        "_overlap": variation_pattern(F.col("energy_variation")),
    }
    scored = clips
    for name, test in tests.items():
        scored = scored.withColumn(name, test)
    total = F.lit(0.0)
    for name in tests:
        total = total + F.when(F.col(name)["pattern"].isNotNull(), F.col(name)["value"]).otherwise(
            0.0
        )
    capped = F.least(total, F.lit(1.0))
    return (
        scored.withColumn("score", F.round(capped, 3))
        .withColumn("should_transcribe", capped >= threshold)
        .withColumn(
            "patterns", F.array_compact(F.array(*[F.col(n)["pattern"] for n in tests]))
        )
        .withColumn("silence_feature", F.col("_silence")["value"])
        .withColumn("snr_feature", F.col("_snr")["value"])
        .withColumn("variation_feature", F.col("_overlap")["value"])
        .drop(*tests)
    )
