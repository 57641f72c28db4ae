"""Queries over decoded samples: frame features and the audio-first score."""

from __future__ import annotations

from pyspark.sql import functions as F

from squelch.functions.expr import unnest
from squelch.operators import audio
from squelch.plans import bindings as b
from squelch.plans.registry import query

FRAME, HOP = 16, 4

FRAMES = f"""samples AS (
  SELECT vec_id AS clip, list_transform(embedding, lambda x: x::DOUBLE) AS y FROM embeddings),
frames AS (SELECT clip, y, list_transform(range(0, len(y) - {FRAME}, {HOP}),
    lambda i: list_sum(list_transform(y[i + 1:i + {FRAME}], lambda x: x * x))) AS e FROM samples),
stats AS (SELECT clip, y, e, list_avg(e) AS m, list_stddev_pop(e) AS s,
    list_transform(e, lambda x: sqrt(x / {FRAME})) AS rms,
    list_transform(y, lambda x: abs(x)) AS a FROM frames),
shares AS (SELECT *,
    len(list_filter(e, lambda x: x > m + s * 1.8::DOUBLE))::DOUBLE / len(e) AS spike_ratio,
    len(list_filter(e, lambda x: x < m - s * 1.5::DOUBLE))::DOUBLE / len(e) AS drop_ratio,
    list_stddev_pop(rms) / (list_avg(rms) + 1e-6) AS variation FROM stats)"""


def features(spark, path):
    return audio.with_frame_features(b.clip_samples(spark, path), "samples", FRAME, HOP)


def _rounded(df):
    return df.select(
        *[
            F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query(
    "frame_energy",
    f"""WITH {FRAMES} SELECT clip, generate_subscripts(e, 1) - 1 AS frame,
  ROUND(unnest(e), 6) AS energy FROM frames""",
)
def frame_energy(spark, path):
    energies = audio.frame_energies(F.col("samples"), FRAME, HOP)
    numbered = F.transform(
        energies, lambda e, i: F.struct(i.cast("bigint").alias("frame"), e.alias("energy"))
    )
    rows = unnest(b.clip_samples(spark, path), numbered, "f", "clip")
    return _rounded(rows.select("clip", "f.*"))


@query(
    "spike_ratio",
    f"""WITH {FRAMES} SELECT clip, ROUND(spike_ratio, 6) AS spike_ratio,
  ROUND(drop_ratio, 6) AS drop_ratio,
  CASE WHEN spike_ratio > 0.08::DOUBLE THEN 'volume_spike'
    WHEN drop_ratio > 0.12::DOUBLE THEN 'audio_distortion' END AS pattern,
  CASE WHEN spike_ratio > 0.08::DOUBLE THEN 0.4::DOUBLE WHEN drop_ratio > 0.12::DOUBLE THEN 0.35
    ELSE 0 END AS value FROM shares""",
)
def spike_ratio(spark, path):
    df = features(spark, path).withColumn(
        "p", audio.spike_pattern(F.col("spike_ratio"), F.col("drop_ratio"))
    )
    return _rounded(df.select("clip", "spike_ratio", "drop_ratio", "p.pattern", "p.value"))


@query(
    "energy_variation",
    f"""WITH {FRAMES} SELECT clip, ROUND(variation, 6) AS variation,
  CASE WHEN variation > 1 THEN 'severe_interference' WHEN variation > 0.7::DOUBLE THEN 'stepped_on'
    WHEN variation > 0.5::DOUBLE THEN 'audio_instability' END AS pattern,
  ROUND(CASE WHEN variation > 1 THEN 0.45::DOUBLE WHEN variation > 0.7::DOUBLE THEN 0.4
    WHEN variation > 0.5::DOUBLE THEN 0.3 ELSE variation END, 6) AS value FROM shares""",
)
def energy_variation(spark, path):
    df = features(spark, path).withColumn("p", audio.variation_pattern(F.col("energy_variation")))
    return _rounded(
        df.select("clip", F.col("energy_variation").alias("variation"), "p.pattern", "p.value")
    )


@query(
    "amplitude_stats",
    f"""WITH {FRAMES} SELECT clip, ROUND(list_stddev_pop(a), 6) AS volume_variance,
  ROUND(list_max(a), 6) AS max_amplitude FROM stats""",
)
def amplitude_stats(spark, path):
    return _rounded(features(spark, path).select("clip", "volume_variance", "max_amplitude"))


_SNR = "list_avg(a) / list_aggregate(a, 'quantile_cont', 0.15::DOUBLE)"


@query(
    "snr_band",
    f"""WITH {FRAMES}, n AS (SELECT clip, {_SNR} AS snr FROM stats)
SELECT clip, ROUND(snr, 6) AS snr, CASE WHEN snr < 6 THEN 'poor_quality'
    WHEN snr < 10 THEN 'moderate_interference' WHEN snr < 15 THEN 'light_interference' END AS pattern,
  ROUND(CASE WHEN snr < 6 THEN 0.55::DOUBLE WHEN snr < 10 THEN 0.45 WHEN snr < 15 THEN 0.35
    ELSE LEAST(snr / 25, 1) END, 6) AS value FROM n""",
)
def snr_band(spark, path):
    magnitudes = F.transform("samples", lambda x: F.abs(x.cast("double")))
    df = b.clip_samples(spark, path).select("clip", audio.snr(magnitudes).alias("snr"))
    df = df.withColumn("p", audio.snr_pattern(F.col("snr")))
    return _rounded(df.select("clip", "snr", "p.pattern", "p.value"))


_TESTS = [
    ("t_duration", "CASE WHEN duration > 20 THEN 0.3::DOUBLE WHEN duration < 2 THEN 0.4 END"),
    ("t_spike", "CASE WHEN spike_ratio > 0.08::DOUBLE THEN 0.4::DOUBLE WHEN drop_ratio > 0.12::DOUBLE"
     " THEN 0.35 END"),
    ("t_tempo", "CASE WHEN tempo > 200 THEN 0.25::DOUBLE WHEN tempo < 80 THEN 0.15 END"),
    ("t_silence", "CASE WHEN silence_ratio > 0.6::DOUBLE THEN 0.2::DOUBLE"
     " WHEN silence_ratio < 0.1::DOUBLE AND duration > 5 THEN 0.25 END"),
    ("t_snr_s", "CASE WHEN snr < 6 THEN 0.55::DOUBLE WHEN snr < 10 THEN 0.45 WHEN snr < 15 THEN 0.35 END"),
    ("t_overlap", "CASE WHEN variation > 1 THEN 0.45::DOUBLE WHEN variation > 0.7::DOUBLE THEN 0.4"
     " WHEN variation > 0.5::DOUBLE THEN 0.3 END"),
]


@query(
    "audio_composite",
    f"""WITH {FRAMES}, inputs AS (SELECT *, {_SNR} AS snr, CAST(clip % 30 AS DOUBLE) AS duration,
    CAST(60 + clip * 7 % 180 AS DOUBLE) AS tempo, CAST(clip * 13 % 100 AS DOUBLE) / 100 AS silence_ratio
  FROM shares),
tests AS (SELECT *, {", ".join(f"{sql} AS {name}" for name, sql in _TESTS)} FROM inputs),
summed AS (SELECT *, LEAST(1::DOUBLE, {" + ".join(f"COALESCE({n}, 0)" for n, _ in _TESTS)}) AS total
  FROM tests)
SELECT clip, ROUND(total, 3) AS score, total >= 0.65::DOUBLE AS should_transcribe,
  {" + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n, _ in _TESTS)} AS patterns,
  ROUND(COALESCE(t_silence, silence_ratio), 6) AS silence_feature,
  ROUND(COALESCE(t_snr_s, LEAST(snr / 25, 1)), 6) AS snr_feature,
  ROUND(COALESCE(t_overlap, variation), 6) AS variation_feature FROM summed""",
)
def audio_composite(spark, path):
    magnitudes = F.transform("samples", lambda x: F.abs(x.cast("double")))
    i = F.col("clip")
    df = (
        features(spark, path)
        .withColumn("snr", audio.snr(magnitudes))
        .withColumn("duration", (i % 30).cast("double"))
        .withColumn("tempo", (60 + i * 7 % 180).cast("double"))
        .withColumn("silence_ratio", (i * 13 % 100) / 100.0)
    )
    scored = audio.composite(df)
    return _rounded(
        scored.select(
            "clip", "score", "should_transcribe", F.size("patterns").alias("patterns"),
            "silence_feature", "snr_feature", "variation_feature",
        )
    )
