"""Frame features against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from squelch.operators import audio

FRAME, HOP = 64, 16


def numpy_features(y):
    e = np.array([np.sum(y[i : i + FRAME] ** 2) for i in range(0, len(y) - FRAME, HOP)])
    if len(e) == 0:
        return [], 0.0, 0.0, 0.0
    rms = np.sqrt(e / FRAME)
    return (
        e,
        np.mean(e > e.mean() + 1.8 * e.std()),
        np.mean(e < e.mean() - 1.5 * e.std()) if e.mean() > 0 else 0.0,
        rms.std() / (rms.mean() + 1e-6),
    )


@pytest.mark.parametrize("hop", [HOP, 24])
def test_features(spark, hop):
    rng = np.random.default_rng(1)
    spike = np.zeros(1000)
    spike[500] = 9
    clips = [
        rng.normal(size=1000), np.ones(500), np.zeros(300), spike, rng.normal(size=10),
        rng.normal(size=FRAME), rng.normal(size=FRAME + 1),
    ]
    df = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(clips)], "id int, samples array<float>")
    got = {r["id"]: r for r in audio.with_frame_features(df, "samples", FRAME, hop).collect()}
    for i, clip in enumerate(clips):
        y = clip.astype("float32").astype("float64")
        row = got[i]
        if hop == HOP:
            e, spikes, drops, variation = numpy_features(y)
            assert row["energies"] == pytest.approx(list(e))
            assert row["spike_ratio"] == pytest.approx(spikes)
            assert row["drop_ratio"] == pytest.approx(drops)
            assert row["energy_variation"] == pytest.approx(variation, abs=1e-7)
        else:
            e = [np.sum(y[j : j + FRAME] ** 2) for j in range(0, len(y) - FRAME, hop)]
            assert row["energies"] == pytest.approx(e)
        assert row["volume_variance"] == pytest.approx(np.abs(y).std(), abs=1e-9)
        assert row["max_amplitude"] == pytest.approx(np.abs(y).max())


def test_percentile_and_snr(spark):
    rng = np.random.default_rng(2)
    values = [np.abs(rng.normal(size=n)) for n in (1, 2, 37, 400)] + [np.zeros(5)]
    df = spark.createDataFrame([([float(x) for x in v],) for v in values], "v array<double>")
    got = df.select(audio.percentile(F.col("v"), 0.15), audio.snr(F.col("v"))).collect()
    for row, v in zip(got, values):
        assert row[0] == pytest.approx(np.percentile(v, 15))
        floor = np.percentile(v, 15)
        assert row[1] == (pytest.approx(v.mean() / floor) if floor > 0 else float("inf"))


def test_patterns_at_the_edges(spark):
    df = spark.createDataFrame([(2.0,), (1.9,), (20.0,), (20.1,)], "d double")
    got = [r[0]["pattern"] for r in df.select(audio.duration_pattern(F.col("d"))).collect()]
    assert got == [None, "cut_off", None, "long_duration"]
    silence = spark.createDataFrame([(0.6, 9.0), (0.61, 9.0), (0.05, 9.0), (0.05, 5.0), (None, 5.0)], "s double, d double")
    got = silence.select(audio.silence_pattern(F.col("s"), F.col("d")).alias("p")).collect()
    assert [(r["p"]["value"], r["p"]["pattern"]) for r in got] == [
        (0.6, None), (0.2, "excessive_silence"), (0.25, "continuous_speech"), (0.05, None), (0.0, None)
    ]
    infinite = spark.range(1).select(audio.snr_pattern(F.lit(float("inf"))).alias("p")).first()["p"]
    assert (infinite["value"], infinite["pattern"]) == (1.0, None)
