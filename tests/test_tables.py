"""Merging, nesting, deleting, uploading and stats on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from squelch.operators import dataset, queues, stats, tables


def test_merge_keeps_old_values_unless_nullable(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, n string")
    updates = spark.createDataFrame([(1, None, None)], "id int, v string, n string")
    got = {r["id"]: tuple(r) for r in tables.merge_updates(table, updates, "id", ["n"]).collect()}
    assert got == {1: (1, "a", None), 2: (2, "b", "y")}


def test_nested_children_page_heavy_parents(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    rows = [(1, i) for i in range(95)] + [(2, 5)]
    children = spark.createDataFrame(rows, "id int, n int")
    nested = queues.nest_children(
        parents, children, "id", ["n"], ["n"], page_size=10, rows_per_block=7
    ).collect()
    own = sorted((r["offset"], [c["n"] for c in r["children"]]) for r in nested if r["id"] == 1)
    assert len(own) >= 10 and all(ns[0] == offset and len(ns) <= 10 for offset, ns in own)
    assert [n for _, ns in own for n in ns] == list(range(95))
    assert [(r["offset"], r["children"]) for r in nested if r["id"] == 3] == [(0, None)]


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_uploads_to_one_recording(spark, block):
    segments = spark.createDataFrame([("UPLOAD",)] * 4 + [("other",)], "recording_id string")
    uploads = spark.createDataFrame(
        [("UPLOAD", i, f"f{i}", i) for i in range(60)] + [("new", 0, "f", 1)],
        "recording_id string, seq int, file_path string, size int",
    )
    got = tables.append_uploads(segments, uploads, ["seq"], block).collect()
    assert {r["file_path"]: r["segment_index"] for r in got if r["recording_id"] == "UPLOAD"} == {
        f"f{i}": 5 + i for i in range(60)
    }
    assert [r["segment_index"] for r in got if r["recording_id"] == "new"] == [1]


def test_default_recording_is_added_once(spark):
    recordings = spark.createDataFrame([("r", "KJFK", "tower")], "id string, airport string, facility string")
    once = tables.default_recording(recordings, F.current_timestamp())
    twice = tables.default_recording(once, F.current_timestamp())
    assert once.count() == twice.count() == 2


def test_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.9)], "id int, confidence double")
    low = [r["id"] for r in queues.page(df, queues.lowest_first("confidence", "id")).collect()]
    high = [r["id"] for r in queues.top_by_confidence(df, None).collect()]
    assert (low, high) == ([2, 3, 1], [1, 3, 2])
    assert [r["id"] for r in queues.top_by_confidence(df, 2).collect()] == [1, 3]
    page = queues.page(df, queues.lowest_first("confidence", "id"), offset=1, limit=1)
    assert [r["id"] for r in page.collect()] == [3]


def test_facets(spark):
    df = spark.createDataFrame(
        [(1, 0.85, 0, False), (2, 0.70, 1, False), (3, None, 0, False), (4, 0.5, 0, True)],
        "id int, confidence double, label_count int, rlhf_candidate boolean",
    ).withColumn("airport", F.lit("K")).withColumn("status", F.lit("pending"))
    ids = lambda **f: [r["id"] for r in df.filter(queues.facet(**f)).collect()]
    assert ids(confidence="high") == [1]
    assert ids(confidence="medium") == [2]
    assert ids(confidence="low") == [4]
    assert ids(confidence="unanalyzed") == [3]
    assert ids(classification="unlabeled") == [1, 4]
    assert ids(classification="labeled", has_label=True, queued=True, airport="K") == [2]
    assert ids(classification="rlhf", airport="X") == []


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "duration double, source string")
    row = dataset.export_summary(empty).first()
    assert (row["total_samples"], row["total_duration_seconds"], row["average_duration_seconds"]) == (0, 0.0, 0.0)
    counts = spark.createDataFrame([], "airport string, n bigint")
    assert stats.shares(counts, "n").count() == 0


@pytest.mark.parametrize("multiplier, copies", [(0, 0), (1, 1), (2, 2), (3, 2), (4, 4), (8, 8), (16, 16)])
def test_augmentation_counts(spark, multiplier, copies):
    assert len(dataset.plan(multiplier)) == copies


def test_golden_export(spark):
    """55 clips with the four-fold plan give 275 samples."""
    samples = spark.range(55).select(
        F.format_string("audio/seg_%d.mp3", "id").alias("audio"),
        F.lit(9.0).alias("duration"),
        F.lit("original").alias("source"),
    )
    out = dataset.manifest(samples, 4)
    row = dataset.export_summary(out).first()
    assert (row["total_samples"], row["original_samples"], row["augmented_samples"]) == (275, 55, 220)
    names = {r["audio"]: r["duration"] for r in out.filter("audio LIKE '%seg_7_%'").collect()}
    assert names["audio/seg_7_tempo0_90.mp3"] == pytest.approx(10.0)
    assert names["audio/seg_7_pitchm2st.mp3"] == 9.0
    full = dataset.augmented_samples(samples, 16).select("audio").collect()
    assert {"audio/seg_3_volp6dB.mp3", "audio/seg_3_noise8pct.mp3", "audio/seg_3_pitchp4st.mp3"} <= {
        r["audio"] for r in full
    }


def test_split_keeps_copies_together(spark):
    samples = spark.range(2000).select(
        F.col("id").alias("segment_id"), F.lit("a.mp3").alias("audio"), F.lit(1.0).alias("duration"),
        F.lit("original").alias("source"),
    )
    out = dataset.with_split(dataset.manifest(samples, 4), "segment_id")
    assert out.groupBy("segment_id").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    share = out.filter("split = 'validation'").count() / out.count()
    assert 0.12 < share < 0.18


def test_training_steps(spark):
    steps = spark.range(1).select(
        dataset.training_steps(F.lit(275), 4, 4, 5, 0.1).alias("s"),
        dataset.training_steps(F.lit(3), 4, 4, 5, 0.1).alias("t"),
    ).first()
    assert tuple(steps["s"]) == (17, 85, 8)
    assert tuple(steps["t"]) == (1, 5, 0)


def _chunk_inputs(spark):
    segments = spark.createDataFrame(
        [(1, 3, 30.0), (2, 1, 10.0), (3, 2, 10.0), (4, 0, 5.0)], "segment_id int, chunks int, duration double"
    )
    labels = spark.createDataFrame(
        [(1, 10, "a [UNKNOWN] b", "ctx", "high", "u", 1), (1, 11, "newer [UNKNOWN] one", "", "low", "u", 2),
         (2, 20, "whole [UNKNOWN] text", None, "high", "u", 1)],
        "segment_id int, label_id int, transcription string, response string, confidence string,"
        " user_id string, created_at int",
    )
    regions = spark.createDataFrame(
        [(1, 1, 0.2, 1.0), (1, 2, 10.0, 12.0), (3, 3, 1.0, 2.0)],
        "segment_id int, seq int, start double, end double",
    )
    return segments, labels, regions


def test_chunk_samples(spark):
    inputs = _chunk_inputs(spark)
    rows = {(r["segment_id"], r["chunk_index"]): r for r in dataset.chunk_samples(*inputs).collect()}
    got = {k: (r["text"], round(r["duration"], 6)) for k, r in rows.items()}
    # Unfiltered gap lengths; no label means no chunks; no regions means the whole text.
    assert got == {
        (1, 0): ("a", 0.2), (1, 1): ("b", 9.0), (1, 2): ("", 18.0),
        (2, 0): ("whole [UNKNOWN] text", 10.0),
    }
    strict = dataset.chunk_samples(*inputs, apply_min_gap=True).collect()
    assert {(r["segment_id"], r["chunk_index"]): r["duration"] for r in strict}[1, 2] == 0.0


def test_split_segments(spark):
    chunks, labels = dataset.split_segments(*_chunk_inputs(spark), F.lit(5))
    assert sorted((r["segment_id"], r["start"], r["duration"]) for r in chunks.collect()) == [
        ("1_chunk0", 1.0, 9.0), ("1_chunk1", 12.0, 18.0)
    ]
    assert {r["segment_id"]: r["transcription"] for r in labels.collect()} == {
        "1_chunk0": "newer", "1_chunk1": "one"
    }
