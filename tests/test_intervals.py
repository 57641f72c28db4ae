"""Interval operators against plain loops: edge cases, random regions, heavy clips."""

import random

import pytest

from squelch.operators import intervals

SCHEMA = "clip int, seq int, start double, end double"
EDGE_CASES = {
    1: [],
    2: [(0.0, 30.0)],
    3: [(2.0, 4.0), (4.0, 6.0)],
    4: [(2.0, 9.0), (3.0, 4.0), (12.0, 13.0)],
    5: [(10.0, 12.0), (1.0, 2.0)],
    6: [(5.0, 6.0), (5.0, 9.0), (5.0, 5.5)],
    7: [(5.0, 50.0)],
    8: [(35.0, 40.0)],
    9: [(0.5, 1.0), (1.1, 3.0), (5.0, 6.0), (26.0, 27.0)],
    10: [(0.0, 29.95)],
}
DURATION = 30.0


def random_regions(seed=3):
    rng = random.Random(seed)
    clips = {c: list(v) for c, v in EDGE_CASES.items()}
    for _ in range(400):
        clip = 100 if rng.random() < 0.6 else rng.randrange(101, 110)
        start = round(rng.uniform(0, 32), 2)
        clips.setdefault(clip, []).append((start, round(start + rng.expovariate(2), 2)))
    return clips


CLIPS = random_regions()


@pytest.fixture(scope="module", params=[1_000_000, 20])
def frames(request, spark):
    rows, seq = [], 0
    for clip, regions in CLIPS.items():
        for start, end in regions:
            seq += 1
            rows.append((clip, seq, start, end))
    regions = spark.createDataFrame(rows, SCHEMA)
    clips = spark.createDataFrame([(c, DURATION) for c in CLIPS], "clip int, duration double")
    return regions, clips, request.param


def ordered(regions):
    return sorted(regions, key=lambda r: r[0])


def gaps(regions, duration):
    cursor, out = 0.0, []
    for start, end in ordered(regions):
        out.append((cursor, start))
        cursor = end
    return [*out, (cursor, duration)]


def by_clip(df, *columns):
    out = {c: [] for c in CLIPS}
    for r in df.collect():
        out[r["clip"]].append(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns))
    return {c: sorted(v) for c, v in out.items()}


def rounded(pairs):
    return [(round(a, 6), round(b, 6)) for a, b in pairs]


def test_speech_segments(frames):
    regions, clips, block = frames
    df = intervals.speech_segments(regions, clips, rows_per_block=block)
    got = by_clip(df, "segment_index", "start", "end", "filename")
    for clip, own in CLIPS.items():
        kept = [(a, z) for a, z in gaps(own, DURATION) if 2 <= z - a <= 20]
        assert got[clip] == [
            (i, round(a, 6), round(z, 6), f"seg_{i + 1:03d}.mp3") for i, (a, z) in enumerate(kept)
        ]


def test_clean_chunks(frames):
    regions, clips, block = frames
    got = by_clip(intervals.clean_chunks(regions, clips, rows_per_block=block), "chunk_index", "start", "end")
    for clip, own in CLIPS.items():
        kept = [(a, z) for a, z in gaps(own, DURATION) if a < z and z - a >= 0.5]
        assert [(a, z) for _, a, z in got[clip]] == rounded(kept)
        assert [i for i, _, _ in got[clip]] == list(range(len(kept)))


def test_chunk_durations(frames):
    regions, clips, block = frames
    got = by_clip(intervals.chunk_durations(regions, clips, rows_per_block=block), "chunk_index", "duration")
    for clip, own in CLIPS.items():
        assert got[clip] == [(i, round(z - a, 6)) for i, (a, z) in enumerate(gaps(own, DURATION))]


def test_kept_regions(frames):
    regions, clips, block = frames
    got = by_clip(intervals.kept_regions(regions, clips, rows_per_block=block), "start", "end")
    for clip, own in CLIPS.items():
        cursor, kept = 0.0, []
        for start, end in ordered(own):
            if start < DURATION:
                if cursor < start:
                    kept.append((cursor, start))
                cursor = min(end, DURATION)
        if cursor < DURATION:
            kept.append((cursor, DURATION))
        assert got[clip] == sorted(rounded(kept))


def test_first_free_gap(frames):
    regions, clips, block = frames
    got = by_clip(intervals.first_free_gap(regions, clips, rows_per_block=block), "start", "end")
    for clip, own in CLIPS.items():
        cursor, found = 0.0, None
        for start, end in ordered(own):
            if start - cursor >= 0.1:
                found = (cursor, min(cursor + 5, start))
                break
            cursor = max(cursor, end)
        if found is None and DURATION - cursor >= 0.1:
            found = (cursor, min(cursor + 5, DURATION))
        assert got[clip] == (rounded([found]) if found else [])


def test_disjoint_gaps_and_regions_tile_the_clip(spark):
    regions = [(2.0, 3.0), (5.0, 9.0), (20.0, 21.0)]
    df = spark.createDataFrame([(1, i, a, z) for i, (a, z) in enumerate(regions)], SCHEMA)
    clips = spark.createDataFrame([(1, 30.0)], "clip int, duration double")
    chunks = intervals.clean_chunks(df, clips, min_duration=0.0).collect()
    pieces = sorted(regions + [(r["start"], r["end"]) for r in chunks])
    assert pieces[0][0] == 0.0 and pieces[-1][1] == 30.0
    assert all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))


@pytest.mark.parametrize("block", [1_000_000, 10])
def test_event_pairs(spark, block):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3]), float(i), i, rng.choice(["start", "end", "noise"])) for i in range(300)]
    df = spark.createDataFrame(rows, "clip int, t double, seq int, kind string")
    got = sorted(tuple(r) for r in intervals.pair_events(df, rows_per_block=block).collect())
    want = []
    for clip in (1, 2, 3):
        opened = None
        for c, t, _, kind in rows:
            if c == clip and kind == "start":
                opened = t
            elif c == clip and kind == "end" and opened is not None:
                want.append((clip, opened, t, t - opened))
                opened = None
    assert got == sorted(want)


def test_totals_of_empty_clip(spark):
    regions = spark.createDataFrame([(1, 1, 0.0, 5.0)], SCHEMA)
    clips = spark.createDataFrame([(1, 4.0), (2, 0.0)], "clip int, duration double")
    kept = {r["clip"]: r for r in intervals.removed_and_kept(regions, clips).collect()}
    assert (kept[1]["removed"], kept[1]["kept"], kept[1]["kept_clamped"]) == (5.0, -1.0, 0.0)
    totals = {r["clip"]: r for r in intervals.silence_totals(regions, clips).collect()}
    assert totals[2]["speech_density"] == 0.0 and totals[2]["silence_count"] == 0


def test_long_segment_names(spark):
    df = spark.createDataFrame([(0,), (998,), (999,), (12344,)], "i bigint")
    names = [r[0] for r in df.select(intervals.segment_name(df["i"])).collect()]
    assert names == ["seg_001.mp3", "seg_999.mp3", "seg_1000.mp3", "seg_12345.mp3"]


def test_array_form_equals_table_form(spark):
    from pyspark.sql import functions as F

    regions = [(5.0, 6.0), (1.0, 2.0), (2.3, 4.0)]
    df = spark.createDataFrame(
        [([{"start": a, "end": z} for a, z in regions] + [{"start": None, "end": 3.0}], 10.0)],
        "r array<struct<start:double,end:double>>, d double",
    )
    got = df.select(intervals.clean_chunks_of_array(F.col("r"), F.col("d"))).first()[0]
    assert [(g["start"], g["end"]) for g in got] == [(0.0, 1.0), (4.0, 5.0), (6.0, 10.0)]


def test_clamp_region(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-1.0, 5.0), (9.0, 5.0), (3.0, 99.0)], "s double, e double")
    got = df.select(intervals.clamp_region(F.col("s"), F.col("e"), F.lit(30.0)).alias("r")).collect()
    assert [(r["r"]["start"], r["r"]["end"]) for r in got] == [(0.0, 5.0), (4.9, 5.0), (3.0, 30.0)]
