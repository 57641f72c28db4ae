"""Block-wise ordered operators against plain loops, with heavy timelines."""

import random

import pytest
from pyspark.sql import functions as F

from squelch.operators import timeline

ORDER = ["pos", "seq"]


def make_rows(kind, n=600, seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # One timeline holds two thirds of the rows.
        clip = 0 if rng.random() < 0.66 else rng.randrange(1, 20)
        pos = {
            "even": lambda: rng.uniform(0, 1000),
            "outlier": lambda: 1e9 if i == 0 else rng.uniform(0, 1),
            "tied": lambda: 5.0,
            "lumped": lambda: float(rng.choice([1, 1, 1, 1, 2, 900])),
            "unset": lambda: rng.choice([None, None, 3.0, 4.0, rng.uniform(0, 9)]),
        }[kind]()
        if kind == "unset" and clip == 0:
            clip = None
        value = None if rng.random() < 0.1 else rng.uniform(-5, 5)
        rows.append((clip, pos, i, value))
    return rows


def timelines(rows):
    by = {}
    first = lambda v: (v is not None, v or 0)
    for row in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), r[2])):
        by.setdefault(row[0], []).append(row)
    return by


@pytest.fixture(params=["even", "outlier", "tied", "lumped", "unset"])
def case(request, spark):
    rows = make_rows(request.param)
    df = spark.createDataFrame(rows, "clip int, pos double, seq int, v double")
    blocked = timeline.add_blocks(df, ["clip"], ORDER, rows_per_block=25)
    return rows, blocked


def collected(df, column):
    return {r["seq"]: r[column] for r in df.select("seq", column).collect()}


def test_blocks_are_ordered_and_small(case):
    rows, blocked = case
    seen = {r["seq"]: tuple(r[c] for c in timeline.LEVELS) for r in blocked.collect()}
    assert len(seen) == len(rows)
    sizes = {}
    for clip, members in timelines(rows).items():
        blocks = [seen[r[2]] for r in members]
        assert blocks == sorted(blocks)
        for block in blocks:
            sizes[clip, block] = sizes.get((clip, block), 0) + 1
    assert max(sizes.values()) < len(rows) / 3
    assert len({b for c, b in sizes if not c}) > 3


def test_previous(case):
    rows, blocked = case
    got = collected(timeline.with_previous(blocked, ["clip"], ORDER, ["v"]), "prev_v")
    for members in timelines(rows).values():
        for before, row in zip([None, *members], members):
            assert got[row[2]] == (before[3] if before else None)


def test_max_before(case):
    rows, blocked = case
    got = collected(timeline.with_max_before(blocked, ["clip"], ORDER, "v", "m"), "m")
    for members in timelines(rows).values():
        best = None
        for row in members:
            assert got[row[2]] == best
            if row[3] is not None:
                best = row[3] if best is None else max(best, row[3])


def test_running_count_and_index(case):
    rows, blocked = case
    flagged = timeline.with_running_count(blocked, ["clip"], ORDER, F.col("v") > 0, "n")
    got = collected(timeline.with_row_index(flagged, ["clip"], ORDER, "i"), "i")
    counts = collected(flagged, "n")
    for members in timelines(rows).values():
        n = 0
        for i, row in enumerate(members):
            n += row[3] is not None and row[3] > 0
            assert got[row[2]] == i
            assert counts[row[2]] == n


def test_light_timelines_stay_in_one_block(spark):
    df = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 2)], "clip int, pos double, seq int")
    blocked = timeline.add_blocks(df, ["clip"], ORDER)
    assert timeline.block_columns(blocked) == []
    rows = timeline.with_previous(blocked, ["clip"], ORDER, ["seq"]).collect()
    assert sorted((r["seq"], r["prev_seq"]) for r in rows) == [(1, None), (2, 1)]


def test_heavy_timeline_is_split_over_tasks(spark):
    df = spark.range(4000).select(
        F.lit(1).alias("clip"), (F.col("id") / 7).alias("pos"), F.col("id").alias("seq")
    )
    blocked = timeline.add_blocks(df, ["clip"], ORDER, rows_per_block=100)
    out = timeline.with_previous(blocked, ["clip"], ORDER, ["seq"])
    assert out.filter((F.col("prev_seq") + 1 == F.col("seq")) | (F.col("seq") == 0)).count() == 4000
    sizes = out.groupBy(*timeline.LEVELS).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 101 and sizes[1] >= 40
