"""Bucketed tables: changes touch their buckets only; counters follow signed changes."""

import pytest
from pyspark.sql import functions as F

from squelch.operators import buckets, counters, tables
from squelch.plans import maintenance

PATH = "/root/testdata/sf0.001"
N = 8


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(f"k{i}", i, None if i % 3 else "old") for i in range(40)]
    table = spark.createDataFrame(rows, "key string, n int, note string")
    folder = str(tmp_path / "table")
    buckets.write_buckets(table, folder, "key", N)
    return folder, {r[0]: r[1:] for r in rows}


def content(spark, folder):
    return {r["key"]: (r["n"], r["note"]) for r in buckets.read_buckets(spark, folder).collect()}


def listing(spark, folder):
    return {(r["bucket"], r["file"]) for r in buckets.files(spark, folder).collect()}


def test_merge_keeps_the_files_of_other_buckets(spark, stored):
    folder, want = stored
    before = listing(spark, folder)
    updates = spark.createDataFrame([("k3", 300, None), ("k4", None, "new"), ("nowhere", 1, "x")], "key string, n int, note string")
    touched = buckets.merge(spark, folder, updates, "key", N)
    assert content(spark, folder) == want | {"k3": (300, want["k3"][1]), "k4": (4, "new")}
    after = listing(spark, folder)
    assert 0 < len(touched) < N
    assert {x for x in before if x[0] not in touched} == {x for x in after if x[0] not in touched}
    assert not {x for x in before if x[0] in touched} & after


def test_upsert_and_delete_down_to_an_empty_bucket(spark, stored):
    folder, want = stored
    buckets.upsert(spark, folder, spark.createDataFrame([("k1", -1, "a"), ("new", 7, None)], "key string, n int, note string"), "key", N)
    want = want | {"k1": (-1, "a"), "new": (7, None)}
    assert content(spark, folder) == want
    keys = spark.createDataFrame([(k,) for k in want], "key string")
    one = keys.filter(buckets.bucket_of(F.col("key"), N) == buckets.bucket_of(F.lit("k1"), N))
    gone = {r[0] for r in one.collect()}
    assert buckets.delete(spark, folder, one, "key", N) and gone
    assert content(spark, folder) == {k: v for k, v in want.items() if k not in gone}
    buckets.upsert(spark, folder, spark.createDataFrame([("k1", 5, None)], "key string, n int, note string"), "key", N)
    assert content(spark, folder)["k1"] == (5, None)


def test_nothing_to_change(spark, stored):
    folder, want = stored
    before = listing(spark, folder)
    none = spark.createDataFrame([], "key string, n int, note string")
    assert buckets.merge(spark, folder, none, "key", N) == [] and listing(spark, folder) == before
    null = spark.createDataFrame([(None, 1, "x")], "key string, n int, note string")
    buckets.delete(spark, folder, null.filter("n = 2"), "key", N)
    assert content(spark, folder) == want


def test_counters_after_each_batch_equal_a_recount(spark):
    moves = maintenance.user_moves(spark, PATH).cache()
    counts = spark.createDataFrame([], "parent string, n long")
    edges = [0, *moves.approxQuantile("moment", [0.3, 0.7], 0.0), float("inf")]
    place = "ROW_NUMBER() OVER (PARTITION BY id ORDER BY moment DESC)"
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        batch = moves.filter((F.col("moment") > low) & (F.col("moment") <= high))
        counts = counters.apply_changes(counts, counters.changed_counts(batch))
        last = moves.filter(F.col("moment") <= high).withColumn("p", F.expr(place)).filter("p = 1 AND new_parent IS NOT NULL")
        want = {r[0]: r[1] for r in counters.count_children(last, "new_parent").collect()}
        assert {r["parent"]: r["n"] for r in counts.collect()} == want and want


def test_signed_changes_of_all_kinds(spark):
    rows = [(1, None, "a"), (2, "a", "b"), (3, "b", None), (4, None, None), (5, "c", "c"), (6, None, "a")]
    changes = spark.createDataFrame(rows, "id int, old_parent string, new_parent string")
    got = {r["parent"]: r["delta"] for r in counters.changed_counts(changes).collect()}
    assert got == {"a": 1, "b": 0}


def test_cascade_takes_the_whole_tree(spark):
    segments = spark.createDataFrame([(1, "r"), (2, "r"), (3, "s"), (4, None)], "id int, recording_id string")
    labels = spark.createDataFrame([(10, 1), (11, 1), (12, 3), (13, 9)], "id int, segment_id int")
    doomed = spark.createDataFrame([("r",), ("r",), ("t",)], "recording_id string")
    of_segments, of_labels = counters.cascade(doomed, segments, labels)
    assert {tuple(r) for r in of_segments.collect()} == {(1, "r", None), (2, "r", None)}
    assert {tuple(r) for r in of_labels.collect()} == {(10, 1, None), (11, 1, None)}
    left, kept = tables.delete_cascade(segments, labels, of_segments)
    assert {r["id"] for r in left.collect()} == {3, 4} and {r["id"] for r in kept.collect()} == {12, 13}
