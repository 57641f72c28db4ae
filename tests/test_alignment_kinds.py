"""Kinds of word errors against a plain dynamic programme."""

import random
import tracemalloc

import pyarrow as pa

from squelch.operators import alignment, evaluate


def kinds(a, b):
    """(errors, deletions + insertions), both least in this order."""
    row = [(j, j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        old, row = row, [(i, i)]
        for j, y in enumerate(b, 1):
            hit = old[j - 1] if x == y else (old[j - 1][0] + 1, old[j - 1][1])
            row.append(min(hit, *((e + 1, g + 1) for e, g in (old[j], row[j - 1]))))
    return row[-1]


def replay(a, errors):
    """The hypothesis that the errors make of the reference, as a set of words lost and won."""
    lost = sorted(x for x, _ in errors if x is not None)
    won = sorted(y for _, y in errors if y is not None)
    return lost, won


def test_counts_are_least_and_words_add_up():
    rng = random.Random(3)
    for _ in range(400):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        errors = alignment.word_differences(a, b)
        gaps = sum(x is None or y is None for x, y in errors)
        assert (len(errors), gaps) == kinds(a, b)
        lost, won = replay(a, errors)
        rest = sorted(a)
        for x in lost:
            rest.remove(x)
        assert sorted(rest + won) == sorted(b)
        assert all(x != y for x, y in errors)


def test_long_texts_agree_with_the_sum(spark):
    rng = random.Random(6)
    rows = []
    for i in range(12):
        a = [rng.choice(["alpha", "bravo", "two", "niner"]) for _ in range(rng.randint(0, 700))]
        b = [w if rng.random() < 0.8 else rng.choice(["tango", "two"]) for w in a if rng.random() < 0.95]
        rows.append((i, " ".join(a), " ".join(b)))
    rows += [(100, None, "a b"), (101, "a b c", ""), (102, None, None), (103, "a", "a")]
    df = spark.createDataFrame(rows, "id long, reference string, hypothesis string")
    total = {r["id"]: r["word_errors"] for r in evaluate.word_errors(df).collect()}
    scored = alignment.word_error_kinds(df)
    for r in scored.collect():
        assert r["substitutions"] + r["deletions"] + r["insertions"] == total[r["id"]] == len(r["errors"])
        hypothesis = len((r["hypothesis"] or "").split())
        assert r["reference_words"] - r["deletions"] + r["insertions"] == hypothesis
    assert alignment.confused_words(scored).agg({"times": "sum"}).first()[0] == sum(total.values())
    assert alignment.confused_words(scored.limit(0), "id").count() == 0


def test_a_batch_keeps_no_words_of_its_pairs():
    rng = random.Random(8)
    kind = pa.list_(pa.string())
    a, b = ([[f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 30))] for _ in range(2000)] for _ in "ab")
    sides = [pa.array([["skipped"]] + x, kind)[1:] for x in (a, b)]
    tracemalloc.start()
    got = alignment.errors_of(*sides)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4_000_000
    want = [alignment.word_differences(x, y) for x, y in zip(a, b)]
    assert [[tuple(e.values()) for e in row] for row in got.to_pylist()] == want
    assert alignment.errors_of(sides[0][:0], sides[1][:0]).to_pylist() == []
