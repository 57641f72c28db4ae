"""Speaker turns, readback and workload, with heavy clips cut into blocks."""

import random

import pytest

from squelch.operators import turns


def fold(values):
    out = values[0]
    for v in values[1:]:
        out = (out + v) / 2
    return out


@pytest.mark.parametrize("block", [1_000_000, 15])
def test_speaker_turns(spark, block):
    rng = random.Random(11)
    rows, speaker = [], 0
    for i in range(400):
        clip = 1 if rng.random() < 0.7 else 2
        if rng.random() < 0.1:
            speaker = rng.choice([0, 1, None])
        rows.append((clip, rng.choice([0, 1]), i, speaker, f"w{i}", rng.random(), float(i), i + 0.5))
    df = spark.createDataFrame(
        rows,
        "clip int, sentence int, seq int, speaker int, word string, confidence double,"
        " start double, end double",
    )
    got = turns.speaker_turns(df, ["clip", "sentence"], ["seq"], rows_per_block=block).collect()
    want = {}
    for clip in (1, 2):
        for sentence in (0, 1):
            number, last = -1, object()
            for row in rows:
                if (row[0], row[1]) != (clip, sentence):
                    continue
                if row[3] != last:
                    number, last = number + 1, row[3]
                want.setdefault((clip, sentence, number), []).append(row)
    assert len(got) == len(want)
    for r in got:
        own = want[r["clip"], r["sentence"], r["turn_no"]]
        assert r["text"] == " ".join(w[4] for w in own)
        assert (r["speaker"], r["start"], r["end"]) == (own[0][3], own[0][6], own[-1][7])
        assert r["n_words"] == len(own)
        assert r["confidence"] == pytest.approx(fold([w[5] for w in own]))


@pytest.mark.parametrize("block", [1_000_000, 2])
def test_readback(spark, block):
    rows = [
        (1, 0, "climb 5000 heading 270 and 5000"),
        (1, 1, "270"),
        (1, 2, "no digits"),
        (1, 3, "12"),
        (2, 0, "contact 118"),
        (2, 1, "118 roger"),
        (3, 0, "only 99999999999999999999 here 7"),
        (3, 1, "8"),
    ]
    df = spark.createDataFrame(rows, "clip int, turn int, text string")
    got = turns.readback_mismatches(df, "clip", ["turn"], rows_per_block=block).collect()
    found = {(r["clip"], r["turn"]): list(r["mismatches"]) for r in got}
    assert found == {(1, 1): ["5000", "5000"], (3, 1): ["99999999999999999999", "7"]}


@pytest.mark.parametrize("block", [1_000_000, 2])
def test_workload(spark, block):
    rows = [(1, i, "a", i * 2.0, i * 2.0 + d, "one two") for i, d in enumerate([1.5, 1.6, 2.5, 1.9, 1.8, 0])]
    rows.append((2, 0, "b", 0.0, 1.0, ""))
    df = spark.createDataFrame(
        rows, "clip int, turn int, speaker string, start double, end double, text string"
    )
    got = {r["clip"]: r for r in turns.workload(df, "clip", ["turn"], rows_per_block=block).collect()}
    # A gap of exactly half a second is not rapid, a negative one is.
    assert got[1]["rapid_exchanges"] == 4
    assert got[1]["is_high_workload"] is True
    assert (got[2]["total_turns"], got[2]["rapid_exchanges"]) == (1, 0)
    assert got[2]["is_high_workload"] is False
