"""Line dedup through its keep bitmaps, against brute force; hot keys over many slices."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from squelch.llm import jaccard, line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(docs, min_length, min_documents):
    holders = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_length:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= min_documents and i < max(holders[key(x)]) for x in lines]
        runs = [at for at in range(len(lines)) if gone[at] != (at > 0 and gone[at - 1])]
        if gone[-1]:
            runs.append(len(lines))
        out[i] = ("\n".join(x for x, g in zip(lines, gone) if not g), sum(gone), runs or None)
    return out


def test_bitmaps_keep_what_brute_force_keeps(spark):
    rng = random.Random(8)
    pool = ["Notice of licence terms", " notice of licence terms\t", "x", "", "second shared line", "ÀB shared é line"]
    docs = [(i, "\n".join(rng.choice([*pool, f"own line {i} {k}"]) for k in range(rng.randint(1, 30)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "\n\n"), (303, "notice of licence terms\n" * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 5, 5)
    out = line_dedup.dedup_lines(df, min_length=5, min_documents=5)
    got = {r["doc_id"]: (r["text"], r["n_dropped"], r["keep_runs"]) for r in out.collect()}
    assert got == want


def test_the_text_comes_from_the_bitmap(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.dedup_lines(df).select("text")._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(keep_runs" in plan


def test_runs_and_back(spark):
    rng = random.Random(2)
    for _ in range(20):
        n = rng.randint(1, 12)
        gone = sorted(rng.sample(range(n), rng.randint(1, n)))
        row = spark.range(1).select(
            line_dedup.kept_lines(F.array(*map(F.lit, range(n))), line_dedup.runs(F.array(*map(F.lit, gone)))).alias("kept"),
            line_dedup.n_dropped(line_dedup.runs(F.array(*map(F.lit, gone)))).alias("n"),
        ).first()
        assert (row["kept"], row["n"]) == ([x for x in range(n) if x not in gone], len(gone))


def test_common_shingles_stand_out_however_full_the_counters():
    rng = np.random.default_rng(1)
    for mean in (0.5, 20, 2000):
        counters = rng.poisson(mean, 1 << 16).astype(np.uint32)
        before = jaccard._ranks(counters)
        counters[7] += np.uint32(60 * max(1, mean**0.5))
        assert (before == 0).mean() > 0.99 and jaccard._ranks(counters)[7] >= 3


def test_ranks_take_little_more_than_the_counters():
    counters = np.random.default_rng(2).poisson(30, jaccard.COUNTERS).astype(np.uint32)
    counters[::1000] *= 500
    tracemalloc.start()
    ranks = jaccard._ranks(counters)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * counters.nbytes
    assert ranks[::1000].min() >= 6 and (np.delete(ranks, np.s_[::1000]) == 0).mean() > 0.99
