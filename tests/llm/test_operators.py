"""The operators against brute force, on the smallest tables and on small awkward ones."""

import math
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import brute
from pyspark.sql import Window
from pyspark.sql import functions as F

from squelch.llm import decontaminate, hmm, jaccard, line_dedup, mixture, queries, simple8b, suffix_dedup, syncmers, toxicity
from squelch.llm.annotate import annotate

PATH = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars int, spans string, row string"
LONG = "the quick brown fox jumps over the lazy dog again and again until noon " * 3


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{PATH}/documents.parquet").cache()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and blank texts, copies, repeats within a text, a long text, clashing columns."""
    texts = [None, "", " \t\n", LONG, LONG, "x" + LONG, LONG + "y", "a b", "A B", "é" * 60, "é" * 60, "z " * 20_000, "\0" * 60, "\0" * 61]
    rows = [(i, t, None, None if i % 3 else "web", None, "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(3)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_jaccard(name, request):
    docs = request.getfixturevalue(name)
    assert {tuple(r) for r in jaccard.linked(docs).collect()} == brute.components(pairs(docs))


def test_copies_with_edits_of_their_own_make_no_pairs_of_each_with_each(spark, monkeypatch):
    random = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(200):
        words = list(base)
        for at in random.choice(37, 4 if i % 4 else 1, replace=False) * 4 + 1:
            words[at] = f"edit{i}at{at}"
        texts.append((i, " ".join(words)))
    made, apart = [], jaccard._apart

    def counted(pairs, *more):
        made.append(pairs.count())
        return apart(pairs, *more)

    monkeypatch.setattr(jaccard, "_apart", counted)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {tuple(r) for r in jaccard.linked(docs).collect()} == brute.components(texts)
    assert sum(made) < 10 * len(texts)


def repeats(docs):
    out = suffix_dedup.remove_repeats(docs)
    return {tuple(r) for r in out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_repeats(name, request):
    docs = request.getfixturevalue(name)
    assert repeats(docs) == brute.repeats(pairs(docs))


def test_repeats_with_many_runs_and_large_grams(documents, monkeypatch):
    def small_runs(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 7):
                yield from runs(iter([batch.slice(at, 7)]))

    runs = None
    make = suffix_dedup._runs

    def patched(splitters):
        nonlocal runs
        runs = make(splitters)
        return small_runs

    ids = documents.select(F.explode(F.array(F.lit(0), F.lit(1000))).alias("by"), "doc_id", "text")
    edited = ids.select(
        (F.col("doc_id") + F.col("by")).alias("doc_id"),
        F.when(F.col("by") > 0, F.regexp_replace("text", "a ", "b ")).otherwise(F.col("text")).alias("text"),
    ).filter(F.length("text") < 3000)
    want = repeats(edited)
    monkeypatch.setattr(suffix_dedup, "_runs", patched)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 20_000)
    assert repeats(edited) == want == brute.repeats(pairs(edited))


def test_merging_workers_get_few_pieces_at_once(spark, documents, monkeypatch):
    make = suffix_dedup._merge

    def patched(borders):
        merge = make(borders)

        def run(batches):
            def checked():
                for batch in batches:
                    if batch.num_rows > suffix_dedup.PIECES:
                        raise ValueError(f"{batch.num_rows} rows at once")
                    yield batch

            yield from merge(checked())

        return run

    monkeypatch.setattr(suffix_dedup, "_merge", patched)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 2_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    some = documents.filter("doc_id < 150")
    assert repeats(some) == brute.repeats(pairs(some))


def test_loser_tree_orders_all_records():
    rng = np.random.default_rng(3)
    runs = []
    for _ in range(7):
        rows = sorted({bytes(rng.integers(0, 2, suffix_dedup.WIDTH, dtype=np.uint8)) for _ in range(50)})
        runs.append(rows)
    runs.append(list(runs[0]))

    def common(a, b):
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), len(a))

    coded = [iter([(0 if i == 0 else common(r[i - 1], r[i]), r[i], []) for i in range(len(r))]) for r in runs]
    out = list(suffix_dedup.merged(coded))
    assert [x[1] for x in out] == sorted(y for r in runs for y in r)
    assert all(b[0] == common(a[1], b[1]) for a, b in pairwise(out))


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_contamination(spark, name, request):
    docs = request.getfixturevalue(name)
    items = spark.read.parquet(f"{PATH}/benchmark.parquet")
    out = decontaminate.find_contamination(docs.select("doc_id", "text"), items, "found")
    found = F.col("found")
    got = out.select(
        "doc_id", found["n_words"], decontaminate.n_hit(found), F.size(found["items"]),
        F.sha2(F.array_join(found["items"], ","), 256), decontaminate.contaminated(found),
    )
    assert Counter(tuple(r) for r in got.collect()) == brute.contamination(pairs(docs), [tuple(r) for r in items.collect()])


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_language_model_base(name, request):
    docs = request.getfixturevalue(name)
    words = {i: [*brute.SPACED.findall((t or "").translate(brute.LOWER)), None] for i, t in pairs(docs)}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    for head in (hmm.HEAD_WORDS, 3):
        rows = hmm.score_documents(docs, head_words=head, steps=2).collect()
        assert len(rows) == len(words)
        for r in rows:
            ws = words[r["doc_id"]]
            base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
            assert r["base_score"] == pytest.approx(base, rel=1e-9)
            assert r["score"] < 0


def test_language_model_beats_its_base_on_held_out_texts(documents):
    rows = hmm.score_documents(documents).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert rows[0] > rows[1]


def test_forward_recursion_is_the_sum_over_paths():
    from itertools import product

    rng = np.random.default_rng(5)
    field = hmm._first_field(rng.dirichlet(np.ones(hmm.CLASSES + 1)))
    tokens = np.array([3, 9, hmm.END], np.uint16)
    total = sum(
        field.start[a] * field.moves[a, b] * field.moves[b, c] * field.emits[3, a] * field.emits[9, b] * field.emits[hmm.END, c]
        for a, b, c in product(range(hmm.STATES), repeat=3)
    )
    assert hmm.log_likelihoods(field, tokens, np.array([3]))[0] == pytest.approx(math.log(total))
    long = rng.integers(0, hmm.CLASSES, 1000).astype(np.uint16)
    assert hmm._long_likelihood(field, long) == pytest.approx(hmm.log_likelihoods(field, long, np.array([1000]))[0])


def test_simple8b_round_trip():
    rng = np.random.default_rng(7)
    ids = np.concatenate([rng.integers(0, 1 << b, 700, dtype=np.uint64) for b in (1, 5, 16, 33, 62)] + [np.zeros(90, np.uint64)])
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words, offsets, len(ids)) == ids).all()


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_token_files(name, request):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(str(queries.TOKENIZER))
    got, start = {tuple(r) for r in simple8b.code_documents(docs, queries.TOKENIZER).collect()}, 0
    want = set()
    for i, text in sorted(pairs(docs)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.add((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_toxicity_on_held_out_labels(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels), "found")
    rows = scored.filter(toxicity.held_out(F.col("doc_id"))).join(labels, "doc_id").select("found.score", "toxic").collect()
    right = sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows)
    assert len(rows) > 30 and right >= 0.9 * len(rows)


@pytest.mark.parametrize("name", ["documents", "awkward"])
def test_mix_stays_within_its_bounds_and_reruns_agree(name, request):
    docs = request.getfixturevalue(name)
    columns = ("doc_id", "size", "source_size", "target", "taken")
    first = {tuple(r) for r in mixture.mix(docs).select(*columns).collect()}
    assert first == {tuple(r) for r in mixture.mix(docs).select(*columns).collect()}
    assert len(first) == docs.count()
    assert all(0 <= r[4] <= 3 * r[1] for r in first)


def test_repeated_rows_carry_out_the_mix(spark):
    size = {"a": 40_000, "b": 9_000, "c": 30_000}
    made = [(s, i, " \n" * (i % 2) + "  ".join(f"{s}{i}-{w}" for w in range(1000))) for s, n in size.items() for i in range(n // 1000)]
    rows = [(n, t, None, s, len(t), "", f"{n}") for n, (s, _, t) in enumerate(made)]
    rows += [(*r[:6], "copy") for r in rows[:3]] + [(900, " \n", None, "a", 2, "", "blank"), (901, None, None, "b", 0, "", "null")]
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    mixed = mixture.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id")
    drawn = {r["source"]: (r["n"], r["target"]) for r in mixed.groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("target")).collect()}
    out = mixture.repeat_by_mix(docs).collect()
    got, texts = Counter(), {r[0]: r[1] for r in rows}
    for r in out:
        got[r["source"]] += len(brute.SPACED.findall(r["text"] or ""))
        assert (r["text"] or "") in (texts[r["doc_id"]] or "")
    assert got == {s: n for s, (n, _) in drawn.items()}
    assert all(abs(n - target) <= 3 * mixture.BLOCK for n, target in drawn.values())
    by_id = Counter()
    for r in out:
        by_id[r["doc_id"]] += len(brute.SPACED.findall(r["text"] or ""))
    taken = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    assert {i: n for i, n in by_id.items() if n} == {i: n for i, n in taken.items() if n}
    assert sorted((r["doc_id"], r["text"]) for r in out if r["doc_id"] >= 900) == [(900, " \n"), (901, None)]


def test_mixture_slots_are_not_sent_to_the_driver(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        plan = [mixture.Source("a", 5_000_000, 1, 8e6 + 5), mixture.Source("b", 4_000_000, 1, 4e6)]
        made = mixture.slots(spark, plan, 7)
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
        got = made.groupBy("s").agg(F.count("*"), F.sum("words"), F.count_distinct("shard", "slot"), F.max("block")).collect()
        assert {tuple(r) for r in got} == {(0, 62501, 8_000_005, 62501, 39062), (1, 31250, 4_000_000, 31250, 31249)}
        last = made.agg(F.max(F.col("shard") * mixture.SHARD_SLOTS + F.col("slot")), F.max("slot")).first()
        assert tuple(last) == (93750, mixture.SHARD_SLOTS - 1)
        assert dict(made.dtypes) == {"shard": "bigint", "slot": "int", "s": "int", "block": "bigint", "words": "bigint"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_awkward_lines_and_syncmers(awkward):
    assert line_dedup.dedup_lines(awkward).count() == awkward.count()
    rows = syncmers.compare_neighbours(awkward).select(syncmers.fingerprint(F.col("anchors")).alias("f"), "doc_id", "near_next").collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[3]["f"] == by_id[4]["f"] and all(0 <= r["near_next"] <= 1 for r in rows)


@pytest.mark.parametrize("put", ["", "x", "xyz", "12345678 9", "\u4e00\U00020000"])
def test_syncmers_of_a_shared_passage_do_not_depend_on_what_stands_before_it(spark, put):
    rng = np.random.default_rng(9)
    passages = [
        "".join(chr(c) for c in rng.integers(0x4E00, 0x9000, 300)),
        "".join(chr(c) for c in rng.integers(0x20000, 0x20F00, 300)),
        "".join(chr(c) for c in rng.integers(97, 123, 300)),
        " ".join("".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(1, 15, 60)),
        "just five short words here",
    ]
    rows = spark.createDataFrame([(p, put + p) for p in passages], "a string, b string")
    hashes = lambda c: F.array_distinct(F.transform(syncmers.anchors(F.col(c)), lambda x: x["hash"]))
    got = [r[0] for r in rows.select(syncmers.likeness(hashes("a"), hashes("b"))).collect()]
    assert min(got[:4]) > 0.9 and (got[4] > 0.6 or " " in put)


def test_syncmer_buckets_have_a_bound_where_ids_crowd(spark):
    ids = [*range(2000), 1 << 62, *[None] * 1000, *[7] * 1000]
    rows = [(i, f"text {n}") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = syncmers.with_next(docs, 50)
    sizes = [r["count"] for r in out.groupBy("_bucket").count().collect()]
    assert sum(sizes) == len(rows) + len(sizes) and max(sizes) < 200
    key = lambda df: df.withColumn("_row", F.xxhash64("text")).orderBy(F.asc_nulls_last("doc_id"), "_row")
    texts = [r["text"] for r in key(docs).collect()]
    order = Window.partitionBy("_bucket").orderBy("_guest", "_id", "_row")
    found = out.withColumn("_next", F.lead("text").over(order)).filter("_guest = 0")
    assert {r["text"]: r["_next"] for r in found.collect()} == dict(pairwise([*texts, texts[0]]))


@pytest.mark.parametrize("run", ["jaccard", "repeats", "model", "tokens", "mix"])
def test_empty_tables(spark, run):
    empty = spark.createDataFrame([], KIND)
    out = {
        "jaccard": lambda: jaccard.linked(empty),
        "repeats": lambda: suffix_dedup.remove_repeats(empty),
        "model": lambda: hmm.score_documents(empty),
        "tokens": lambda: simple8b.code_documents(empty, queries.TOKENIZER),
        "mix": lambda: mixture.mix(empty),
    }[run]()
    assert out.count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from([*"aB9.'\t\n\r\x0b\x0c \x1c\x85", " ", "　", "é", "日", "́", "\x00", "<|endoftext|>"[0]]), max_size=20), max_size=4))
def test_split_pieces_have_the_ids_of_the_whole(texts):
    cache = simple8b._cache(queries.TOKENIZER)
    ids, edges = cache.ids(pa.array(["x", *texts], pa.string()).slice(1))
    got = [ids[a:b].tolist() for a, b in pairwise(edges)]
    assert got == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_rows_that_share_an_id_are_one_document(spark):
    words = [f"w{i}" for i in range(80)]
    a, b_, c = " ".join(words[:40]), " ".join(words[40:]), " ".join(words[20:60])
    rows = [(3, a), (7, a), (7, b_), (9, b_), (9, None), (11, c), (11, c), (12, c), (20, None), (20, ""), (None, a), (None, a), (4, c + " x"), (30, "")]
    sets = [(i, brute.shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in sets:
        for j, y in sets:
            if None not in (i, j) and x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    want = Counter((i, len(x), None if i is None else root(i)) for i, x in sets)
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, sig int").repartition(4)
    assert Counter(tuple(r) for r in jaccard.linked(docs).collect()) == want


def test_sketches_bound_the_difference_from_below():
    rng = np.random.default_rng(6)
    for n, m in [(5, 5), (900, 40), (3000, 3100), (9000, 500), (0, 7)]:
        pool = np.unique(rng.integers(0, 1 << 63, 12_000, dtype=np.uint64))
        x, y = (rng.choice(pool, k, replace=False) for k in (n, m))
        for v in (y, x, x[: n - n // 50]):
            least = jaccard.least_difference(jaccard._sketch(x), jaccard._sketch(v))
            assert least <= len(np.setxor1d(x, v))
    assert jaccard.least_difference(jaccard._sketch(x), jaccard._sketch(x)) == 0


def test_one_of_each_with_clashing_names(spark):
    rows = [(1, LONG, "p"), (2, LONG, "q"), (3, "other words", None), (None, LONG, "r"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    out = jaccard.one_of_each(docs)
    assert out.columns == docs.columns
    assert Counter(tuple(r) for r in out.collect()) == Counter(r for r in rows if r[0] != 2)


def test_annotated_texts_come_in_batches_of_bounded_size(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.range(3000).coalesce(1).select(F.col("id"), F.lit("a b").alias("text"))
    out = annotate(docs, "text", lambda column: [len(column)] * len(column), "rows", "int")
    assert out.agg(F.count("*"), F.max("rows")).first()[:] == (3000, 500)


def test_annotated_texts_come_in_parts_of_bounded_size(spark):
    long, short = "x" * 5_000_000, "y"
    docs = spark.createDataFrame([(1, long), (2, None), (3, long), (4, short)], "doc_id long, text string").coalesce(1)
    out = annotate(docs, "text", lambda texts: [len(texts)] * len(texts), "at_once", "bigint")
    got = {r["doc_id"]: (r["at_once"], r["n"]) for r in out.select("doc_id", "at_once", F.length("text").alias("n")).collect()}
    assert got == {1: (2, 5_000_000), 2: (2, None), 3: (2, 5_000_000), 4: (2, 1)}
