"""Secret spans against a plain version."""

from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import brute
from pyspark.sql import functions as F

from squelch.llm import secrets

KIND = "doc_id long, repository string, owner string, text string"


def run(docs, **more):
    out = secrets.find_secrets(docs, repository_col="repository", owner_col="owner", **more)
    base = F.filter("spans", lambda x: x["kind"] != "owned")
    return Counter(tuple(r) for r in out.select("doc_id", secrets.listed(base), secrets.listed(F.col("spans"))).collect())


def made():
    rng = np.random.default_rng(8)
    key = lambda n=24: "".join(rng.choice(list("abcXYZ0123456789_"), n))
    shared, own = "example-KEY-1234567890", key()
    rows = [(i, f"r{i}", f"o{i}", f"é see {shared} or password='{shared}' and {key()} \U00020000 {key(16)}") for i in range(6)]
    rows += [(10 + i, f"r{i}", "one", f"{own} apiKey: {own} api_key=short secret=\"\" tokentoken=abcdef") for i in range(6)]
    rows += [
        (20, None, None, None), (21, None, None, ""), (22, "r", None, f"AKIA{'A1' * 9} AKIAIOSF deadbeef{'0' * 20} " + "f" * 24),
        (22, "r", None, f"AKIA{'A1' * 9} AKIAIOSF deadbeef{'0' * 20} " + "f" * 24), (None, None, "x", "PASSWD:" + "a" * 5 + " paſſword=abcdefgh"),
        (23, "r", "x", "word " * 30_000 + key()), (24, "r", "x", key() + "/" + key() + "\n" + "1234567890123456 abcdefghijklmnopq"),
    ]
    return rows


def test_secrets_of_made_texts(spark):
    rows = made()
    docs = spark.createDataFrame(rows, KIND).selectExpr("*", "1 row", "'x' spans", "2 value", "'y' found").repartition(3)
    assert run(docs) == brute.secrets(rows)
    assert run(docs, max_owners=6) == brute.secrets(rows, 6)


def test_owners_and_repositories_of_a_value(spark):
    rows = [(i, f"r{i % 4}", f"o{i % 2}", "token=abcdef0123") for i in range(40)] + [(99, "r", "o", "token=lonely0123")]
    docs = spark.createDataFrame(rows, KIND)
    out = secrets.find_secrets(docs, repository_col="repository", owner_col="owner", max_owners=1)
    got = {r["doc_id"]: (r["spans"][0]["repositories"], r["spans"][0]["owners"], r["spans"][0]["live"]) for r in out.collect()}
    assert got.pop(99) == (1, 1, True) and set(got.values()) == {(4, 2, False)}


def test_no_documents(spark):
    assert run(spark.createDataFrame([], KIND)) == Counter()


def test_masked_texts(spark):
    text = "x password=hunter22 y AKIA" + "B2" * 8 + " token: " + "0123456789abcdef01234567 z é"
    docs = spark.createDataFrame([(1, "r", "o", text), (2, "r", "o", None)], KIND)
    found = secrets.find_secrets(docs, repository_col="repository", owner_col="owner")
    rows = docs.join(found, "doc_id").select("doc_id", secrets.mask(F.col("text"), F.col("spans")).alias("m")).collect()
    assert {r["doc_id"]: r["m"] for r in rows} == {1: "x [assign] y [access] [assign] z é", 2: None}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"aAf019_-=: \"'", "token", "AKIA", "é", "secret", "0123456789abcdef", "Zz19"]), max_size=30).map("".join))
def test_candidates_of_any_text(text):
    got = sorted((s, e, k) for k, s, e, _ in secrets.candidates(text))
    ((_, _, spans),) = brute.secrets([(1, "r", "o", text)])
    assert got == sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
