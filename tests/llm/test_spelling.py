"""Spelling variants against all strings with one letter left out."""

from collections import Counter

import numpy as np
import pytest
from llm import brute

from squelch.llm import spelling


def run(docs):
    return Counter(tuple(r) for r in spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("group", [1024, 4])
def test_variants_on_documents(spark, group, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_WORDS", group)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute.spelling([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert run(docs) == want


@pytest.mark.parametrize("group", [1024, 2])
def test_variants_of_made_words(spark, group, monkeypatch):
    """Two letters only, so nearly all words are near many others and long halves are hot."""
    monkeypatch.setattr(spelling, "GROUP_WORDS", group)
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 64)
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("aé"), n)) for n in rng.integers(6, 12, 400)]
    words += ["common" + w for w in words[:100]] + [w + "common" for w in words[:100]] + ["z" * n for n in (7, 8, 8, 400, 401)]
    often = rng.integers(1, 40, len(words))
    rows = [(int(i), " ".join([w] * int(n))) for i, (w, n) in enumerate(zip(words, often, strict=True))]
    rows += [(None, "Ärgerlich ärgerlich ÀRGERLICH \xd7\xf7aaaaaaa"), (None, "Ärgerlich"), (3, None), (3, ""), (3, rows[0][1]), (3, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n", "'x' word", "2 form").repartition(3)
    assert run(docs) == brute.spelling(rows)


def test_variants_of_an_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_of_forms_end_at_the_root(spark):
    chain = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    rows = [(i, " ".join([w] * (2 * 11**i))) for i, w in enumerate(chain)]
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert Counter((w, *x) for w, x in got.items()) == Counter(r[:3] for r in brute.spelling(rows))
    assert len({x[1] for w, x in got.items() if w in chain}) == 1
