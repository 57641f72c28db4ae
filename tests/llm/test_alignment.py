"""Token alignment against whole texts encoded at once."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm import brute
from tokenizers import Tokenizer

from squelch.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n a\n\n b ", "a \n b", "it's we'll 'S", "日本語テキスト é 𝒳𝒳 \U0001f469‍\U0001f4bb", "x▁y",
    "<|endoftext|> <s> </s> <unk> <0x41>", "tab\t tab \x85 　   x", "\x00\x01 ﻿", "café naïve café", "word " * 3000,
    "x" * 5000, "é" * 3000, "();\r\n\t},\r", "a b", "a b", "  lead and trail  ",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def test_alignment_on_documents(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute.aligned([tuple(r) for r in docs.select("doc_id", "text").collect()], *tokenizers)
    assert Counter(tuple(r) for r in alignment.align(docs, A, B).collect()) == want


def test_alignment_of_awkward_texts(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 100)
    rows = [(None if i in (4, 5) else i // 2, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 pair", "'x' block", "2 n", "3 doc_ids").repartition(3)
    assert Counter(tuple(r) for r in alignment.align(docs, A, B).collect()) == brute.aligned(rows, *tokenizers)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


LETTERS = st.sampled_from([*"abz AZ09 .,'\n\t\r ;)}", "é", "日", "▁", "𝒳", " ", "　", "\x1c", "́", "\x00"])


@settings(max_examples=100, deadline=None)
@given(st.text(LETTERS, max_size=40))
def test_parts_have_the_tokens_of_the_whole(tokenizers, text):
    (want,) = brute.aligned([(1, text)], *tokenizers)
    got = alignment._aligner(A, B).block([text])
    sizes = tuple(int(got[c][0]) for c in ("n_a", "n_b", "n_groups", "n_links"))
    assert sizes == want[1:5] and got["shas"] == [want[7]]


def test_spans_are_refined_by_decoded_bytes():
    # a character of three bytes in three tokens that share its span, one in empty spans, two plain ones
    spans = np.array([(0, 2), (2, 5), (2, 5), (2, 5), (5, 6), (6, 6), (6, 6), (6, 9)])
    ends = alignment.token_ends(spans[:, 0], spans[:, 1], np.array([2, 1, 1, 1, 1, 1, 1, 1]))
    assert ends.tolist() == [2, 3, 4, 5, 6, 7, 8, 9]


def test_long_groups_are_not_written_out(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "SMALL_GROUP", 3)
    aligner = alignment.Aligner(A, B)
    for text in ["aaaabaab " * 5, "日本語テキスト" * 9, "unbelievably antidisestablishmentarianism 1234567"]:
        (want,) = brute.aligned([(1, text)], *tokenizers)
        got = aligner.block([text])
        assert int(got["n_links"][0]) == want[4] == np.frombuffer(got["times"], "<i8").sum() and got["shas"] == [want[7]]


def test_a_block_is_taken_in_steps_of_little_memory(tokenizers, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [None, "", *(" ".join(rng.choices(words, k=1500)) for _ in range(60)), "a\x00b", "one"]
    aligner = alignment.Aligner(A, B)

    def measured(step):
        monkeypatch.setattr(alignment, "STEP", step)
        aligner.block(texts)
        tracemalloc.start()
        made = aligner.block(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return {k: bytes(v) if isinstance(v, bytes) else [*v] for k, v in made.items()}, peak

    whole, most = measured(1 << 40)
    steps, peak = measured(20_000)
    assert steps == whole and peak < most / 3
    assert sum(np.frombuffer(whole["times"], "<i8")) == sum(whole["n_links"]) > 0


@pytest.mark.parametrize("most, width", [(255, 1), (256, 2), (65_536, 4), (1 << 32, 8)])
def test_numbers_of_links_come_back(most, width):
    times = np.array([1, most, 7], "<i8")
    kept = alignment._narrowed(times.tobytes())
    assert len(kept) == 3 * width and alignment._widened(kept, 3).tolist() == [1, most, 7]
    assert len(alignment._widened(alignment._narrowed(b""), 0)) == 0


def test_few_texts_come_in_one_batch(spark, tokenizers, monkeypatch):
    before, seen = spark.conf.get(alignment.BATCH_SETTING), []
    write = alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda *x: seen.append(int(spark.conf.get(alignment.BATCH_SETTING))) or write(*x))
    alignment.align(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), A, B)
    assert seen == [500] and spark.conf.get(alignment.BATCH_SETTING) == before
