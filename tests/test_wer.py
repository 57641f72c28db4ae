"""Word error rate against a plain dynamic programme, and the published triples."""

import random

import pytest
from pyspark.sql import functions as F

from squelch.operators import evaluate

# Published reference, baseline and fine-tuned transcriptions.
TRIPLES = [
    ("United 425 cleared for takeoff runway 28 left wind 240 at 12",
     "United four two five clear for take off runway twenty-eight left wind two forty at twelve"),
    ("Delta 832 descend and maintain flight level 240 speed 280 knots",
     "Delta eight thirty two descend maintain flight level two forty speed two eighty knots"),
    ("Southwest 1503 contact Houston departure 135.7 good day",
     "Southwest Fifteen Zero Three contact Houston departure one three five point seven good day"),
]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_random_pairs(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 40)))
    pairs = [(i, text(), text()) for i in range(60)]
    df = spark.createDataFrame(pairs, "i int, reference string, hypothesis string")
    for r in evaluate.word_errors(df, normalize=False).collect():
        a, b = r["reference"].split(), r["hypothesis"].split()
        assert (r["word_errors"], r["reference_words"]) == (distance(a, b), len(a))


def test_many_distinct_words(spark):
    a = [f"w{i}" for i in range(1500)]
    b = [f"w{i}" for i in range(700, 2400)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "reference string, hypothesis string")
    assert evaluate.word_errors(df).first()["word_errors"] == distance(a, b)


def test_published_triples(spark):
    df = spark.createDataFrame(TRIPLES, "reference string, hypothesis string")
    base = evaluate.word_error_rate(evaluate.word_errors(df)).first()
    same = df.withColumn("hypothesis", F.upper("reference"))
    assert evaluate.word_error_rate(evaluate.word_errors(same)).first()["wer"] == 0.0
    assert base["wer"] > 0 and base["reference_words"] == 31


def test_nothing_to_compare(spark):
    df = spark.createDataFrame([("", "a b"), (None, None)], "reference string, hypothesis string")
    row = evaluate.word_error_rate(evaluate.word_errors(df)).first()
    assert (row["word_errors"], row["reference_words"], row["wer"]) == (2, 0, None)


def test_gain(spark):
    row = spark.range(1).select(evaluate.wer_gain(F.lit(30.3), F.lit(13.7)).alias("g")).first()["g"]
    assert row["absolute_gain"] == pytest.approx(16.6)
    assert round(row["relative_reduction"], 1) == 54.8
