"""Word error rate.

The word-level edit distance runs in the JVM: the distinct words of a pair become distinct
characters, and Spark's ``levenshtein`` compares the two character strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squelch.functions import text
from squelch.functions.expr import let

# First code point of the stand-in alphabet; beyond it lie a million valid code points, more
# distinct words than a pair can hold and still be compared in quadratic time.
_ALPHABET = 0x10000


def _encode(words: Column, vocabulary: Column) -> Column:
    def character(known: Column, word: Column) -> Column:
        code = F.array_position(known, word) + F.lit(_ALPHABET)
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    encoded = let(vocabulary, lambda known: F.transform(words, lambda w: character(known, w)))
    return F.array_join(encoded, "")


def word_errors(
    pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis",
    normalize: bool = True,
) -> DataFrame:
    """Adds ``word_errors`` (S + D + I) and ``reference_words``."""

    def tokens(column: str) -> Column:
        raw = F.coalesce(F.col(column), F.lit(""))
        return text.words(text.normalize_for_scoring(raw) if normalize else raw)

    return (
        pairs.withColumn("_r", tokens(reference))
        .withColumn("_h", tokens(hypothesis))
        .withColumn("_v", F.array_distinct(F.concat("_r", "_h")))
        .withColumn(
            "word_errors",
            F.levenshtein(
                _encode(F.col("_r"), F.col("_v")), _encode(F.col("_h"), F.col("_v"))
            ).cast("bigint"),
        )
        .withColumn("reference_words", F.size("_r").cast("bigint"))
        .drop("_r", "_h", "_v")
    )


def word_error_rate(scored: DataFrame, *by: str) -> DataFrame:
    """Corpus rate in percent: all errors over all reference words; null without words."""
    errors, total = F.sum("word_errors"), F.sum("reference_words")
    return scored.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        errors.alias("word_errors"),
        total.alias("reference_words"),
        (errors * F.lit(100.0) / F.nullif(total, F.lit(0))).alias("wer"),
    )


def wer_gain(base: Column, tuned: Column) -> Column:
    """Absolute gain and relative reduction in percent."""
    return F.struct(
        (base - tuned).alias("absolute_gain"),
        ((base - tuned) * 100 / F.nullif(base, F.lit(0.0))).alias("relative_reduction"),
    )
