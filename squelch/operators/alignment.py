"""Substitutions, deletions and insertions apart, with the words concerned.

The alignment has the fewest errors and, among those, the fewest deletions and insertions, which
fixes all three counts. Memory is linear in the words of a pair: the alignment is split at the
middle word of the reference, where the forward and the backward row of costs meet at least cost,
and each half again; the rows are computed as arrays. Time is the product of what is left of both
lengths when common ends are taken off.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squelch.functions import text

ERRORS = T.ArrayType(T.StructType().add("reference", T.StringType()).add("hypothesis", T.StringType()))


def _costs(a: np.ndarray, b: np.ndarray, swap: int) -> np.ndarray:
    """Least cost of aligning all of ``a`` with each beginning of ``b``."""
    gaps = np.arange(len(b) + 1, dtype=np.int64) * (swap + 1)
    row = gaps.copy()
    for x in a.tolist():
        new = row + swap + 1
        np.minimum(new[1:], row[:-1] + np.where(b == x, 0, swap), out=new[1:])
        row = np.minimum.accumulate(new - gaps) + gaps
    return row


def _differences(a: np.ndarray, b: np.ndarray, swap: int) -> list[tuple[int | None, int | None]]:
    """Positions in both of every error of a best alignment, in order; None at the side without a word."""
    out: list[tuple[int | None, int | None]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
        if i == k:
            out += [(None, y) for y in range(j, m)]
        elif j == m:
            out += [(x, None) for x in range(i, k)]
        elif k - i == 1:
            same = np.flatnonzero(b[j:m] == a[i])
            at = j + (int(same[0]) if len(same) else 0)
            out += [(None, y) for y in range(j, at)]
            out += [] if len(same) else [(i, at)]
            out += [(None, y) for y in range(at + 1, m)]
        else:
            half = (i + k) // 2
            ahead = _costs(a[i:half], b[j:m], swap)
            back = _costs(a[half:k][::-1], b[j:m][::-1], swap)[::-1]
            cut = j + int(np.argmin(ahead + back))
            todo += [(half, k, cut, m), (i, half, j, cut)]
    return out


def _positions(reference: list[str], hypothesis: list[str]) -> list[tuple[int | None, int | None]]:
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in (reference, hypothesis))
    return _differences(a, b, len(a) + len(b) + 1)


def word_differences(reference: list[str], hypothesis: list[str]) -> list[tuple[str | None, str | None]]:
    """The errors between two word lists: (word, word), (word, None) or (None, word)."""
    found = _positions(reference, hypothesis)
    return [(None if x is None else reference[x], None if y is None else hypothesis[y]) for x, y in found]


def errors_of(reference: pa.ListArray, hypothesis: pa.ListArray) -> pa.ListArray:
    """``word_differences`` of a batch. The words stay in their arrays: one pair at a time is taken
    out, and what is kept of it are the positions of its errors, eight bytes a side.
    """
    taken = array("q"), array("q")  # -1 where a side has no word
    ends = array("i", [0])
    sides = reference, hypothesis
    starts = [side.offsets.to_numpy() for side in sides]
    for i in range(len(reference)):
        pair = [side.values[at[i] : at[i + 1]].to_pylist() for side, at in zip(sides, starts, strict=True)]
        for found in _positions(*pair):
            for kept, at, x in zip(taken, starts, found, strict=True):
                kept.append(-1 if x is None else int(at[i]) + x)
        ends.append(len(taken[0]))

    def words(side: pa.ListArray, kept: array) -> pa.Array:
        at = np.frombuffer(kept, np.int64) if kept else np.empty(0, np.int64)
        return side.values.take(pa.array(at, mask=at < 0))

    names = ERRORS.elementType.names
    both = pa.StructArray.from_arrays([words(*x) for x in zip(sides, taken, strict=True)], names=names)
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), both)


@F.arrow_udf(ERRORS)
def _errors(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return errors_of(reference, hypothesis)


def word_error_kinds(
    pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis", normalize: bool = True
) -> DataFrame:
    """Adds ``substitutions``, ``deletions``, ``insertions``, ``reference_words`` and ``errors``, the
    words concerned in order, null where a side has none. Null texts have no words.
    """

    def tokens(column: str) -> Column:
        raw = F.coalesce(F.col(column), F.lit(""))
        return text.words(text.normalize_for_scoring(raw) if normalize else raw)

    def kind(test) -> Column:
        return F.size(F.filter("errors", test)).cast("bigint")

    return (
        pairs.withColumn("_r", tokens(reference))
        .withColumn("errors", _errors("_r", tokens(hypothesis)))
        .withColumn("substitutions", kind(lambda e: e["reference"].isNotNull() & e["hypothesis"].isNotNull()))
        .withColumn("deletions", kind(lambda e: e["hypothesis"].isNull()))
        .withColumn("insertions", kind(lambda e: e["reference"].isNull()))
        .withColumn("reference_words", F.size("_r").cast("bigint"))
        .drop("_r")
    )


def confused_words(scored: DataFrame, *by: str) -> DataFrame:
    """How often each word was taken for another, left out or put in."""
    one = scored.select(*by, F.explode("errors").alias("_e"))
    return one.groupBy(*by, F.col("_e.reference").alias("reference"), F.col("_e.hypothesis").alias("hypothesis")).agg(
        F.count("*").alias("times")
    )
