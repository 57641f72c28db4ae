"""Exact shares: the k keys of smallest hash, without a sort.

The k-th smallest of all hashes is found digit by digit. Each pass counts the keys per value of the
next 16 bits below the prefix found so far: at most 65,536 counts, summed map-side, leave Spark, at
any number of keys. As soon as one key is left in the cell, or the counts end on a border of cells,
the threshold is known; four passes read a 64-bit hash to its end. Keys that share the whole hash of
the threshold are taken in the order of the keys themselves.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 16
BITS = 64


def _taken(n: int, percent: float) -> int:
    """Share of n, halves rounded up."""
    exact = Decimal(n) * Decimal(str(percent)) / 100
    return int(exact.quantize(Decimal(1), rounding=ROUND_HALF_UP))


def _cell(h: Column, shift: int) -> Column:
    return F.shiftrightunsigned(h, shift) if shift else h


def smallest(keys: DataFrame, key: str, hashed: Column, percent: float) -> Column:
    """Condition that holds for exactly ``percent`` of the distinct non-null values of ``key``, those
    of smallest ``hashed`` (a non-negative bigint that depends on the key alone), ties by key.
    """
    distinct = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), hashed.alias("_h")).distinct()
    prefix, shift, left, n = 0, BITS, None, None
    while shift:
        step = shift - DIGIT
        inside = distinct if shift == BITS else distinct.filter(_cell(F.col("_h"), shift) == prefix)
        digit = _cell(F.col("_h"), step).bitwiseAND(F.lit((1 << DIGIT) - 1))
        counts = sorted(inside.groupBy(digit.alias("d")).agg(F.count("*").alias("c")).collect())
        if n is None:
            n = sum(r["c"] for r in counts)
            left = _taken(n, percent)
            if left <= 0:
                return F.lit(False)
            if left >= n:
                return F.col(key).isNotNull()
        for r in counts:
            if left <= r["c"]:
                break
            left -= r["c"]
        prefix, shift = prefix << DIGIT | r["d"], step
        if left == r["c"]:  # the whole cell belongs to the share
            return F.col(key).isNotNull() & (_cell(hashed, shift) <= prefix)
    # several keys of one hash stand at the border: the first ``left`` of them
    last = distinct.filter(F.col("_h") == prefix).orderBy("_k").limit(left).agg(F.max("_k")).first()[0]
    return F.col(key).isNotNull() & ((hashed < prefix) | ((hashed == prefix) & (F.col(key) <= F.lit(last))))


def with_exact_split(
    samples: DataFrame, key: str, validation_percent: float = 15, seed: int = 42, hashed: Column | None = None
) -> DataFrame:
    """Train / validation with exactly the share of the clips (halves rounded up), copies of a clip on
    one side. Rows without a clip are for training.

    ``hashed`` replaces the hash of key and seed; it must be a non-negative bigint.
    """
    if hashed is None:
        hashed = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 1)
    chosen = smallest(samples, key, hashed, validation_percent)
    return samples.withColumn("split", F.when(chosen, "validation").otherwise("train"))


def multiplicative(key: Column, seed: int = 42) -> Column:
    """Hash of an integer key that any SQL engine can repeat."""
    return F.pmod(F.pmod(key + seed, F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))
