"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside higher-order functions.

    An outer expression inside a lambda is evaluated again for every element, and the optimizer
    moves a column's expression into the lambda when it is used once. A lambda variable is not.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def unnest(df: DataFrame, value: Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes the optimizer test the array for null and size in a filter below, which
    computes it again twice; dropping the empty rows afterwards does not.
    """
    exploded = df.select(*keep, F.explode_outer(value).alias(name))
    return exploded.filter(F.col(name).isNotNull())
