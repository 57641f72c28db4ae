"""Exact shares at several sizes, ties and copies."""

import pytest
from pyspark.sql import functions as F

from squelch.operators import shares


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 1000, 99_990])
def test_share_is_exact_and_copies_stay_together(spark, n):
    df = spark.range(n).select((F.col("id") * 3).alias("clip")).select("clip", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    for percent in (0, 15, 33.3, 100):
        out = shares.with_exact_split(df, "clip", percent)
        sides = out.groupBy("clip").agg(F.count_distinct("split").alias("sides"), F.first("split").alias("split"))
        row = sides.agg(F.max("sides"), F.count_if(F.col("split") == "validation")).first()
        assert tuple(row) == (1, int(n * percent / 100 + 0.5 + 1e-9))


def test_ties_of_the_hash_go_by_key(spark):
    df = spark.createDataFrame([(k,) for k in "dbcaefghij"] + [(None,)], "clip string")
    out = shares.with_exact_split(df, "clip", 30, hashed=F.lit(7).cast("long"))
    assert {r["clip"] for r in out.filter("split = 'validation'").collect()} == {"a", "b", "c"}
    assert out.count() == 11
    assert shares.with_exact_split(df.limit(0), "clip").count() == 0
