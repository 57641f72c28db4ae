"""Stored pages against the sorted list."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from squelch.operators import pages


def order():
    return [F.col("score").desc_nulls_last(), F.col("id").asc()]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    score = F.when(F.col("id") % 11 != 0, F.col("id") % 7)
    df = spark.range(1000).select("id", score.alias("score"))
    folder = str(tmp_path_factory.mktemp("pages") / "t")
    pages.store_pages(df, order(), folder, rows_per_range=100)
    return df, folder, [tuple(r) for r in df.orderBy(*order()).collect()]


@pytest.mark.parametrize("offset, limit", [(0, 10), (95, 10), (500, 1), (990, 50), (1000, 5), (5000, 5), (0, 1000), (7, 0)])
def test_pages_equal_the_sorted_list(stored, offset, limit):
    df, folder, rows = stored
    got = [tuple(r) for r in pages.read_page(df, order(), folder, offset, limit).collect()]
    assert got == rows[offset : offset + limit]


def test_a_page_reads_its_ranges_only(spark, stored):
    df, folder, _ = stored
    read = pages.read_page(df, order(), folder, 500, 10)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        read.explain()
    filters = re.search(r"PartitionFilters: \[(.*?)\], ", plan.getvalue()).group(1)
    assert len(re.findall(r"\d+", filters.replace("range#", "").split("IN")[-1])) <= 3
    assert "range#" in filters and spark.read.parquet(f"{folder}/ranges").count() >= 8


def test_empty_table(spark, tmp_path):
    df = spark.range(0).select("id", F.col("id").alias("score"))
    pages.store_pages(df, order(), str(tmp_path / "t"))
    assert pages.read_page(df, order(), str(tmp_path / "t"), 0, 10).collect() == []


def test_small_ranges_share_folders_and_a_page_reads_its_rows_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pages, "FEW_FOLDERS", 4)
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("score"))
    folder = tmp_path / "t"
    pages.store_pages(df, order(), str(folder), rows_per_range=10)
    assert len(list((folder / "rows").glob("range=*"))) <= 4
    want = [tuple(r) for r in df.orderBy(*order()).collect()]
    for offset, limit in [(0, 3), (1245, 20), (2500, 1), (4990, 30), (0, 5000)]:
        read = pages.read_page(df, order(), str(folder), offset, limit)
        assert [tuple(r) for r in read.collect()] == want[offset : offset + limit]
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        pages.read_page(df, order(), str(folder), 1245, 20).explain()
    assert "GreaterThanOrEqual(_at" in plan.getvalue()
