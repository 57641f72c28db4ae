"""Every named query against its SQL counterpart on the smallest tables."""

import compare
import pytest

from squelch.plans import catalog

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connect(PATH)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    problem = compare.difference(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], PATH)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(catalog.QUERIES)
    assert set(entry.oracle_sql()) >= set(catalog.ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())
