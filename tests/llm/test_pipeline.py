"""The queries with SQL against it, and the corpus pipeline stage by stage."""

import compare
import corpus_pipeline
import pytest

from squelch.llm import queries

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert compare.difference(spark, compare.connect(PATH), queries.QUERIES[name], queries.ORACLE[name], PATH) is None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, PATH).cache()
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept[0] > kept[1] >= kept[2] >= kept[3] > 0
    ids = corpus_pipeline.STAGES[-1][1](spark, docs, PATH)
    assert ids.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and ids.count() == kept[4]
