"""The queries with SQL beside it, and the pipeline's stages."""

from collections import Counter

import pytest
from conftest import DATA  # noqa: F401
from oracle import assert_same, connect

import corpus_pipeline
from furrow.llm import registry
from furrow.llm.common import DOCUMENT_COLUMNS, materialize

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, name):
    assert_same(registry.QUERIES[name](spark, SMALL), connect(SMALL), registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_a_row_for_each_document(spark, documents, name):
    found = registry.QUERIES[name](spark, SMALL)
    assert {r[0] for r in found.select("doc_id").distinct().collect()} == {r[0] for r in documents.select("doc_id").collect()}


def test_pipeline_stages(spark, documents):
    docs, sizes = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SMALL), name)
        assert tuple(docs.columns) == DOCUMENT_COLUMNS
        sizes.append(docs.count())
        if name in ("exact_dedup", "near_dedup"):
            assert max(Counter(r.text for r in docs.collect()).values()) == 1
    assert sizes[1] < sizes[0] and sizes[2] <= sizes[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sum(r.piece == 0 for r in packed) == sizes[-1]


def test_pipeline_on_oddities(spark, tricky, nothing):
    docs, seen = tricky, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == before.columns  # other columns and their clashing names stay
        assert docs.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).count() == 0 or name == "mixing"
        seen[name] = docs.count()
    assert 0 < seen["near_dedup"] <= seen["exact_dedup"] <= seen["quality"] <= tricky.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sum(r.piece == 0 for r in packed) == seen["mixing"]
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.count() == 0
