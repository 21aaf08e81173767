import pytest

import corpus_pipeline
from folioloom.llm.catalog import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = sorted(docs.columns)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        after = {r.doc_id: r.text for r in docs.collect()}
        assert sorted(docs.columns) == want and set(after) <= set(before)
        if name == "quality classifier":
            assert sum(labels.get(i) == 0 for i in after) <= 2 and all(i in after for i in before if labels.get(i) == 1)
        elif name == "line dedup":
            assert set(after) == set(before)
        else:
            assert len(after) < len(before) and all(after[i] == before[i] for i in after)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {p.doc_id for p in pieces} == set(before)


def test_run(spark):
    got = corpus_pipeline.run(spark, FOLDER).collect()
    fill = {}
    for p in sorted(got, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill.get(p.sequence_id, 0)
        fill[p.sequence_id] = p.offset + p.length
    assert max(fill.values()) <= 2048


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_empty_documents(spark, make_docs, stage):
    assert stage(spark, make_docs([]), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_against_sql(spark, name):
    from checking import compare, connect

    problem, _ = compare(spark, connect(FOLDER), FOLDER, QUERIES[name], CHECKS[name])
    assert problem is None, problem
