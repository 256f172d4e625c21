"""The pipeline's stages, each judged on its own input, and the registry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from swellcast.llm import common, decontaminate, exact_dedup, jaccard, quality, queries

SF_DIR = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_keep_what_they_should(spark):
    docs = common.table(spark, SF_DIR, "documents")
    labels, bench = common.table(spark, SF_DIR, "labels"), common.table(spark, SF_DIR, "benchmark")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, SF_DIR), "stage")
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        if stage is corpus_pipeline.good_quality:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in quality.score(docs, labels).where("predicted = 1").collect()}
        elif stage is corpus_pipeline.exact_copies:
            assert {r.doc_id for r in out.collect()} == {r.m for r in docs.groupBy("text").agg(F.max("doc_id").alias("m")).collect()}
            assert out.count() == exact_dedup.mark(docs).where("kept").count()
        elif stage is corpus_pipeline.near_copies:
            found = jaccard.classes(docs)
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in found.collect()}
        else:
            assert decontaminate.report(out, bench).where("contaminated").count() == 0
            clean = {r.doc_id for r in decontaminate.report(docs, bench).where("not contaminated").collect()}
            before = {r.doc_id: r.text for r in docs.collect()}
            after = {r.doc_id: r.text for r in out.collect()}
            assert all(after[i] == before[i] for i in clean)
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()} == {r.doc_id for r in docs.collect()}
