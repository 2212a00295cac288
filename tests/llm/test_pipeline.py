"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from corpusloom.llm import decontamination, secrets
from corpusloom.settings import materialise

from .conftest import FOLDER


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = odd.select(docs.columns).withColumn("doc_id", odd.doc_id + 10**9)
    docs = docs.unionByName(odd)
    columns, before = docs.columns, docs.count()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    assert decontamination.leaks(docs, benchmark).count() == 0
    assert secrets.with_spans(docs).filter("size(filter(spans, s -> s.kind != 'hex')) > 0").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run_and_empty_table(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0
