"""Tables that have columns with the names the operators use inside give the plain results."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontamination, jaccard_join, quality_model, secrets, toxicity
from corpusloom.llm.names import spare_names
from corpusloom.llm.queries_models import quality_trees

from .conftest import FOLDER

INSIDE = (
    "_k1", "_k2", "_key", "_kinds", "_spans", "spans", "_quality", "score", "row", "root", "node", "key", "kinds", "size", "bands", "group",
    "windows", "label", "links", "gram", "pos", "pairs", "item", "item_words", "k1", "k2", "copies", "path", "class_id", "n_links", "word", "n",
    "_train", "_seq", "_part", "slot", "shard", "words", "counts",
)


@pytest.fixture(scope="module")
def docs(spark):
    more = [(900 + i, text, "en", "s", 5) for i, text in enumerate((None, "", "same words again and once more", "same words again and once more"))]
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return given.unionByName(spark.createDataFrame(more, given.schema)).cache()


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *(F.lit(f"own {name}").alias(name) for name in INSIDE))


def held(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", F.coalesce("text", F.lit("null")).alias("text")).collect())


def kept(df, *without):
    """The caller's columns are all there with their values."""
    for name in set(INSIDE) - set(without):
        assert df.filter(F.col(name) != f"own {name}").isEmpty()


def test_spare_names(docs):
    assert spare_names(docs, "Text", "text", "x") == ["Text_", "text__", "x"]


def test_one_of_each(docs, wide):
    got, plain = jaccard_join.one_of_each(wide), jaccard_join.one_of_each(docs)
    texts = lambda df: sorted(t for _, t in held(df))
    assert texts(got) == texts(plain) and got.columns == wide.columns
    assert 0 < plain.count() < docs.count()
    kept(got)


def test_without_leaks(spark, docs, wide):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    more = benchmark.select("*", *(F.lit("b").alias(name) for name in INSIDE))
    plain = held(decontamination.without_leaks(docs, benchmark))
    got = decontamination.without_leaks(wide, more)
    assert held(got) == plain and 0 < len(plain) < docs.count()
    kept(got)
    assert decontamination.leaked_documents(wide, more).count() == decontamination.leaked_documents(docs, benchmark).count() > 0


def test_secrets(docs, wide):
    plain = {r.doc_id: r.told for r in secrets.with_spans(docs).select("doc_id", secrets.told(F.col("spans")).alias("told")).collect()}
    got = secrets.with_spans(wide)
    assert {r.doc_id: r.told for r in got.select("doc_id", secrets.told(F.col("spans")).alias("told")).collect()} == plain and any(plain.values())
    kept(got, "spans")
    covered = secrets.masked(wide, length="n_chars")
    assert held(covered) == held(secrets.masked(docs, length="n_chars")) != held(docs)
    kept(covered)


def test_scores(spark, docs, wide):
    trees = quality_trees(spark, wide, FOLDER)
    plain = {r.doc_id: r.score for r in quality_model.with_score(docs, trees).collect()}
    got = quality_model.with_score(wide, trees)
    assert {r.doc_id: r.score for r in got.collect()} == plain
    kept(got, "score")
    detector = toxicity.train(wide.limit(60), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    got = toxicity.with_score(wide.limit(20), detector, name="toxic")
    assert "toxic" in got.columns
    kept(got)


def test_stages(spark, docs, wide):
    """Each stage of the pipeline keeps the same rows beside clashing columns."""
    texts = lambda df: sorted(str(r.text) for r in df.select("text").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, FOLDER)
        assert texts(got) == texts(stage(spark, docs, FOLDER)), name
        assert got.columns == wide.columns
        kept(got)
    pieces = corpus_pipeline.STAGES[-1][1]
    same = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert same(pieces(spark, wide, FOLDER)) == same(pieces(spark, docs, FOLDER))
