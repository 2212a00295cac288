"""Training-data pipeline: from raw documents to packed token sequences.

Stages, each over all that the one before it kept:

1. quality: documents the boosted trees score below 0.7 go;
2. near duplicates: of each group of documents linked by equal or similar five-word windows
   (Jaccard 0.8 or more) the first stays;
3. benchmark: documents that hold half of a benchmark item's words in tiles go;
4. secrets: found secrets are covered, documents stay;
5. packing: the texts become pieces of sequences of at most 2048 tokens.

All but the last return the columns of documents, whatever further columns there are and whatever
their names. A null text counts as empty and is kept as null until packing. Texts of any length are
worked on whole. Of repeated rows, and of rows with equal texts, stage 2 keeps one; its choice is the
row read first. Ties in scores change nothing, as every stage judges by a limit. An empty table gives
empty stages and no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import decontamination, jaccard_join, quality_model, secrets
from corpusloom.llm.names import spare_names
from corpusloom.llm.queries_models import packed, quality_trees
from corpusloom.settings import materialise

MIN_QUALITY = 0.7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches MIN_QUALITY."""
    (quality,) = spare_names(docs, "_quality")
    scored = quality_model.with_score(docs, quality_trees(spark, docs, sf_dir), name=quality)
    return scored.filter(F.col(quality) >= MIN_QUALITY).drop(quality)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return jaccard_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def cover_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets covered."""
    return secrets.masked(docs, length="n_chars")


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packed(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("secrets", cover_secrets),
    ("packing", pack_documents),
]

# Trees, tokens and tilings are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written before the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
