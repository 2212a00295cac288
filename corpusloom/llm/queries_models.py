"""Registered queries of the operators that run Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontamination, jaccard_join, language_model, quality_model, toxicity
from .labels import fold
from .packing import Packer, pack
from .queries_native import documents


def packer() -> Packer:
    """The public 50k vocabulary in both of its forms."""
    import public_tokenizers

    return Packer(
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of `docs` with a checksum in place of their ids."""
    return pack(docs, packer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_harmonic_packing(spark: SparkSession, d: str) -> DataFrame:
    return packed(documents(spark, d))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet")


def quality_trees(spark: SparkSession, docs: DataFrame, d: str) -> quality_model.Trees:
    """Trees learned from the labels outside of the held-out fold."""
    known = _labels(spark, d).filter(fold(F.col("doc_id"), 4) != 2)
    return quality_model.train(docs, known)


def op4_quality_trees(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    scored = quality_model.with_score(docs, quality_trees(spark, docs, d))
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op5_string_tiling(spark: SparkSession, d: str) -> DataFrame:
    found = decontamination.leaked_documents(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "item_words", "matched_words", "coverage", F.size("tiles").alias("n_tiles"))


def op6_log_bilinear(spark: SparkSession, d: str) -> DataFrame:
    part = fold(F.col("doc_id"), 10)
    scored = language_model.score_documents(documents(spark, d), part != 0)
    return scored.select("doc_id", (part == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_noisy_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    detector = toxicity.train(docs, _labels(spark, d).filter(fold(F.col("doc_id"), 5) != 0))
    scored = toxicity.with_score(docs, detector)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_minhash_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.linked_rows(documents(spark, d)).select("doc_id", "class_id", "n_links")


QUERIES = {
    "op2_harmonic_packing": op2_harmonic_packing,
    "op4_quality_trees": op4_quality_trees,
    "op5_string_tiling": op5_string_tiling,
    "op6_log_bilinear": op6_log_bilinear,
    "op7_noisy_toxicity": op7_noisy_toxicity,
    "op8_minhash_join": op8_minhash_join,
}
ORACLES: dict[str, str] = {}
