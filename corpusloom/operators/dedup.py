"""Repeated passages and changed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import content_hash, norm_key


def dedup_chunks(
    chunks: DataFrame, scope: str = "source_id", order: tuple[str, ...] = ("seq", "chunk_index")
) -> DataFrame:
    """Keep the first chunk of each normalised text within `scope`.

    `row_number() = 1` is planned with a map-side group limit: each input partition sends at
    most one row per key, so a passage repeated in a third of the corpus costs one row a task.
    """
    first = W.partitionBy(scope, "_key").orderBy(*order)
    ranked = chunks.withColumn("_key", F.md5(norm_key(F.col("content")))).withColumn("_n", F.row_number().over(first))
    return ranked.filter("_n = 1").drop("_n", "_key")


def dedup_counts(chunks: DataFrame, scope: str = "source_id") -> DataFrame:
    """(scope, total, kept, dropped). Two-step: distinct texts first, then their number per scope."""
    per_text = (
        chunks.select(scope, F.md5(norm_key(F.col("content"))).alias("_key"))
        .groupBy(scope, "_key")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return per_text.groupBy(scope).agg(
        F.sum("_n").alias("total"),
        F.count(F.lit(1)).alias("kept"),
        (F.sum("_n") - F.count(F.lit(1))).alias("dropped"),
    )


def diff_docs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Add `change` (new / changed / unchanged) to incoming (source_id, url, content_md, …) rows."""
    known = stored.select("source_id", "url", F.col("content_hash").alias("_old"), F.lit(True).alias("_known"))
    hashed = incoming.withColumn("content_hash", content_hash(F.col("content_md")))
    joined = hashed.join(known, ["source_id", "url"], "left")
    change = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_old").eqNullSafe(F.col("content_hash")), "unchanged")
        .otherwise("changed")
    )
    return joined.withColumn("change", change).drop("_old", "_known")


def skipped_docs(diff: DataFrame) -> DataFrame:
    """Unchanged documents per source: what an incremental import leaves alone."""
    return diff.groupBy("source_id").agg(
        F.count_if(F.col("change") == "unchanged").alias("skipped"),
        F.count_if(F.col("change") == "changed").alias("changed"),
        F.count_if(F.col("change") == "new").alias("new"),
    )
