"""Corpus figures and listings. Every table is aggregated on its own before anything is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lifecycle import Index


def _n() -> Column:
    return F.count(F.lit(1))


def platform_stats(index: Index) -> DataFrame:
    """One row of totals over all tables."""
    metrics = [
        index["sources"].select(F.lit("total_sources").alias("m"), F.lit(1).cast("double").alias("v")),
        index["docs"].select(F.lit("total_docs").alias("m"), F.lit(1).cast("double").alias("v")),
        index["embeddings"].select(F.lit("total_embeddings").alias("m"), F.lit(1).cast("double").alias("v")),
    ]
    out = None
    for df in metrics:
        part = df.groupBy("m").agg(F.sum("v").alias("v"))
        out = part if out is None else out.unionByName(part)
    chunks = index["chunks"].agg(
        _n().cast("double").alias("total_chunks"), F.sum(F.length("content")).cast("double").alias("content_size")
    )
    jobs = index["jobs"].agg(
        _n().cast("double").alias("total_jobs"), F.round(F.avg("duration_ms")).alias("avg_import_duration_ms")
    )
    for df in (chunks, jobs):
        out = out.unionByName(df.unpivot([], df.columns, "m", "v"))
    names = ("total_sources", "total_docs", "total_chunks", "total_embeddings", "total_jobs",
             "avg_import_duration_ms", "content_size")
    return out.agg(
        *[F.coalesce(F.max(F.when(F.col("m") == n, F.col("v"))), F.lit(0.0)).cast("long").alias(n) for n in names]
    )


def source_stats(index: Index) -> DataFrame:
    """Per source: documents, chunks, rounded mean tokens (NULL without chunks), latest job."""
    docs = index["docs"].groupBy("source_id").agg(_n().alias("doc_count"))
    chunks = index["chunks"].groupBy("source_id").agg(
        _n().alias("chunk_count"), F.round(F.avg("token_count")).cast("long").alias("avg_token_count")
    )
    latest = index["jobs"].groupBy("source_id").agg(
        F.max_by(F.struct("status", "duration_ms"), F.struct("created_at", "id")).alias("job")
    )
    joined = index["sources"].select(F.col("id").alias("source_id"), "name")
    for part in (docs, chunks, latest):
        joined = joined.join(part, "source_id", "left")
    return joined.select(
        "source_id",
        "name",
        F.coalesce("doc_count", F.lit(0)).alias("doc_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        "avg_token_count",
        F.col("job.status").alias("latest_job_status"),
        F.col("job.duration_ms").alias("latest_job_duration_ms"),
    )


def docs_with_chunk_count(index: Index, source_id: str | None = None) -> DataFrame:
    """Documents with their number of chunks (0 included), by url."""
    docs, chunks = index["docs"], index["chunks"]
    if source_id is not None:
        docs, chunks = docs.filter(F.col("source_id") == source_id), chunks.filter(F.col("source_id") == source_id)
    counts = chunks.groupBy("doc_id").agg(_n().alias("chunk_count"))
    listed = docs.select(F.col("id").alias("doc_id"), "source_id", "url", "title").join(counts, "doc_id", "left")
    return listed.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0))).orderBy("url")


def doc_chunks(index: Index, doc_id: str | None = None) -> DataFrame:
    """Chunks of one document in index order; of all documents, each document's chunks together and in order.

    Documents among each other have no order, so nothing is sorted over the whole table.
    """
    chunks = index["chunks"]
    if doc_id is not None:
        return chunks.filter(F.col("doc_id") == doc_id).orderBy("chunk_index")
    return chunks.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")


def source_chunks(index: Index, source_id: str | None = None) -> DataFrame:
    """Chunks of one source (or of all), newest first."""
    chunks = index["chunks"]
    if source_id is not None:
        chunks = chunks.filter(F.col("source_id") == source_id)
    return chunks.orderBy(F.desc("created_at"), "id")


def list_sources(sources: DataFrame, contains: str | None = None, enabled_only: bool = False) -> DataFrame:
    """Sources by name; optionally the enabled ones, or those with `contains` in name or url."""
    if enabled_only:
        sources = sources.filter("enabled")
    if contains:
        needle = contains.lower()
        sources = sources.filter(F.lower("name").contains(needle) | F.lower("url").contains(needle))
    return sources.orderBy("name")


def chunks_by_source(index: Index) -> DataFrame:
    """Chunk count of every source."""
    counts = index["chunks"].groupBy("source_id").agg(_n().alias("chunk_count"))
    named = index["sources"].select(F.col("id").alias("source_id"), "name").join(counts, "source_id", "left")
    return named.select("name", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
