"""Figures of a stored index that are kept with each batch and merged at read.

A batch notes, for each table and source it wrote, how many rows there are, their sums, and the
newest job. A later batch replaces whole sources, so the figures of the index are those of the
last batch of each source and table: statistics after an import read no chunk and no document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SUMMARY = (
    "table STRING, source_id STRING, n LONG, tokens LONG, chars LONG, timed LONG, duration LONG, "
    "newest STRUCT<created_at: STRING, id: STRING, status: STRING, duration_ms: LONG>, name STRING"
)


_JOB = {"created_at": "string", "id": "string", "status": "string", "duration_ms": "long"}
_NEWEST = "struct<created_at: string, id: string, status: string, duration_ms: bigint>"


def summarise(name: str, rows: DataFrame) -> DataFrame:
    """The figures of a table (source_id, …) by source; columns it lacks give nulls."""

    def figure(column: str, value: Column, kind: str, alias: str) -> Column:
        return (value if column in rows.columns else F.lit(None)).cast(kind).alias(alias)

    job = F.struct(*(F.col(c).cast(k).alias(c) for c, k in _JOB.items())) if _JOB.keys() <= set(rows.columns) else None
    return rows.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("n"),
        figure("token_count", F.expr("sum(token_count)"), "long", "tokens"),
        figure("content", F.sum(F.length("content")), "long", "chars"),
        figure("duration_ms", F.count("duration_ms"), "long", "timed"),
        figure("duration_ms", F.sum("duration_ms"), "long", "duration"),
        (F.lit(None).cast(_NEWEST) if job is None else F.max_by(job, F.struct("created_at", "id"))).alias("newest"),
        figure("name", F.max("name"), "string", "name"),
    ).select(F.lit(name).alias("table"), "*")


def _of(summary: DataFrame, table: str, *columns: Column) -> DataFrame:
    return summary.filter(F.col("table") == table).select("source_id", *columns)


def stored_source_stats(summary: DataFrame) -> DataFrame:
    """As `operators.stats.source_stats`, from the figures of `index_summary`."""
    joined = _of(summary, "sources", F.col("name"))
    parts = (
        _of(summary, "docs", F.col("n").alias("doc_count")),
        _of(summary, "chunks", F.col("n").alias("chunk_count"), F.round(F.col("tokens") / F.col("n")).cast("long").alias("avg_token_count")),
        _of(summary, "jobs", F.col("newest.status").alias("latest_job_status"), F.col("newest.duration_ms").cast("int").alias("latest_job_duration_ms")),
    )
    for part in parts:
        joined = joined.join(part, "source_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("doc_count", "chunk_count")]
    return joined.select("source_id", "name", *counts, "avg_token_count", "latest_job_status", "latest_job_duration_ms")


def stored_platform_stats(summary: DataFrame) -> DataFrame:
    """As `operators.stats.platform_stats`, from the figures of `index_summary`."""

    def total(table: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("table") == table, F.col(column))), F.lit(0)).cast("long")

    mean = F.round(total("jobs", "duration") / F.nullif(total("jobs", "timed"), F.lit(0)))
    return summary.agg(
        *(total(t, "n").alias(f"total_{t}") for t in ("sources", "docs", "chunks", "embeddings", "jobs")),
        F.coalesce(mean, F.lit(0)).cast("long").alias("avg_import_duration_ms"),
        total("chunks", "chars").alias("content_size"),
    )


def stored_chunks_by_source(summary: DataFrame) -> DataFrame:
    """As `operators.stats.chunks_by_source`, from the figures of `index_summary`."""
    named = _of(summary, "sources", F.col("name")).join(_of(summary, "chunks", F.col("n")), "source_id", "left")
    return named.select("name", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def read_summaries(spark: SparkSession, path: str, batches: dict[str, list]) -> DataFrame:
    """Of each table and source the figures of the last batch that covers it; batches are version entries by table."""
    found = [spark.createDataFrame([], SUMMARY)]
    for entries in batches.values():
        later = None
        for entry in sorted(entries, key=lambda e: -e.info["order"]):
            rows = spark.read.schema(SUMMARY).parquet(f"{path}/{entry.info['summary']}")
            found.append(rows if later is None else rows.join(later, "source_id", "left_anti").select(*rows.columns))
            covered = spark.read.schema("source_id STRING").parquet(f"{path}/{entry.info['covers']}")
            later = covered if later is None else later.unionByName(covered)
    return reduce(DataFrame.unionByName, found)
