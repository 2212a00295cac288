"""Import jobs: listings, figures, retry plan, overlap guard and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.arrays import struct_rows
from ..functions.display import format_duration
from ..schema import JOB_RESULT
from ..settings import LOG_TAIL, RECENT_JOBS

# --- fixed values: retry back-off ------------------------------------------------------
BACKOFF_FIRST_MS = 10_000
BACKOFF_MOST_MS = 120_000


def recent_jobs(jobs: DataFrame, n: int = RECENT_JOBS) -> DataFrame:
    """The newest n jobs (planned as a top-n: no full sort)."""
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """(pending, running, failed, any_active) in one pass."""
    status = F.col("status")
    return jobs.agg(
        *[F.count_if(status == s).alias(s) for s in ("pending", "running", "failed")],
        F.coalesce(F.bool_or(status.isin("pending", "running")), F.lit(False)).alias("any_active"),
    )


def avg_duration(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.coalesce(F.round(F.avg("duration_ms")).cast("long"), F.lit(0)).alias("avg_duration_ms"))


def dropped_by_reason(jobs: DataFrame) -> DataFrame:
    """(source_id, reason, count) out of the result JSON; malformed JSON counts as none."""
    dropped = F.from_json("result", JOB_RESULT)["chunksDropped"]
    rows = struct_rows(jobs, ["source_id"], dropped)
    return rows.groupBy("source_id", "reason").agg(F.sum("count").alias("count"))


def live_duration(jobs: DataFrame, now: Column) -> DataFrame:
    """Add `live_ms`: time since the start for running jobs, else the stored duration."""
    since = F.timestamp_diff("MILLISECOND", F.col("started_at"), now)
    return jobs.withColumn(
        "live_ms", F.when(F.col("status") == "running", since).otherwise(F.col("duration_ms").cast("long"))
    )


def with_duration_text(jobs: DataFrame, ms: str = "duration_ms") -> DataFrame:
    return jobs.withColumn("duration_text", format_duration(F.col(ms)))


def log_tail(logs: DataFrame, n: int = LOG_TAIL) -> DataFrame:
    """The newest n lines of each job in chronological order. Each task forwards at most n lines per job."""
    newest = W.partitionBy("job_id").orderBy(F.desc("created_at"), F.desc("id"))
    return (
        logs.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= n)
        .drop("_n")
        .orderBy("job_id", "created_at", "id")
    )


def retry_plan(jobs: DataFrame) -> DataFrame:
    """Failed jobs with `attempt`, `backoff_ms` (NULL once exhausted) and `exhausted`."""
    exhausted = F.col("retry_count") + 1 > F.col("max_retries")
    wait = F.least(F.pow(F.lit(2), F.col("retry_count")) * BACKOFF_FIRST_MS, F.lit(BACKOFF_MOST_MS)).cast("long")
    return (
        jobs.filter(F.col("status") == "failed")
        .withColumn("attempt", F.col("retry_count") + 1)
        .withColumn("exhausted", exhausted)
        .withColumn("backoff_ms", F.when(~exhausted, wait))
    )


def overlap_guard(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add `refused` to import requests (source_id): true where that source has a running job."""
    running = jobs.filter(F.col("status") == "running").select("source_id").distinct()
    flagged = running.withColumn("_running", F.lit(True))
    return requests.join(flagged, "source_id", "left").withColumn(
        "refused", F.coalesce("_running", F.lit(False))
    ).drop("_running")
