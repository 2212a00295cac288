"""Live job state and job logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

STATE_FIELDS = ("source_id", "status", "duration_ms", "result")


def job_state(events: DataFrame, fields: tuple[str, ...] = STATE_FIELDS) -> DataFrame:
    """Fold partial job events (job_id, event_id, ts, fields…) into the latest state per job.

    Each field keeps its last value that was not NULL. Works on streams and on batches; the state
    is one row per job and, as jobs never expire, is kept without a watermark.
    """
    at = F.struct("ts", "event_id")
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), at)).alias(f) for f in fields]
    return events.groupBy("job_id").agg(*latest, F.max("ts").alias("updated_at"))


def write_job_state(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run `job_state` over a stream; every micro-batch writes the jobs it changed.

    A batch overwrites its own folder, so a batch that is repeated after a failure changes nothing.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        job_state(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def read_job_state(changes: DataFrame) -> DataFrame:
    """Current row per job out of the written changes."""
    newest = W.partitionBy("job_id").orderBy(F.desc("batch"))
    return changes.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")


def write_job_logs(logs: DataFrame, path: str, checkpoint: str, job_id: str | None = None) -> StreamingQuery:
    """Store log lines (of one job) as they come; every micro-batch overwrites its own folder.

    Nothing is remembered between batches: lines that arrive again are dropped by `read_job_logs`.
    """
    if job_id is not None:
        logs = logs.filter(F.col("job_id") == job_id)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = logs.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(save).start()


def read_job_logs(stored: DataFrame) -> DataFrame:
    """Every log line once, as it came first."""
    first = W.partitionBy("id").orderBy("batch")
    return stored.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", "batch")
