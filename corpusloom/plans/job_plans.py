"""Registered queries on listings, figures, jobs and streams, with their check SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.display import format_duration
from ..operators import jobs as j, stats as s
from ..operators.embedding import hashing_embedder
from ..settings import scratch_path
from ..streaming.feeds import read_job_logs, read_job_state, write_job_logs, write_job_state
from ..streaming.ingest import current_index, run_ingest
from . import tables as t
from .snippets import DOC_CHUNKS, JOBS, SOURCES, duration_text

NOW = "2024-02-01 00:00:00"


def platform_stats(spark, d):
    return s.platform_stats(t.index(spark, d))


def source_stats(spark, d):
    return s.source_stats(t.index(spark, d))


def docs_with_chunk_count(spark, d):
    return s.docs_with_chunk_count(t.index(spark, d))


def doc_chunks(spark, d):
    rows = s.doc_chunks(t.index(spark, d))
    return rows.select("doc_id", "chunk_index", "id", "token_count")


def source_chunks(spark, d):
    rows = s.source_chunks(t.index(spark, d))
    return rows.select("source_id", F.unix_timestamp("created_at").alias("created_at"), "id", F.md5("content").alias("content_hash"))


def list_sources(spark, d):
    return s.list_sources(t.sources(spark, d), contains="SRC1").select("id", "name", "url", "enabled")


def enabled_sources(spark, d):
    return s.list_sources(t.sources(spark, d), enabled_only=True).select("id", "name", "url")


def chunks_by_source(spark, d):
    return s.chunks_by_source(t.index(spark, d))


def recent_jobs(spark, d):
    return j.recent_jobs(t.jobs(spark, d)).select("id", "source_id", "status", "duration_ms")


def jobs_by_status(spark, d):
    return j.jobs_by_status(t.jobs(spark, d))


def job_summary(spark, d):
    return j.job_summary(t.jobs(spark, d))


def avg_duration(spark, d):
    return j.avg_duration(t.jobs(spark, d))


def dropped_by_reason(spark, d):
    return j.dropped_by_reason(t.jobs(spark, d))


def live_duration(spark, d):
    return j.live_duration(t.jobs(spark, d), F.lit(NOW).cast("timestamp")).select("id", "status", "live_ms")


def format_duration_q(spark, d):
    return t.jobs(spark, d).select("id", format_duration(F.col("duration_ms")).alias("short"),
                                   format_duration(F.col("duration_ms").cast("long") * 97).alias("long"))


def job_log_tail(spark, d):
    return j.log_tail(t.job_logs(spark, d), 4).select("job_id", "id", "level", F.md5("message").alias("message_hash"))


def retry_chain(spark, d):
    return j.retry_plan(t.jobs(spark, d)).select("id", "attempt", "exhausted", "backoff_ms")


def overlap_guard(spark, d):
    requests = t.sources(spark, d).select(F.col("id").alias("source_id"), "name")
    return j.overlap_guard(requests, t.jobs(spark, d))


def stream_job_state(spark, d):
    """The events file as a stream of partial job events, folded to the latest state."""
    stream = t.table_stream(spark, d, "events")
    path = scratch_path(spark, "job-state")
    write_job_state(t.job_events(stream), path, path + "-checkpoint").awaitTermination()
    state = read_job_state(spark.read.option("basePath", path).parquet(path))
    return state.select("job_id", "source_id", "status", "duration_ms", "result", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("updated_at"))


def stream_job_log(spark, d):
    """Conversations as a log stream in which every line arrives twice."""
    stream = t.table_stream(spark, d, "conversations")
    lines = stream.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").alias("job_id"),
        F.col("role").alias("level"),
        F.md5("text").alias("message_hash"),
    )
    path = scratch_path(spark, "job-log")
    write_job_logs(lines.unionByName(lines), path, path + "-checkpoint").awaitTermination()
    return read_job_logs(spark.read.option("basePath", path).parquet(path))


def stream_ingest(spark, d):
    """The pages file streamed into a stored index: current chunks with their embedding."""
    stream = t.table_stream(spark, d, "pages")
    pages = stream.select(F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("source_id"), "url", "html")
    path = scratch_path(spark, "ingest")
    run_ingest(pages, path, path + "-checkpoint", hashing_embedder()).awaitTermination()
    index = current_index(spark, path)
    vectors = index["embeddings"].select(F.col("chunk_id").alias("id"), "model", "dimensions")
    return index["chunks"].join(vectors, "id", "left").select(
        "source_id", "doc_url", "chunk_index", "heading", "token_count", "model", "dimensions"
    )


QUERIES = {
    "platform_stats": platform_stats,
    "source_stats": source_stats,
    "docs_with_chunk_count": docs_with_chunk_count,
    "doc_chunks": doc_chunks,
    "source_chunks": source_chunks,
    "list_sources": list_sources,
    "enabled_sources": enabled_sources,
    "chunks_by_source": chunks_by_source,
    "recent_jobs": recent_jobs,
    "jobs_by_status": jobs_by_status,
    "job_summary": job_summary,
    "avg_duration": avg_duration,
    "dropped_by_reason": dropped_by_reason,
    "live_duration": live_duration,
    "format_duration": format_duration_q,
    "job_log_tail": job_log_tail,
    "retry_chain": retry_chain,
    "overlap_guard": overlap_guard,
    "stream_job_state": stream_job_state,
    "stream_job_log": stream_job_log,
    "stream_ingest": stream_ingest,
}

ORACLES = {
    "platform_stats": f"""{DOC_CHUNKS}, {SOURCES}, {JOBS}
SELECT (SELECT count(*) FROM sources) AS total_sources, (SELECT count(*) FROM docs) AS total_docs,
       (SELECT count(*) FROM chunks) AS total_chunks, (SELECT count(*) FROM embeddings) AS total_embeddings,
       (SELECT count(*) FROM jobs) AS total_jobs, (SELECT coalesce(round(avg(duration_ms)), 0)::BIGINT FROM jobs) AS avg_import_duration_ms,
       (SELECT coalesce(sum(length(content)), 0)::BIGINT FROM chunks) AS content_size""",
    "source_stats": f"""{DOC_CHUNKS}, {SOURCES}, {JOBS}
SELECT id AS source_id, name,
       (SELECT count(*) FROM docs WHERE source_id = s.id) AS doc_count,
       (SELECT count(*) FROM chunks JOIN docs USING (k) WHERE source_id = s.id) AS chunk_count,
       (SELECT round(avg(token_count))::BIGINT FROM chunks JOIN docs USING (k) WHERE source_id = s.id) AS avg_token_count,
       (SELECT arg_max(status, (created_at, id)) FROM jobs WHERE source_id = s.id) AS latest_job_status,
       (SELECT arg_max({{'v': duration_ms}}, (created_at, id)).v FROM jobs WHERE source_id = s.id) AS latest_job_duration_ms
FROM sources s""",
    "docs_with_chunk_count": f"""{DOC_CHUNKS}
SELECT d.k AS doc_id, source_id, url, title, count(c.k) AS chunk_count FROM docs d LEFT JOIN chunks c USING (k) GROUP BY d.k, source_id, url, title""",
    "doc_chunks": f"{DOC_CHUNKS} SELECT k AS doc_id, chunk_index, md5(k || '|' || chunk_index) AS id, token_count FROM chunks",
    "source_chunks": f"""{DOC_CHUNKS}
SELECT source_id, 1700000000 + seq AS created_at, md5(k || '|' || chunk_index) AS id, md5(content) AS content_hash FROM chunks JOIN docs USING (k)""",
    "list_sources": f"WITH {SOURCES} SELECT id, name, url, enabled FROM sources WHERE name ILIKE '%src1%' OR url ILIKE '%src1%'",
    "enabled_sources": f"WITH {SOURCES} SELECT id, name, url FROM sources WHERE enabled",
    "chunks_by_source": f"""{DOC_CHUNKS}
SELECT source_name AS name, count(c.k) AS chunk_count FROM docs LEFT JOIN chunks c USING (k) GROUP BY source_name""",
    "recent_jobs": f"WITH {JOBS} SELECT id, source_id, status, duration_ms FROM jobs ORDER BY created_at DESC, id DESC LIMIT 50",
    "jobs_by_status": f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY status",
    "job_summary": f"""WITH {JOBS}
SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running,
       count(*) FILTER (status = 'failed') AS failed, bool_or(status IN ('pending', 'running')) AS any_active FROM jobs""",
    "avg_duration": f"WITH {JOBS} SELECT coalesce(round(avg(duration_ms)), 0)::BIGINT AS avg_duration_ms FROM jobs",
    "dropped_by_reason": f"""WITH {JOBS}
SELECT source_id, 'link_list' AS reason, sum(k)::BIGINT AS count FROM jobs WHERE status = 'done' GROUP BY source_id
UNION ALL SELECT source_id, 'fetch_error', count(*) FROM jobs WHERE status = 'done' GROUP BY source_id""",
    "live_duration": f"""WITH {JOBS}
SELECT id, status, CASE WHEN status = 'running' THEN floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 1000)::BIGINT ELSE duration_ms END AS live_ms FROM jobs""",
    "format_duration": f"""WITH {JOBS}
SELECT id, {duration_text('duration_ms')} AS short, {duration_text('(duration_ms::BIGINT * 97)')} AS long FROM jobs""",
    "job_log_tail": """
SELECT conv_id AS job_id, conv_id || '-' || turn AS id, role AS level, md5(text) AS message_hash FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4""",
    "retry_chain": f"""WITH {JOBS}
SELECT id, retry_count + 1 AS attempt, retry_count + 1 > 3 AS exhausted,
       CASE WHEN retry_count + 1 <= 3 THEN least(pow(2, retry_count) * 10000, 120000)::BIGINT END AS backoff_ms
FROM jobs WHERE status = 'failed'""",
    "overlap_guard": f"""WITH {JOBS}, {SOURCES}
SELECT id AS source_id, name, id IN (SELECT source_id FROM jobs WHERE status = 'running') AS refused FROM sources""",
    "stream_job_state": """
SELECT user_id AS job_id, max('src' || user_id) FILTER (event_type = 'signup') AS source_id, arg_max(event_type, (ts, event_id)) AS status,
       arg_max(floor(value * 1000)::BIGINT, (ts, event_id)) FILTER (event_type = 'purchase') AS duration_ms,
       arg_max(props, (ts, event_id)) FILTER (event_type = 'error') AS result, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM events GROUP BY user_id""",
    "stream_job_log": """
SELECT DISTINCT conv_id || '-' || turn AS id, conv_id AS job_id, role AS level, md5(text) AS message_hash FROM conversations""",
}
