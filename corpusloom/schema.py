"""Explicit schemas of the stored tables."""

SOURCES = (
    "id STRING, name STRING, url STRING, importer_type STRING, enabled BOOLEAN, config STRING, schedule STRING, "
    "last_imported_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
DOCS = (
    "id STRING, source_id STRING, url STRING, title STRING, content_md STRING, content_hash STRING, "
    "indexed_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"
)
CHUNKS = (
    "id STRING, doc_id STRING, source_id STRING, content STRING, heading STRING, heading_path ARRAY<STRING>, "
    "chunk_index INT, token_count INT, created_at TIMESTAMP"
)
EMBEDDINGS = (
    "id STRING, chunk_id STRING, model STRING, dimensions INT, vector ARRAY<FLOAT>, created_at TIMESTAMP"
)
JOBS = (
    "id STRING, type STRING, source_id STRING, status STRING, error STRING, retry_count INT, max_retries INT, "
    "duration_ms INT, result STRING, started_at TIMESTAMP, finished_at TIMESTAMP, created_at TIMESTAMP"
)
JOB_LOGS = "id STRING, job_id STRING, message STRING, level STRING, created_at TIMESTAMP"
JOB_RESULT = "docCount INT, chunkCount INT, chunksDropped ARRAY<STRUCT<reason: STRING, count: INT>>"
JOB_STATES = ("pending", "running", "done", "failed", "cancelled")
