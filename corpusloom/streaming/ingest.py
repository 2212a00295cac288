"""Continuous import: new page files -> changed documents -> chunks -> stored index -> embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import stable_id
from ..operators.chunking import chunk_markdown
from ..operators.dedup import dedup_chunks, diff_docs
from ..operators.embedding import Embedder, embed_pending
from ..operators.lifecycle import with_chunk_ids
from ..settings import remove_paths
from ..sources.registry import pages_to_docs
from ..sources.versions import Entry, commit_version, expire_versions, fresh_folder, read_version

DOC_STATE = "source_id STRING, url STRING, title STRING, content_md STRING, content_hash STRING, batch BIGINT"
CHUNK_STATE = (
    "id STRING, doc_id STRING, source_id STRING, doc_url STRING, chunk_index INT, content STRING, heading STRING, "
    "heading_path ARRAY<STRING>, token_count INT, batch BIGINT"
)
EMBEDDING_STATE = "id STRING, chunk_id STRING, model STRING, dimensions INT, vector ARRAY<FLOAT>, batch BIGINT"


FOLD = 16  # batches that a base takes in at once
_SCHEMAS = {"docs": DOC_STATE, "chunks": CHUNK_STATE, "embeddings": EMBEDDING_STATE}


def _rows(spark: SparkSession, path: str, name: str, entries: list[Entry], before: int) -> DataFrame:
    """Rows of a table in the base and in the folders of the batches since then, of batches before a number.

    The folders are named by the version, so nothing of an older history is listed.
    """
    folders = [f"{path}/{name}/{e.path}" for e in entries if e.name == "base" or e.info["batch"] < before]
    if not folders:
        return spark.createDataFrame([], _SCHEMAS[name])
    return spark.read.schema(_SCHEMAS[name]).parquet(*folders)


def _current(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Of each document the newest row, its chunks, and the vectors of these."""
    docs = _latest(rows["docs"], "source_id", "url")
    live = docs.select("source_id", F.col("url").alias("doc_url"), "batch")
    chunks = rows["chunks"].join(live, ["source_id", "doc_url", "batch"], "left_semi")
    texts = chunks.select(stable_id(F.col("id"), F.md5("content")).alias("chunk_id")).distinct()
    return {"docs": docs, "chunks": chunks, "embeddings": rows["embeddings"].join(texts, "chunk_id", "left_semi")}


def fold(spark: SparkSession, path: str, number: int, entries: list[Entry], before: int) -> tuple[int, list[Entry]]:
    """Write the state before a batch as a new base and return the version that names it.

    The folders it takes in are deleted by the fold after it, so readers of the version before stay served.
    """
    folder = fresh_folder("base")
    for name, rows in _current({name: _rows(spark, path, name, entries, before) for name in _SCHEMAS}).items():
        rows.write.parquet(f"{path}/{name}/{folder}")
    former = [e.path for e in entries if e.name == "base" or e.info["batch"] < before]
    outdated = [p for e in entries if e.name == "base" for p in e.info["former"]]
    kept = [e for e in entries if e.name == "batch" and e.info["batch"] >= before]
    base = Entry("base", folder, {"former": former})
    commit_version(spark, path, number + 1, [base, *kept])
    remove_paths(spark, [f"{path}/{name}/{p}" for name in _SCHEMAS for p in outdated])
    expire_versions(spark, path, number)
    return number + 1, [base, *kept]


def _latest(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of the newest batch of each key."""
    newest = rows.groupBy(*key).agg(F.max("batch").alias("batch"))
    return rows.join(newest, [*key, "batch"], "left_semi")


def ingest_batch(pages: DataFrame, index_path: str, embedder: Embedder, batch_id: int) -> None:
    """Import pages (source_id, url, html[, seq]) of one micro-batch; of one url the last by `seq` counts.

    Each batch writes only a folder of its own: unchanged documents are skipped, the chunks of a changed
    document supersede its earlier ones (see `current_index`), and a repeated batch writes the same
    rows again. After `FOLD` batches the current rows become a new base, so what a batch reads depends
    on the size of the index and not on the length of its history. All chunks are stored; repeated
    passages are dropped at read, because the document that holds the first copy may change later.
    """
    spark = pages.sparkSession
    number, entries = read_version(spark, index_path)
    if sum(e.name == "batch" and e.info["batch"] < batch_id for e in entries) >= FOLD:
        number, entries = fold(spark, index_path, number, entries, batch_id)
    here = f"batch={batch_id}"
    docs_path, chunks_path, vectors_path = (f"{index_path}/{t}/{here}" for t in ("docs", "chunks", "embeddings"))
    stored = _latest(_rows(spark, index_path, "docs", entries, batch_id), "source_id", "url")
    docs = pages_to_docs(pages)
    order = F.struct(*[c for c in ("seq", "title", "text") if c in docs.columns])
    last = docs.groupBy("source_id", "url").agg(F.max_by(F.struct("title", "text"), order).alias("_d"))
    incoming = last.select("source_id", "url", "_d.title", F.col("_d.text").alias("content_md"))
    fresh = diff_docs(incoming, stored.select("source_id", "url", "content_hash")).filter("change <> 'unchanged'")
    stamp = F.lit(batch_id).cast("long").alias("batch")
    fresh.drop("change").select("*", stamp).write.mode("overwrite").parquet(docs_path)

    changed = spark.read.parquet(docs_path)
    chunks = chunk_markdown(changed.select("source_id", F.col("url").alias("doc_url"), F.col("content_md").alias("text")))
    with_chunk_ids(chunks).select("*", stamp).write.mode("overwrite").parquet(chunks_path)

    written = spark.read.parquet(chunks_path)
    known = _rows(spark, index_path, "embeddings", entries, batch_id)
    # A chunk id is its place in the document, so a changed text needs a new vector.
    texts = written.withColumn("id", stable_id(F.col("id"), F.md5("content")))
    embed_pending(texts, known, embedder).select("*", stamp).write.mode("overwrite").parquet(vectors_path)
    others = [e for e in entries if e.path != here]
    commit_version(spark, index_path, number + 1, [*others, Entry("batch", here, {"batch": batch_id})])


def run_ingest(pages: DataFrame, index_path: str, checkpoint: str, embedder: Embedder) -> StreamingQuery:
    """Stream page files (source_id, url, html) into the index below `index_path`."""
    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: ingest_batch(batch, index_path, embedder, batch_id))
        .start()
    )


def current_index(spark: SparkSession, index_path: str) -> dict[str, DataFrame]:
    """Current docs, chunks and embeddings of an ingested index."""
    _, entries = read_version(spark, index_path)
    state = _current({name: _rows(spark, index_path, name, entries, 2**62) for name in _SCHEMAS})
    chunks = dedup_chunks(state["chunks"], "source_id", ("doc_url", "chunk_index"))
    texts = chunks.select(stable_id(F.col("id"), F.md5("content")).alias("chunk_id"), F.col("id").alias("_chunk"))
    embeddings = state["embeddings"].drop("batch").join(texts, "chunk_id").withColumn("chunk_id", F.col("_chunk")).drop("_chunk")
    return {"docs": state["docs"].drop("batch"), "chunks": chunks.drop("batch"), "embeddings": embeddings}
