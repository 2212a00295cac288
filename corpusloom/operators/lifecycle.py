"""Keeping the stored tables up to date: upserts, inserts, purges, deletes, audits, registration.

An index is a dict of DataFrames with the keys sources, docs, chunks, embeddings, jobs, job_logs.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import is_link_list, stable_id, word_count

Index = Mapping[str, DataFrame]

# child table, its foreign key, parent table
REFERENCES = (
    ("docs", "source_id", "sources"),
    ("chunks", "source_id", "sources"),
    ("chunks", "doc_id", "docs"),
    ("embeddings", "chunk_id", "chunks"),
    ("jobs", "source_id", "sources"),
    ("job_logs", "job_id", "jobs"),
)


def upsert_docs(stored: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """Insert or update docs by (source_id, url).

    incoming: (source_id, url, title, content_md, seq). The last row of a key sets the title; body
    and hash come from the last row that has a body, else the stored ones stay. Further stored
    columns are kept; `now` sets `updated_at` of what came in and `created_at` of what is new.
    """
    has_body = F.when(F.col("content_md").isNotNull(), F.col("seq"))
    latest = incoming.groupBy("source_id", "url").agg(
        F.max_by("title", "seq").alias("_title"),
        F.max_by("content_md", has_body).alias("_body"),
        F.lit(True).alias("_new"),
    )
    merged = stored.withColumn("_old", F.lit(True)).join(latest, ["source_id", "url"], "full_outer")
    set_here = {
        "id": stable_id(F.col("source_id"), F.col("url")),
        "title": F.when(F.col("_new"), F.col("_title")).otherwise(F.col("title")),
        "content_md": F.coalesce("_body", "content_md"),
        "content_hash": F.coalesce(F.md5("_body"), "content_hash"),
    }
    if now is not None:
        set_here["updated_at"] = F.when(F.col("_new"), now).otherwise(F.col("updated_at"))
        set_here["created_at"] = F.when(F.col("_old"), F.col("created_at")).otherwise(now)
    first = ["id", "source_id", "url", "title", "content_md", "content_hash"]
    names = [*first, *[c for c in stored.columns if c not in first]]
    return merged.select(*[set_here[c].alias(c) if c in set_here else c for c in names])


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Deterministic `doc_id` and `id` for chunks (source_id, doc_url, chunk_index, …)."""
    keyed = chunks.withColumn("doc_id", stable_id(F.col("source_id"), F.col("doc_url")))
    return keyed.withColumn("id", stable_id(F.col("doc_id"), F.col("chunk_index")))


def insert_chunks(stored: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """Stored chunks plus the incoming ones, which replace all stored chunks of their documents.

    A document that became shorter loses its former tail. Of rows with one id the last by `seq`
    counts (without `seq`, the one with the greatest text). All stored columns are kept; those the
    incoming rows lack are NULL, `created_at` is `now`.
    """
    fresh = with_chunk_ids(incoming).withColumn("token_count", word_count(F.col("content")))
    order = [F.desc(c) for c in ("seq", "content") if c in fresh.columns]
    fresh = fresh.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*order))).filter("_n = 1")
    if now is not None and "created_at" not in fresh.columns:
        fresh = fresh.withColumn("created_at", now)
    kinds = dict(stored.dtypes)
    columns = [F.col(c) if c in fresh.columns else F.lit(None).cast(kinds[c]).alias(c) for c in stored.columns]
    renewed = with_chunk_ids(incoming).select("doc_id").distinct()
    return stored.join(renewed, "doc_id", "left_anti").select(*stored.columns).unionByName(fresh.select(*columns))


def import_outcome(incoming: DataFrame) -> DataFrame:
    """(source_id, doc_count, chunk_count) of a batch of chunks; documents are counted after a
    per-document pre-aggregation, so one large source does not meet in one task."""
    per_doc = incoming.groupBy("source_id", "doc_url").agg(F.count(F.lit(1)).alias("_n"))
    return per_doc.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("_n").alias("chunk_count")
    )


def purge_noisy(index: Index, source_id: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remove stored link-list chunks and their embeddings; also (source_id, purged)."""
    noisy = is_link_list(F.col("content"))
    if source_id is not None:
        noisy = noisy & (F.col("source_id") == source_id)
    chunks = index["chunks"].filter(~noisy)
    gone = index["chunks"].filter(noisy)
    embeddings = index["embeddings"].join(gone.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
    purged = gone.groupBy("source_id").agg(F.count(F.lit(1)).alias("purged"))
    return {**index, "chunks": chunks, "embeddings": embeddings}, purged


def cascade_delete(index: Index, source_ids: DataFrame) -> dict[str, DataFrame]:
    """Delete sources (id) with everything that hangs on them.

    Rows that carry the source id are filtered on it directly; only embeddings and logs need the
    removed chunks and jobs.
    """
    gone = source_ids.select("id").distinct()
    by_source = gone.select(F.col("id").alias("source_id"))
    out = dict(index)
    out["sources"] = index["sources"].join(gone, "id", "left_anti")
    for table in ("docs", "chunks", "jobs"):
        out[table] = index[table].join(by_source, "source_id", "left_anti")
    for table, key, parent in (("embeddings", "chunk_id", "chunks"), ("job_logs", "job_id", "jobs")):
        removed = index[parent].join(by_source, "source_id", "left_semi").select(F.col("id").alias(key))
        out[table] = index[table].join(removed, key, "left_anti")
    return out


def table_counts(index: Index) -> DataFrame:
    """(table, n) for every table of an index."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in index.items()]
    return reduce(DataFrame.unionByName, parts)


def orphan_audit(index: Index) -> DataFrame:
    """(table, reference, n): rows whose parent is missing."""
    parts = []
    for child, key, parent in REFERENCES:
        missing = index[child].filter(F.col(key).isNotNull()).join(
            index[parent].select(F.col("id").alias(key)), key, "left_anti"
        )
        parts.append(
            missing.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(child).alias("table"), F.lit(f"{key} -> {parent}").alias("reference"), "n"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def register_sources(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New sources (name, url, importer_type, seq) with `registered`; a known or repeated url is a conflict."""
    known = existing.select("url", F.lit(True).alias("_known")).distinct()
    first = new.groupBy("url").agg(F.min("seq").alias("_first"))
    judged = first.join(known, "url", "left")
    joined = new.join(judged, "url")
    return joined.withColumn("registered", F.col("_known").isNull() & (F.col("seq") == F.col("_first"))).drop(
        "_known", "_first"
    )


def update_sources(sources: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Apply patches (id, then any of name, url, importer_type, enabled, config, schedule, last_imported_at).

    A NULL field of a patch leaves the stored value; patched rows get `updated_at = now`.
    """
    fields = [c for c in patches.columns if c != "id"]
    renamed = patches.select("id", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_hit"))
    joined = sources.join(renamed, "id", "left")
    joined = joined.withColumns({c: F.coalesce(f"_{c}", c) for c in fields})
    joined = joined.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
    return joined.select(*sources.columns)
