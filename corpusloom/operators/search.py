"""Hybrid retrieval and the lookups around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.display import agent_text, card_preview, token_estimate
from ..functions.text import is_link_list
from ..settings import DEFAULT_LIMIT, MAX_LIMIT, OVER_FETCH
from .fusion import mmr_rerank, rrf_merge
from .text_search import TextIndex, search_text
from .vector_search import search_vector


def checked_limit(limit: object) -> int:
    """Requested result count: nothing usable or 0 means the default, below 1 means 1, above 50 is an error."""
    try:
        value = float(limit)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        value = 0.0
    if value != value or value == 0:
        return DEFAULT_LIMIT
    if value > MAX_LIMIT:
        raise ValueError(f"limit must be at most {MAX_LIMIT}")
    return max(int(value), 1)


def _fused(
    index: TextIndex, vectors: DataFrame, queries: DataFrame, limit: int, source: str | None, stem: bool
) -> DataFrame:
    """Both over-fetched lists of a query batch, fused; queries without a vector only have text hits."""
    fetch = max(limit, limit * OVER_FETCH)
    with_vector = queries.filter(_has_vector()).select("query_id", "vector")
    by_vector = search_vector(vectors, with_vector, fetch, source)
    by_text = search_text(index, queries.select("query_id", "text"), fetch, source, stem)
    return rrf_merge(by_vector, by_text)


def _has_vector() -> Column:
    return F.coalesce(F.size("vector"), F.lit(0)) > 0


def search_hybrid(
    index: TextIndex,
    vectors: DataFrame,
    queries: DataFrame,
    limit: int = DEFAULT_LIMIT,
    source: str | None = None,
    stem: bool = False,
) -> DataFrame:
    """(query_id, chunk_id, score, rank) for queries (query_id, text, vector): both lists, fused and diversified."""
    return mmr_rerank(_fused(index, vectors, queries, limit, source, stem), limit)


def search_docs(
    index: TextIndex,
    vectors: DataFrame,
    queries: DataFrame,
    limit: object = DEFAULT_LIMIT,
    source: str | None = None,
    stem: bool = False,
) -> DataFrame:
    """Hybrid results for queries with a vector, text results for the others.

    All queries take one pass: without vectors the fused and diversified order is the text order, so
    such queries only differ in the score that is reported, which is their text score.
    """
    n = checked_limit(limit)
    fused = _fused(index, vectors, queries, n, source, stem)
    judged = fused.join(queries.select("query_id", _has_vector().alias("_hybrid")), "query_id")
    reported = F.when(F.col("_hybrid"), F.col("score")).otherwise(F.col("text_score"))
    return mmr_rerank(judged.withColumn("reported", reported), n)


def hit_details(hits: DataFrame, chunks: DataFrame, docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits with content, heading, document url/title and source name."""
    return (
        hits.join(chunks.select(F.col("id").alias("chunk_id"), "doc_id", "source_id", "content", "heading"), "chunk_id")
        .join(docs.select(F.col("id").alias("doc_id"), F.col("url").alias("doc_url"), F.col("title").alias("doc_title")), "doc_id")
        .join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
        .drop("doc_id", "source_id")
    )


def get_chunks(chunks: DataFrame, docs: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks (ids: chunk_id) with their document and source."""
    return hit_details(ids.select("chunk_id").distinct(), chunks, docs, sources)


def format_hits(details: DataFrame) -> DataFrame:
    """Agent text block and card fields of each hit of `hit_details`."""
    return details.select(
        "query_id",
        "rank",
        "chunk_id",
        agent_text(*[F.col(c) for c in ("source_name", "doc_title", "doc_url", "heading", "content", "score", "chunk_id")]).alias(
            "agent_text"
        ),
        card_preview(F.col("content")).alias("preview"),
        F.floor(F.col("score") * 100 + 0.5).cast("long").alias("score_percent"),
    )


def pack_context(details: DataFrame) -> DataFrame:
    """(query_id, context, tokens): the hits of a query as one text. A group is one result list (limit rows)."""
    block: Column = F.concat(
        F.lit("--- Source: "), "source_name", F.lit(" | "), F.coalesce("doc_title", "doc_url"), F.lit(" ---\n"), "content"
    )
    grouped = details.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("_blocks"),
        F.sum(F.length("content")).alias("_chars"),
    )
    return grouped.select(
        "query_id",
        F.array_join(F.transform("_blocks", lambda b: b["block"]), "\n\n").alias("context"),
        token_estimate(F.col("_chars")).cast("long").alias("tokens"),
    )


def eval_retrieval(hits: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(n_queries, n_found, recall, mrr) of ranked hits against gold (query_id, chunk_id) pairs."""
    found = hits.filter(F.col("rank") <= k).join(gold.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"])
    best = found.groupBy("query_id").agg(F.min("rank").alias("rank"))
    asked = gold.select("query_id").distinct().join(best, "query_id", "left")
    return asked.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count("rank").alias("n_found"),
        F.round(F.coalesce(F.avg(F.col("rank").isNotNull().cast("double")), F.lit(0.0)), 6).alias("recall"),
        F.round(F.coalesce(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"),
    )


def noise_hits(details: DataFrame) -> DataFrame:
    """Hits that are link lists; a clean index returns none."""
    return details.filter(is_link_list(F.col("content")))
