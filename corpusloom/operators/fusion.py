"""Rank fusion and diversity re-ranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..settings import MMR_LAMBDA, RRF_K

RANKED = "query_id STRING, chunk_id STRING, score DOUBLE, rank INT"


def rrf_merge(vector_hits: DataFrame, text_hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, chunk_id, rank from 1) lists.

    Equal scores keep the vector list's order, then the text list's. The `vector` of the first
    list and the score of the second (`text_score`) are carried along.
    """
    carried = [c for c in ("vector",) if c in vector_hits.columns]
    v = vector_hits.select("query_id", "chunk_id", F.col("rank").alias("rank_v"), *carried)
    text_score = [F.col("score").alias("text_score")] if "score" in text_hits.columns else []
    t = text_hits.select("query_id", "chunk_id", F.col("rank").alias("rank_t"), *text_score)

    def share(rank: str) -> Column:
        return F.coalesce(1 / (k + F.col(rank)), F.lit(0.0))

    merged = v.join(t, ["query_id", "chunk_id"], "full_outer").withColumn("score", share("rank_v") + share("rank_t"))
    order = W.partitionBy("query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("rank_v"), F.asc_nulls_last("rank_t")
    )
    return merged.withColumn("rank", F.row_number().over(order))


def mmr_rerank(candidates: DataFrame, limit: int, weight: float = MMR_LAMBDA) -> DataFrame:
    """Greedy maximal-marginal-relevance order of fused candidates (query_id, chunk_id, score, rank, vector).

    A query brings at most the fused over-fetch of its two lists, so a group is a few hundred rows.
    The score stays the fused one (or the column `reported`), only the order is new. Candidates without
    a vector are never penalised, and negative similarity counts as none.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        relevance = group["score"].to_numpy() / (group["score"].iloc[0] or 1.0)
        penalty = np.zeros(len(group))
        order: list[int] = []
        for _ in range(min(limit, len(group))):
            gain = np.round(weight * relevance - (1 - weight) * penalty, 12)
            gain[order] = -np.inf
            best = int(np.argmax(gain))
            order.append(best)
            penalty = np.maximum(penalty, _similarity(group["vector"], best))
        out = group.loc[order, ["query_id", "chunk_id", "reported"]].rename(columns={"reported": "score"})
        return out.assign(rank=np.arange(1, len(out) + 1, dtype="int32"))

    reported = "reported" if "reported" in candidates.columns else "score"
    columns = candidates.select("query_id", "chunk_id", "score", F.col(reported).alias("reported"), "rank", "vector")
    return columns.groupBy("query_id").applyInPandas(pick, RANKED)


def _similarity(vectors: pd.Series, at: int) -> np.ndarray:
    """Cosine of every vector with the one at `at`, 0 where one is missing or has no length."""
    pivot = vectors.iloc[at]
    out = np.zeros(len(vectors))
    if pivot is None or not len(pivot):
        return out
    pivot = np.asarray(pivot, dtype="float64")
    for i, vector in enumerate(vectors):
        if vector is not None and len(vector) == len(pivot):
            other = np.asarray(vector, dtype="float64")
            scale = np.linalg.norm(pivot) * np.linalg.norm(other)
            out[i] = pivot @ other / scale if scale else 0.0
    return out
