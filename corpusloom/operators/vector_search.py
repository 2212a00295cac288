"""Exact nearest neighbours by cosine for batches of query vectors.

Every chunk has to be compared with every query of its width, but no pair is ever written out.
Queries and chunks are cut into blocks of a fixed number of rows; a query block and a chunk block
meet in one task, which multiplies them tile by tile and forwards its best k per query. Only ids and
scores travel; the vectors of the final hits are joined at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .text_search import RANK_DIGITS, top_k

if TYPE_CHECKING:
    from .vector_store import VectorStore

QUERY_BLOCK, CHUNK_BLOCK, TILE = 1024, 32_768, 4096
_SLACK = 1e-11  # more than a matrix product and rounding move a score
_HITS = "query_id STRING, chunk_id STRING, _key LONG, score DOUBLE"


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1.0, lengths)


def _by_width(vectors: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, positions, unit matrix) of the vectors of each width."""
    widths = np.array([0 if v is None else len(v) for v in vectors])
    for width in np.unique(widths[widths > 0]).tolist():
        at = np.flatnonzero(widths == width)
        yield width, at, _unit(np.stack(vectors.iloc[at].to_list()).astype("float64"))


def _cut(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best entries of every row; ties go to the lower column."""
    order = np.lexsort((columns, -scores, rows))
    rows, columns, scores = rows[order], columns[order], scores[order]
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return rows[place < k], columns[place < k], scores[place < k]


def _scores(queries: np.ndarray, chunks: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The scores of some pairs, each summed by itself: a matrix product may differ in the last bit with the place of a
    vector, which tells copies apart."""
    parts = [slice(i, i + TILE) for i in range(0, len(rows), TILE)]
    return np.concatenate([np.zeros(0), *((queries[rows[p]] * chunks[columns[p]]).sum(axis=1) for p in parts)]).round(RANK_DIGITS)


def best_entries(
    queries: np.ndarray, chunks: np.ndarray, k: int, tile: int = TILE, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, chunk row, score) of the k best chunks of each query, holding one tile of scores at a time. Scores
    below a query's `floor` are left out."""
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(chunks), tile):
        scores = queries @ chunks[start : start + tile].T
        least = np.full(len(queries), -np.inf)
        if scores.shape[1] > k:
            least = np.partition(scores, -k, axis=1)[:, -k]
        rows, columns = np.nonzero(scores >= np.maximum(least, floor)[:, None] - _SLACK)
        new = rows, columns + start, _scores(queries, chunks, rows, columns + start)
        new = tuple(part[new[2] >= floor[rows]] for part in new)
        found = _cut(*(np.concatenate(pair) for pair in zip(found, new)), k)
    return found


def _compare(k: int):
    """Hits of a block of queries (query_id, vector) in a block of chunks; of queries with a `least`, those that reach it."""

    def run(queries: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
        chunks = chunks.sort_values(["chunk_id", "_key"], ignore_index=True)
        asked = {width: (at, matrix) for width, at, matrix in _by_width(queries["vector"])}
        least = queries["least"].fillna(-np.inf).to_numpy("float64") if "least" in queries else np.full(len(queries), -np.inf)
        parts = []
        for width, at, matrix in _by_width(chunks["vector"]):
            if width in asked:
                names, wanted = asked[width]
                rows, columns, scores = best_entries(wanted, matrix, k, floor=least[names])
                at_query, at_chunk = names[rows], at[columns]
                parts.append((queries["query_id"].array[at_query], chunks["chunk_id"].array[at_chunk], chunks["_key"].array[at_chunk], scores))
        whole = [np.concatenate([np.asarray(part) for part in column]) for column in zip(*parts)] if parts else [[]] * 4
        kinds = {"query_id": object, "chunk_id": object, "_key": "int64", "score": "float64"}
        return pd.DataFrame({name: pd.Series(values, dtype=kind) for (name, kind), values in zip(kinds.items(), whole)})

    return run


def _dealt(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _for_each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def search_vector(
    vectors: DataFrame | VectorStore,
    queries: DataFrame,
    k: int,
    source: str | None = None,
    model: str | None = None,
    query_block: int = QUERY_BLOCK,
    chunk_block: int = CHUNK_BLOCK,
) -> DataFrame:
    """(query_id, chunk_id, score, vector, rank) for vectors (chunk_id, source_name, model, vector) and queries
    (query_id, vector); the vector of a hit comes back with unit length.

    The two block sizes bound what a task holds: about query_block x k hits, one tile of scores and
    one block of each side. A store of vectors reads only the blocks that can matter.
    """
    if not isinstance(vectors, DataFrame):
        return vectors.search(queries, k, source, model, query_block, chunk_block)
    if source is not None:
        vectors = vectors.filter(F.col("source_name") == source)
    if model is not None:
        vectors = vectors.filter(F.col("model") == model)
    vectors = vectors.select(F.col("chunk_id").cast("string").alias("chunk_id"), "vector", F.xxhash64("vector").alias("_key"))
    queries = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector")
    n_query, n_chunk = (max(1, -(-side.count() // size)) for side, size in ((queries, query_block), (vectors, chunk_block)))
    left = queries.select("query_id", "vector", _dealt("query_id", n_query).alias("_qb"), _for_each(n_chunk).alias("_cb"))
    right = vectors.withColumn("_cb", F.pmod(F.xxhash64("chunk_id", "_key"), F.lit(n_chunk)).cast("int"))
    right = right.select("chunk_id", "_key", "vector", "_cb", _for_each(n_query).alias("_qb"))
    hits = left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInPandas(_compare(k), _HITS)
    ranked = top_k(hits, k)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    owned = vectors.join(ranked.select("chunk_id", "_key").distinct(), ["chunk_id", "_key"], "left_semi").dropDuplicates(["chunk_id", "_key"])
    units = owned.select("chunk_id", "_key", "vector", length.alias("_length")).select(
        "chunk_id", "_key", F.transform("vector", lambda x: x.cast("double") / F.greatest(F.col("_length"), F.lit(1e-300))).alias("vector")
    )
    return ranked.join(units, ["chunk_id", "_key"]).select("query_id", "chunk_id", "score", "vector", "rank")
