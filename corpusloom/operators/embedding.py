"""Embedding coverage and back-fill."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import stable_id
from ..functions.vectors import normalise
from ..settings import EMBED_BATCH
from ..sources.versions import Entry, commit_version, fresh_folder, read_version

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Embedder:
    """A named model: `embed` turns a list of texts into a list of vectors (empty = no result)."""

    model: str
    dimensions: int
    embed: Callable[[list[str]], list[list[float]]]


def hashing_embedder(dimensions: int = 64) -> Embedder:
    """Feature hashing of words with unit length: needs no model files and is deterministic.

    The first eight bytes of a word's MD5, as a little-endian number, give its dimension (remainder)
    and its sign (top bit).
    """

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dimensions))
        for row, text in enumerate(texts):
            if codes := [_word_code(word) for word in _WORD.findall(text.lower())]:
                hashed = np.array(codes, dtype="uint64")
                signs = np.where(hashed >> np.uint64(63), 1.0, -1.0)
                out[row] = np.bincount((hashed % np.uint64(dimensions)).astype("int64"), signs, dimensions)
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(lengths == 0, 1, lengths)).tolist()

    return Embedder(f"hashing-{dimensions}", dimensions, embed)


@lru_cache(maxsize=1 << 17)
def _word_code(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "little")


def pending_chunks(chunks: DataFrame, embeddings: DataFrame, model: str, source_id: str | None = None) -> DataFrame:
    """Chunks (id, …) without an embedding of `model`."""
    if source_id is not None:
        chunks = chunks.filter(F.col("source_id") == source_id)
    done = embeddings.filter(F.col("model") == model).select(F.col("chunk_id").alias("id"))
    return chunks.join(done, "id", "left_anti")


def count_pending(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    return pending_chunks(chunks, embeddings, model).groupBy("source_id").agg(F.count(F.lit(1)).alias("pending"))


def embed_pending(chunks: DataFrame, embeddings: DataFrame, embedder: Embedder) -> DataFrame:
    """New embedding rows for the pending chunks. One pass; chunks without a vector are left out."""
    todo = pending_chunks(chunks, embeddings, embedder.model).select("id", "content")
    embed = embedder.embed
    schema = pa.schema([("chunk_id", pa.string()), ("vector", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMBED_BATCH):
                part = batch.slice(at, EMBED_BATCH)
                vectors = embed(part.column("content").to_pylist())
                rows = [(i, v) for i, v in zip(part.column("id").to_pylist(), vectors) if len(v)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in rows], pa.string()), pa.array([v for _, v in rows], schema.field(1).type)],
                    schema=schema,
                )

    made = todo.mapInArrow(run, "chunk_id STRING, vector ARRAY<FLOAT>")
    return made.select(
        stable_id(F.col("chunk_id"), F.lit(embedder.model)).alias("id"),
        "chunk_id",
        F.lit(embedder.model).alias("model"),
        F.size("vector").alias("dimensions"),
        "vector",
    )


_LEDGER = "chunk_id STRING, vector ARRAY<FLOAT>, error STRING"


def _attempts(embed: Callable[[list[str]], list[list[float]]], ids: list[str], texts: list[str]) -> Iterator[tuple]:
    """(id, vector, error) of each text; a batch that fails is halved until the texts that fail stand alone."""
    try:
        vectors = embed(texts)
    except Exception as error:  # noqa: BLE001: whatever the model raises is noted, not passed on
        if len(texts) > 1:
            half = len(texts) // 2
            yield from _attempts(embed, ids[:half], texts[:half])
            yield from _attempts(embed, ids[half:], texts[half:])
        else:
            yield ids[0], None, f"{type(error).__name__}: {error}"[:500]
        return
    yield from ((i, v if len(v) else None, None if len(v) else "empty vector") for i, v in zip(ids, vectors))


def _ledger(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, vector, error, run) of all attempts below `path`."""
    _, entries = read_version(spark, path)
    runs = [spark.read.schema(_LEDGER).parquet(f"{path}/{e.path}").withColumn("run", F.lit(e.info["run"])) for e in entries]
    return reduce(DataFrame.unionByName, runs) if runs else spark.createDataFrame([], f"{_LEDGER}, run INT")


def back_fill(chunks: DataFrame, embedder: Embedder, path: str, slices: int = 8) -> int:
    """Embed the chunks (id, content) that have no vector below `path` yet, and return the run's number.

    The work is done in slices by hash of the id; each is written and noted on its own, so a job that dies
    loses one slice and the next run goes on behind it. A text the model fails on is noted with its
    error and stops neither its batch nor the run; a later run tries it again.
    """
    spark, embed = chunks.sparkSession, embedder.embed
    number, entries = read_version(spark, path)
    run_number = max((e.info["run"] for e in entries), default=0) + 1
    done = _ledger(spark, path).filter("vector IS NOT NULL").select(F.col("chunk_id").alias("id"))
    todo = chunks.select("id", F.coalesce("content", F.lit("")).alias("content")).join(done, "id", "left_anti")
    schema = pa.schema([("chunk_id", pa.string()), ("vector", pa.list_(pa.float32())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMBED_BATCH):
                part = batch.slice(at, EMBED_BATCH)
                rows = list(_attempts(embed, part.column("id").to_pylist(), part.column("content").to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), schema.types)], schema=schema)

    for i in range(slices):
        folder = fresh_folder("run")
        mine = todo.filter(F.pmod(F.xxhash64("id"), F.lit(slices)) == i)
        mine.mapInArrow(run, _LEDGER).write.parquet(f"{path}/{folder}")
        entries.append(Entry("run", folder, {"run": run_number}))
        number += 1
        commit_version(spark, path, number, entries)
    return run_number


def filled(spark: SparkSession, path: str, embedder: Embedder) -> DataFrame:
    """(id, chunk_id, model, dimensions, vector, run): the embedding rows of a back-fill."""
    made = _ledger(spark, path).filter("vector IS NOT NULL")
    ids = stable_id(F.col("chunk_id"), F.lit(embedder.model)).alias("id")
    return made.select(ids, "chunk_id", F.lit(embedder.model).alias("model"), F.size("vector").alias("dimensions"), "vector", "run")


def unfilled(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, tries, error): the chunks without a vector so far, with the error of the last try."""
    tries = _ledger(spark, path).groupBy("chunk_id").agg(
        F.count(F.lit(1)).alias("tries"), F.max_by("error", "run").alias("error"), F.bool_or(F.col("vector").isNotNull()).alias("_done")
    )
    return tries.filter("NOT _done").drop("_done")


def normalise_vectors(embeddings: DataFrame) -> DataFrame:
    return embeddings.withColumn("vector", normalise(F.col("vector")))


def embedding_stats(embeddings: DataFrame) -> DataFrame:
    """Coverage per model and declared width, with vectors whose real width differs."""
    return embeddings.groupBy("model", "dimensions").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("vector") != F.col("dimensions")).alias("mismatched"),
    )
