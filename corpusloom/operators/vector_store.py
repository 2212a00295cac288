"""Stored vectors that answer exact nearest-neighbour searches without reading all of them.

Vectors are clustered round pivots, separately for each model and width, and stored in a folder for each
pivot, ordered by their angle to it. A block is a shell of a cluster: the vectors of a pivot within a
range of angles. A query at angle f to a pivot is at least max(a - f, f - b) away from every vector
of the shell (a, b), because angles obey the triangle inequality, so the shell's best score is known
before it is read. A search reads the most promising blocks of each query, takes its k-th score, and then
reads only blocks that can still reach it. Results are those of comparing everything. A query meets all
blocks of a pivot at once, so its vector travels once for each pivot, and only hits that reach the
score to beat leave the comparison: where bounds spare little, vectors still move once and hits stay few. A
search of one source counts and bounds its blocks by the vectors of that source.

Pivots are fitted on a bounded sample; they only decide how much is read. Vectors without length
have a cluster of their own, whose score is 0 for every query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, pi, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..settings import materialise
from .text_search import top_k
from .vector_search import CHUNK_BLOCK, QUERY_BLOCK, _by_width, _compare, _unit

SHELLS = 128  # shells of equal width between angle 0 and a half turn
PIVOT_FLOATS = 1 << 21  # numbers of all pivots of a model and width (16 MB)
SAMPLE_FLOATS = 1 << 22  # numbers a fit reads (32 MB)
FIT_ROUNDS = 6
FIRST_BLOCKS = 2  # blocks a query reads, or more to have k vectors, before it knows the score to beat
_SLACK = 1e-6  # angles are only as exact as the cosines they come from
_STORED = "chunk_id STRING, source_name STRING, model STRING, vector ARRAY<FLOAT>, angle DOUBLE, shell INT, pivot INT"


class VectorStore(NamedTuple):
    """Stored vectors below `path`."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        """(chunk_id, source_name, model, vector, angle, shell, pivot) of every vector."""
        return self.spark.read.schema(_STORED).parquet(f"{self.path}/vectors")

    @property
    def blocks(self) -> DataFrame:
        """(pivot, shell, n, low, high): size and angles of every block."""
        return self.spark.read.parquet(f"{self.path}/blocks")

    @property
    def pivots(self) -> DataFrame:
        """(pivot, model, width, centre); a pivot without centre has the vectors without length."""
        return self.spark.read.parquet(f"{self.path}/pivots")

    def bounds(self, queries: DataFrame, k: int, model: str | None = None, source: str | None = None) -> DataFrame:
        """(query_id, pivot, shell, n, best, first): the best score each block of its width can hold for each query.

        `first` marks the blocks a query starts with.
        """
        pivots = self.pivots if model is None else self.pivots.filter(F.col("model") == model)
        blocks = self.blocks if source is None else _sizes(self.vectors.filter(F.col("source_name") == source))
        known = blocks.join(F.broadcast(pivots.select("pivot")), "pivot").toPandas()  # SHELLS of each pivot at most
        rows = pivots.collect()
        lengthless = {r.pivot for r in rows if not r.centre}
        widths: dict[int, tuple[np.ndarray, ...]] = {}
        for width in {r.width for r in rows}:
            mine = [r for r in rows if r.width == width]
            centres = np.array([r.centre if r.centre else [0.0] * width for r in mine])
            at = {r.pivot: i for i, r in enumerate(mine)}
            part = known[known["pivot"].isin(at)].sort_values(["pivot", "shell"])
            flat = part["pivot"].isin(lengthless).to_numpy()
            widths[width] = (centres, part["pivot"].map(at).to_numpy(np.int64), *(part[c].to_numpy() for c in ("pivot", "shell", "n", "low", "high")), flat)
        shared, least_blocks = self.spark.sparkContext.broadcast(widths), FIRST_BLOCKS

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for width, at, units in _by_width(batch["vector"]):
                    if width not in shared.value:
                        continue
                    centres, owner, pivot, shell, n, low, high, flat = shared.value[width]
                    for i in range(len(at)):
                        angle = np.arccos(np.clip(centres @ units[i], -1, 1))[owner]
                        away = np.maximum(np.maximum(angle - high, low - angle) - _SLACK, 0)
                        best = np.where(flat | (not units[i].any()), 0.0, np.cos(np.minimum(away, pi)))
                        order = np.argsort(-best, kind="stable")
                        before = np.cumsum(n[order]) - n[order]
                        first = (np.arange(len(order)) < least_blocks) | (before < k)
                        yield pd.DataFrame(
                            {"query_id": batch["query_id"].iloc[at[i]], "pivot": pivot[order], "shell": shell[order], "n": n[order],
                             "best": best[order], "first": first}
                        )

        return queries.mapInPandas(run, "query_id STRING, pivot INT, shell INT, n LONG, best DOUBLE, first BOOLEAN")

    def _near(self, needed: DataFrame, queries: DataFrame, k: int, source: str | None, query_block: int, chunk_block: int) -> DataFrame:
        """(query_id, chunk_id, _key, pivot, score): the k best of each query in each group of a pivot it needs.

        Of a pivot, the blocks that any query needs are read. Queries are (query_id, vector) with the score to beat, `least`, if known.
        """
        blocks = materialise(needed.groupBy("pivot", "shell").agg(F.first("n").alias("n")), "blocks")
        pairs = needed.select("query_id", "pivot").distinct()
        sizes = blocks.groupBy("pivot").agg(F.ceil(F.sum("n") / chunk_block).cast("int").alias("cells"))
        groups = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("groups"))
        cells = materialise(sizes.join(groups, "pivot"), "cells")
        wanted = [r.pivot for r in cells.select("pivot").collect()]  # as many as there are pivots
        stored = self.vectors.filter(F.col("pivot").isin(wanted))
        if source is not None:
            stored = stored.filter(F.col("source_name") == source)
        key = F.xxhash64("vector").alias("_key")
        read = stored.join(blocks.select("pivot", "shell"), ["pivot", "shell"], "left_semi")
        rows = read.select("pivot", "chunk_id", "vector", key).join(cells, "pivot")
        right = rows.withColumn("_cell", F.pmod(F.xxhash64("chunk_id", "_key"), F.col("cells")).cast("int")).select(
            "pivot", "_cell", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("_group"), "chunk_id", "vector", "_key"
        )
        asked = pairs.join(cells, "pivot").join(queries, "query_id")
        left = asked.withColumn("_group", F.pmod(F.xxhash64("query_id"), F.col("groups")).cast("int")).select(
            "pivot", "_group", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("_cell"), *queries.columns
        )
        compare = _compare(k)

        def run(block: tuple, some: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
            return compare(some, chunks).assign(pivot=block[0])

        by = ["pivot", "_group", "_cell"]
        schema = "query_id STRING, chunk_id STRING, _key LONG, score DOUBLE, pivot INT"
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, schema)

    def search(
        self, queries: DataFrame, k: int, source: str | None = None, model: str | None = None,
        query_block: int = QUERY_BLOCK, chunk_block: int = CHUNK_BLOCK,
    ) -> DataFrame:
        """(query_id, chunk_id, score, vector, rank) as `search_vector` gives them."""
        asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "vector")
        bounds = materialise(self.bounds(asked, k, model, source), "bounds")
        near = [k, source, query_block, chunk_block]
        ranked = materialise(top_k(self._near(bounds.filter("first"), asked, *near), k), "nearest")
        beat = ranked.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        known = bounds.join(beat, "query_id", "left")
        needed = known.filter(F.col("first") | F.col("least").isNull() | (F.col("best") >= F.col("least"))).drop("least")
        if not needed.filter("not first").isEmpty():  # the first blocks are met again, with the others of their pivots
            ranked = materialise(top_k(self._near(needed, asked.join(beat, "query_id", "left"), *near), k), "nearest")
        pivots = [r.pivot for r in ranked.select("pivot").distinct().collect()]
        held = self.vectors.filter(F.col("pivot").isin(pivots)).select("chunk_id", "vector", F.xxhash64("vector").alias("_key"), "pivot")
        held = held.join(ranked.select("pivot", "chunk_id", "_key").distinct(), ["pivot", "chunk_id", "_key"], "left_semi").dropDuplicates(["chunk_id", "_key"])
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        units = held.select("chunk_id", "_key", "vector", F.greatest(length, F.lit(1e-300)).alias("_length")).select(
            "chunk_id", "_key", F.transform("vector", lambda x: x.cast("double") / F.col("_length")).alias("vector")
        )
        return ranked.drop("pivot").join(units, ["chunk_id", "_key"]).select("query_id", "chunk_id", "score", "vector", "rank")


def _sizes(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("pivot", "shell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))


def fit_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """n unit vectors that the sample's unit vectors lie near to: farthest points first, then moved to the means."""
    if len(sample) <= n:
        return sample
    draw = np.random.default_rng(7)
    centres = sample[np.sort(draw.choice(len(sample), n, replace=False))].copy()
    for _ in range(FIT_ROUNDS):
        owner = np.concatenate([(sample[i : i + 8192] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 8192)])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        alone = np.linalg.norm(sums, axis=1) > 0
        centres[alone] = _unit(sums[alone])
    return centres


def write_vectors(vectors: DataFrame, path: str) -> VectorStore:
    """Store vectors (chunk_id, source_name, model, vector); null and empty ones are left out."""
    spark = vectors.sparkSession
    given = vectors.filter(F.size("vector") > 0).select(
        F.col("chunk_id").cast("string").alias("chunk_id"), F.col("source_name").cast("string").alias("source_name"),
        F.col("model").cast("string").alias("model"), F.col("vector").cast("array<float>").alias("vector"),
    )
    given = materialise(given, "vectors")
    kinds = given.groupBy("model", F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()  # models and widths
    pivots: list[tuple[int, str, int, list[float] | None]] = []
    places: dict[tuple[str, int], tuple[int, np.ndarray]] = {}
    for kind in sorted(kinds, key=lambda r: (str(r.model), r.width)):
        n = min(max(1, ceil(sqrt(kind.n))), max(1, PIVOT_FLOATS // kind.width))
        most = max(n, min(32 * n, SAMPLE_FLOATS // kind.width))
        mine = given.filter(F.col("model").eqNullSafe(kind.model) & (F.size("vector") == kind.width))
        share = min(1.0, 1.2 * most / kind.n)  # of the hashes, so that few rows are ordered
        drawn = mine.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
        sample = drawn.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(most).select("vector").toPandas()["vector"]
        units = _unit(np.stack(sample.to_list()).astype("float64")) if len(sample) else np.zeros((0, kind.width))
        centres = fit_pivots(units[units.any(axis=1)], n)
        if not len(centres):
            centres = np.eye(1, kind.width)
        first = len(pivots)
        places[kind.model, kind.width] = first, centres
        pivots += [(first + i, kind.model, kind.width, c.tolist()) for i, c in enumerate(centres)]
        pivots.append((len(pivots), kind.model, kind.width, None))
    shared = spark.sparkContext.broadcast(places)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pivot, angle = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            names = batch["model"].where(batch["model"].notna(), None)
            for (model, width), (first, centres) in shared.value.items():
                same = [m == model and len(v) == width for m, v in zip(names, batch["vector"])]
                at = np.flatnonzero(same)
                for i in range(0, len(at), 4096):
                    part = at[i : i + 4096]
                    units = _unit(np.stack(batch["vector"].iloc[part].to_list()).astype("float64"))
                    cosines = units @ centres.T
                    near = cosines.argmax(axis=1)
                    angle[part] = np.arccos(np.clip(cosines[np.arange(len(part)), near], -1, 1))
                    pivot[part] = np.where(units.any(axis=1), first + near, first + len(centres))
            shell = np.minimum((angle / pi * SHELLS).astype(np.int32), SHELLS - 1)
            yield batch.assign(angle=angle, shell=shell, pivot=pivot)

    placed = given.mapInPandas(run, _STORED)
    ordered = placed.hint("rebalance", "pivot").sortWithinPartitions("pivot", "angle")
    ordered.write.mode("overwrite").option("parquet.block.size", 8 << 20).partitionBy("pivot").parquet(f"{path}/vectors")
    store = VectorStore(spark, path)
    _sizes(store.vectors).write.mode("overwrite").parquet(f"{path}/blocks")
    made = spark.createDataFrame(pivots, "pivot INT, model STRING, width INT, centre ARRAY<DOUBLE>")
    made.write.mode("overwrite").parquet(f"{path}/pivots")
    return store
