"""Pruned nearest neighbours against comparing everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import vector_search, vector_store
from corpusloom.operators.vector_search import search_vector
from corpusloom.operators.vector_store import fit_pivots, write_vectors

VECTORS = "chunk_id STRING, source_name STRING, model STRING, vector ARRAY<FLOAT>"
QUERIES = "query_id STRING, vector ARRAY<FLOAT>"


def clustered(seed=2, n=1500, dims=16, clusters=25):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dims))
    rows = [(f"v{i:05d}", f"s{i % 3}", "m", (centres[i % clusters] + draw.normal(0, 0.05, dims)).tolist()) for i in range(n)]
    asked = [(f"q{i}", (centres[i] + draw.normal(0, 0.05, dims)).tolist()) for i in range(8)]
    return rows, asked


def ranks(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect())


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-9)


@pytest.fixture(scope="module")
def near(spark, tmp_path_factory):
    rows, asked = clustered()
    vectors = spark.createDataFrame(rows, VECTORS)
    return vectors, spark.createDataFrame(asked, QUERIES), write_vectors(vectors, str(tmp_path_factory.mktemp("vectors")))


def test_clustered_vectors_are_found_and_spared(spark, near):
    vectors, asked, store = near
    close(ranks(search_vector(store, asked, 5)), ranks(search_vector(vectors, asked, 5)))
    least = search_vector(store, asked, 5).groupBy("query_id").agg(F.min("score").alias("least"))
    bounds = store.bounds(asked, 5)
    read = bounds.join(least, "query_id").filter(F.col("first") | (F.col("best") >= F.col("least")))
    assert read.count() <= bounds.count() / 3
    assert read.agg(F.sum("n")).first()[0] <= 8 * vectors.count() / 3


def test_bounds_hold(spark, near):
    """No vector scores more than the bound of its block."""
    _, asked, store = near
    best = {(r.query_id, r.pivot, r.shell): r.best for r in store.bounds(asked, 5).collect()}
    stored = store.vectors.collect()
    for q in asked.collect():
        for v in stored:
            score = np.dot(q.vector, v.vector) / np.linalg.norm(q.vector) / np.linalg.norm(v.vector)
            assert score <= best[q.query_id, v.pivot, v.shell] + 1e-9


def test_random_and_odd_vectors(spark, tmp_path, monkeypatch):
    """Nothing can be spared in noise; ties, vectors without length, other widths and models, null vectors."""
    monkeypatch.setattr(vector_store, "FIRST_BLOCKS", 1)
    draw = np.random.default_rng(9)
    rows = [(f"v{i:03d}", f"s{i % 3}", "mn"[i % 2], draw.normal(size=6).tolist()) for i in range(200)]
    rows += [(f"t{i}", "s1", "m", rows[7][3]) for i in range(12)] + [(f"z{i}", "s0", "m", [0.0] * 6) for i in range(9)]
    rows += [("short", "s0", "m", [1.0, 2.0]), ("empty", "s0", "m", []), ("null", "s0", "m", None), ("opposite", "s0", "m", [-x for x in rows[7][3]])]
    asked = [("a", rows[7][3]), ("b", draw.normal(size=6).tolist()), ("zero", [0.0] * 6), ("two", [2.0, 1.0]), ("wide", [1.0] * 9), ("none", [])]
    vectors, queries = spark.createDataFrame(rows, VECTORS), spark.createDataFrame(asked, QUERIES)
    store = write_vectors(vectors, str(tmp_path))
    for k in (5, 400):
        close(ranks(search_vector(store, queries, k, query_block=2, chunk_block=7)), ranks(search_vector(vectors, queries, k)))
    for limits in ({"source": "s1"}, {"model": "m", "source": "s0"}, {"model": "x"}):
        close(ranks(search_vector(store, queries, 5, **limits)), ranks(search_vector(vectors, queries, 5, **limits)))
    hit = search_vector(store, queries, 1).filter("query_id = 'a'").first()
    assert abs(sum(x * x for x in hit.vector) - 1) < 1e-6


def test_empty_store(spark, tmp_path):
    store = write_vectors(spark.createDataFrame([], VECTORS), str(tmp_path))
    assert search_vector(store, spark.createDataFrame([("q", [1.0])], QUERIES), 3).count() == 0


def test_fit():
    sample = np.eye(4)
    assert fit_pivots(sample, 9) is sample
    draw = np.random.default_rng(1)
    points = np.repeat(np.eye(4), 50, axis=0) + draw.normal(0, 0.01, (200, 4))
    centres = fit_pivots(points / np.linalg.norm(points, axis=1, keepdims=True), 4)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1)


def test_copies_tie_exactly(monkeypatch):
    """The score of a pair doesn't depend on where its vectors stand in their blocks."""
    monkeypatch.setattr(vector_search, "RANK_DIGITS", 17)
    draw = np.random.default_rng(3)
    asked = vector_search._unit(draw.normal(size=(9, 64)))
    kinds = vector_search._unit(draw.normal(size=(50, 64)))
    owner = draw.integers(0, 50, 5003)
    rows, columns, scores = vector_search.best_entries(asked, kinds[owner], 5003)
    assert len(rows) == 9 * 5003 and len(set(zip(rows, owner[columns], scores))) == 9 * 50
    few = vector_search.best_entries(asked, kinds[owner], 150)
    want = vector_search._cut(rows, columns, scores, 150)
    assert all((a == b).all() for a, b in zip(few, want))


def test_hits_below_the_score_to_beat_stay_where_they_are(spark, tmp_path):
    """In noise bounds spare nothing: a rare source is bounded by its own vectors, and only hits that can count travel."""
    draw = np.random.default_rng(4)
    rows = [(f"v{i:04d}", "rare" if i % 40 == 0 else "s", "m", draw.normal(size=16).tolist()) for i in range(1200)]
    store = write_vectors(spark.createDataFrame(rows, VECTORS), str(tmp_path))
    asked = spark.createDataFrame([("q", draw.normal(size=16).tolist())], QUERIES)
    bounds = store.bounds(asked, 5, source="rare")
    assert bounds.agg(F.sum("n")).first()[0] == 30 and bounds.filter("first").agg(F.sum("n")).first()[0] >= 5
    least = sorted((r.score for r in search_vector(store, asked, 5).collect()), reverse=True)[-1]
    near = store._near(store.bounds(asked, 5), asked.withColumn("least", F.lit(least)), 5, None, 1024, 32_768)
    assert near.count() == 5
