import math

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.stem import stem
from corpusloom.operators.fusion import mmr_rerank, rrf_merge
from corpusloom.operators.search import (
    checked_limit,
    eval_retrieval,
    format_hits,
    hit_details,
    noise_hits,
    pack_context,
    search_docs,
    search_hybrid,
)
from corpusloom.operators.text_search import read_text_index, search_text, text_index, text_match, write_text_index
from corpusloom.operators.vector_search import best_entries, search_vector

TEXTS = {
    "c1": "Install the package with the installer",
    "c2": "The package index lists every package",
    "c3": "Configure logging and the installer package",
    "c4": "Nothing to see here",
}


@pytest.fixture(scope="module")
def index(spark):
    rows = [(k, "src" + k[-1], v) for k, v in TEXTS.items()]
    return text_index(spark.createDataFrame(rows, "chunk_id STRING, source_name STRING, content STRING"))


def queries(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "query_id STRING, text STRING")


def test_all_terms_must_occur(spark, index):
    asked = queries(spark, a="the package", b="installer package", c="package missing", d="the of", e="PACKAGE package")
    found = {(r.query_id, r.chunk_id) for r in text_match(index, asked).collect()}
    assert found == {(q, c) for q in "ae" for c in ("c1", "c2", "c3")} | {("b", "c1"), ("b", "c3")}


def test_bm25_order_and_source(spark, index):
    rows = search_text(index, queries(spark, a="package"), 2).orderBy("rank").collect()
    assert rows[0].chunk_id == "c2" and [r["rank"] for r in rows] == [1, 2]
    n, df, sizes = 4, 3, [3, 5, 4, 2]  # install package installer | package index lists every package | …
    idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 5 / (sum(sizes) / 4)))
    assert abs(rows[0].score - want) < 1e-6
    only = search_text(index, queries(spark, a="package"), 5, source="src3").collect()
    assert [r.chunk_id for r in only] == ["c3"]


def test_stems(spark):
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
             "conflated": "conflat", "hopping": "hop", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
             "conditional": "condit", "vietnamization": "vietnam", "formalize": "formal", "hopeful": "hope", "adjustment": "adjust",
             "adoption": "adopt", "controlling": "control", "rate": "rate", "generalizations": "gener", "über": "über", "42": "42"}
    assert {w: stem(w) for w in words} == words
    rows = spark.createDataFrame([("c", "s", "Installing configured packages"), ("d", "s", "")], "chunk_id STRING, source_name STRING, content STRING")
    stemmed = text_index(rows, stem=True)
    assert sorted(r.term for r in stemmed.postings.filter("chunk_id = 'c'").collect()) == ["configur", "instal", "packag"]
    assert tuple(stemmed.totals.first()) == (2, 1.5)
    assert {r.query_id for r in text_match(stemmed, queries(spark, q="install package"), stem=True).collect()} == {"q"}


def test_stored_index_reads_the_files_of_its_terms(spark, tmp_path):
    rows = [(f"c{i}", "s", f"word{i} common") for i in range(50)]
    index = text_index(spark.createDataFrame(rows, "chunk_id STRING, source_name STRING, content STRING"))
    write_text_index(index, f"{tmp_path}/index")
    stored = read_text_index(spark, f"{tmp_path}/index")
    asked = queries(spark, a="word7", b="word9 common", c="nothing")
    assert sorted(map(tuple, search_text(stored, asked, 3).collect())) == sorted(map(tuple, search_text(index, asked, 3).collect()))
    assert "dynamicpruning" in stored.postings.join(
        spark.createDataFrame([(3, "word7")], "part INT, term STRING").filter("term = 'word7'"), ["part", "term"], "left_semi"
    )._jdf.queryExecution().toString().lower()


def vectors(spark, n=300, dims=8, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(f"v{i:03d}", f"s{i % 3}", "m", [float(x) for x in rng.normal(size=dims)]) for i in range(n)]
    rows += [("zero", "s0", "m", [0.0] * dims), ("short", "s0", "m", [1.0, 2.0]), ("none", "s0", "other", [1.0] * dims), ("tie", "s0", "m", rows[7][3])]
    asked = [(f"q{i}", [float(x) for x in rng.normal(size=dims)]) for i in range(5)] + [("same", rows[7][3]), ("two", [2.0, 1.0])]
    return (
        rows, asked,
        spark.createDataFrame(rows, "chunk_id STRING, source_name STRING, model STRING, vector ARRAY<FLOAT>").repartition(4),
        spark.createDataFrame(asked, "query_id STRING, vector ARRAY<FLOAT>"),
    )


def brute(rows, asked, k):
    def cos(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        scale = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / scale), 12) if scale else 0.0

    out = {}
    for q, v in asked:
        scored = sorted((-cos(v, r[3]), r[0]) for r in rows if len(r[3]) == len(v))[:k]
        out[q] = [(c, -s) for s, c in scored]
    return out


@pytest.mark.parametrize("block", [1000, 3])
def test_vector_search_is_exact(spark, block):
    rows, asked, chunk_df, query_df = vectors(spark)
    hits = search_vector(chunk_df, query_df, 6, query_block=block, chunk_block=20 * block).orderBy("query_id", "rank").collect()
    found = {}
    for r in hits:
        found.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    want = brute(rows, asked, 6)
    assert found.keys() == want.keys()
    for q in want:
        assert [c for c, _ in found[q]] == [c for c, _ in want[q]]
        assert np.allclose([s for _, s in found[q]], [s for _, s in want[q]], atol=2e-6)
    assert found["same"][:2] == [("tie", 1.0), ("v007", 1.0)] and len(found["two"]) == 1


def test_tiles_are_bounded():
    draw = np.random.default_rng(3)
    chunks = draw.normal(size=(100_000, 64))
    chunks[50_000:50_500] = chunks[7]  # more ties than hits
    queries = draw.normal(size=(1_024, 64))
    queries[0] = chunks[7]
    tracemalloc.start()
    rows, columns, scores = best_entries(queries, chunks, 150)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert (np.bincount(rows) == 150).all() and columns[rows == 0].tolist() == [7, *range(50_000, 50_149)]
    for i in range(0, 1024, 97):
        full = np.round(chunks @ queries[i], 12)
        assert columns[rows == i].tolist() == np.lexsort((np.arange(len(full)), -full))[:150].tolist()


def test_vector_search_filters(spark):
    _, _, chunk_df, query_df = vectors(spark)
    assert search_vector(chunk_df, query_df, 400, model="other").count() == 6
    assert search_vector(chunk_df, query_df, 3, source="nobody").count() == 0
    assert search_vector(chunk_df, query_df.limit(0), 3).count() == 0


def ranked(spark, **lists):
    rows = [(q, c, i + 1) for q, ids in lists.items() for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id STRING, chunk_id STRING, rank INT")


def test_rrf(spark):
    fused = rrf_merge(ranked(spark, q=["a", "b", "c"]), ranked(spark, q=["b", "d"], p=["x"]))
    rows = fused.filter("query_id = 'q'").orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == ["b", "a", "d", "c"]
    assert abs(rows[0].score - (1 / 62 + 1 / 61)) < 1e-12
    tie = rrf_merge(ranked(spark, q=["a"]), ranked(spark, q=["b"])).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["a", "b"]
    mirrored = rrf_merge(ranked(spark, q=["b", "d"], p=["x"]), ranked(spark, q=["a", "b", "c"]))
    assert {(r.chunk_id, r.score) for r in mirrored.collect()} == {(r.chunk_id, r.score) for r in fused.collect()}


def candidates(spark, rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id STRING, chunk_id STRING, score DOUBLE, rank INT, vector ARRAY<DOUBLE>")


def test_mmr(spark):
    rows = [("a", 0.030, 1, [1.0, 0.0]), ("dup", 0.029, 2, [1.0, 0.0]), ("far", 0.028, 3, [0.0, 1.0]), ("text", 0.020, 4, None),
            ("back", 0.027, 5, [-1.0, 0.0]), ("zero", 0.010, 6, [0.0, 0.0])]
    out = mmr_rerank(candidates(spark, rows), 4).orderBy("rank").collect()
    assert [r.chunk_id for r in out] == ["a", "far", "back", "text"]
    assert [r.score for r in out] == [0.030, 0.028, 0.027, 0.020]
    plain = mmr_rerank(candidates(spark, rows), 9, weight=1.0).orderBy("rank").collect()
    assert [r.chunk_id for r in plain] == ["a", "dup", "far", "back", "text", "zero"]


def test_hybrid_and_fallback(spark, index):
    vectors_ = spark.createDataFrame(
        [("c1", "src1", "m", [1.0, 0.0]), ("c4", "src4", "m", [0.9, 0.1])], "chunk_id STRING, source_name STRING, model STRING, vector ARRAY<FLOAT>")
    asked = spark.createDataFrame([("h", "package", [1.0, 0.0]), ("t", "package", None), ("e", "package", [])], "query_id STRING, text STRING, vector ARRAY<FLOAT>")
    found = {}
    for r in search_docs(index, vectors_, asked, 3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.chunk_id)
    assert found["h"] == ["c1", "c2", "c3"]  # c4 comes third by fusion but repeats c1
    assert found["t"] == found["e"] == ["c2", "c1", "c3"]
    only = search_hybrid(index, vectors_, asked.filter("query_id = 'h'"), 3, source="src4").collect()
    assert [r.chunk_id for r in only] == ["c4"]


def test_limits():
    assert [checked_limit(x) for x in (None, 0, "0", "abc", "7", -3, 50, float("nan"))] == [10, 10, 10, 10, 7, 1, 50, 10]
    with pytest.raises(ValueError):
        checked_limit(51)


def test_results(spark):
    hits = spark.createDataFrame([("q", "c1", 0.4567, 1), ("q", "c2", 0.1, 2)], "query_id STRING, chunk_id STRING, score DOUBLE, rank INT")
    chunks = spark.createDataFrame([("c1", "d1", "s", "x" * 600, "Head"), ("c2", "d2", "s", "- [a](b)\n- [c](d)", None)], "id STRING, doc_id STRING, source_id STRING, content STRING, heading STRING")
    docs = spark.createDataFrame([("d1", "u1", "Title"), ("d2", "u2", None)], "id STRING, url STRING, title STRING")
    sources = spark.createDataFrame([("s", "Docs")], "id STRING, name STRING")
    details = hit_details(hits, chunks, docs, sources)
    first, second = format_hits(details).orderBy("rank").collect()
    assert first.agent_text == f"[Docs] Title\n## Head\n{'x' * 500}\nScore: 45.7%\nChunk: c1"
    assert first.preview == "x" * 400 + "..." and first.score_percent == 46
    assert second.agent_text.startswith("[Docs] u2\n- [a](b)")
    packed = pack_context(details).first()
    assert packed.context == f"--- Source: Docs | Title ---\n{'x' * 600}\n\n--- Source: Docs | u2 ---\n- [a](b)\n- [c](d)"
    assert packed.tokens == round((600 + 17) / 4)
    assert [r.chunk_id for r in noise_hits(details).collect()] == ["c2"]
    gold = spark.createDataFrame([("q", "c2"), ("q", "zz"), ("p", "c1")], "query_id STRING, chunk_id STRING")
    assert tuple(eval_retrieval(hits, gold, 5).first()) == (2, 1, 0.5, 0.25)
