import pytest
from pyspark.sql import functions as F

from corpusloom.functions.vectors import cosine, format_vector, normalise, parse_vector
from corpusloom.operators.dedup import dedup_counts, diff_docs
from corpusloom.operators import embedding
from corpusloom.operators.embedding import (
    Embedder,
    back_fill,
    embed_pending,
    embedding_stats,
    filled,
    hashing_embedder,
    pending_chunks,
    unfilled,
)
from corpusloom.operators.lifecycle import (
    cascade_delete,
    import_outcome,
    insert_chunks,
    orphan_audit,
    purge_noisy,
    register_sources,
    table_counts,
    update_sources,
    upsert_docs,
)

LINKS = "- [One](https://a/1)\n- [Two](https://a/2)\n- [Three](https://a/3)"


def test_diff_docs(spark):
    incoming = spark.createDataFrame([("s", "a", "x"), ("s", "b", "y"), ("s", "c", "z"), ("t", "a", "x")], "source_id STRING, url STRING, content_md STRING")
    stored = incoming.limit(0).unionByName(spark.createDataFrame([("s", "a", "x"), ("s", "b", "old")], incoming.schema))
    stored = stored.withColumn("content_hash", F.md5("content_md"))
    found = {(r.source_id, r.url): r.change for r in diff_docs(incoming, stored).collect()}
    assert found == {("s", "a"): "unchanged", ("s", "b"): "changed", ("s", "c"): "new", ("t", "a"): "new"}


def test_dedup_counts(spark):
    df = spark.createDataFrame([("s", "A b"), ("s", "a  B"), ("s", "c"), ("t", "a b")], "source_id STRING, content STRING")
    assert {tuple(r) for r in dedup_counts(df).collect()} == {("s", 3, 2, 1), ("t", 1, 1, 0)}


def test_upsert_docs(spark):
    stored = spark.createDataFrame(
        [("s", "a", "A", "old", "h"), ("s", "b", "B", "keep", "hb")], "source_id STRING, url STRING, title STRING, content_md STRING, content_hash STRING")
    incoming = spark.createDataFrame(
        [("s", "a", "A1", "new", 1), ("s", "a", "A2", None, 2), ("s", "c", None, None, 1)], "source_id STRING, url STRING, title STRING, content_md STRING, seq INT")
    found = {r.url: r for r in upsert_docs(stored, incoming).collect()}
    assert (found["a"].title, found["a"].content_md) == ("A2", "new") and found["a"].content_hash != "h"
    assert (found["b"].title, found["b"].content_md, found["b"].content_hash) == ("B", "keep", "hb")
    assert found["c"].title is None and found["c"].content_hash is None and len({r.id for r in found.values()}) == 3


def test_insert_chunks_is_idempotent(spark):
    rows = [("s", "u", "Doc", 0, "one two"), ("s", "u", "Doc", 1, "three")]
    batch = spark.createDataFrame(rows, "source_id STRING, doc_url STRING, doc_title STRING, chunk_index INT, content STRING")
    batch = batch.withColumn("heading", F.lit(None).cast("string")).withColumn("heading_path", F.array().cast("array<string>"))
    empty = spark.createDataFrame([], "id STRING, doc_id STRING, source_id STRING, content STRING, chunk_index INT, token_count INT")
    once = insert_chunks(empty, batch)
    twice = insert_chunks(once, batch)
    assert once.count() == twice.count() == 2
    assert {r.token_count for r in twice.collect()} == {2, 1}
    assert [tuple(r) for r in import_outcome(batch).collect()] == [("s", 1, 2)]
    assert import_outcome(batch.limit(0)).count() == 0


def test_writes_keep_what_they_do_not_touch(spark):
    then, now = F.lit(1).alias("t"), F.lit(2)
    stored = spark.createDataFrame([("s", "a", "A", "x", "h", 1, 1, 7), ("s", "b", "B", "y", "h", 1, 1, 8)],
        "source_id STRING, url STRING, title STRING, content_md STRING, content_hash STRING, created_at INT, updated_at INT, indexed_at INT")
    incoming = spark.createDataFrame([("s", "a", "A1", None, 1), ("s", "c", "C", "z", 1)], "source_id STRING, url STRING, title STRING, content_md STRING, seq INT")
    found = {r.url: (r.title, r.created_at, r.updated_at, r.indexed_at) for r in upsert_docs(stored, incoming, now).collect()}
    assert found == {"a": ("A1", 1, 2, 7), "b": ("B", 1, 1, 8), "c": ("C", 2, 2, None)}

    schema = "source_id STRING, doc_url STRING, chunk_index INT, content STRING, seq INT"
    empty = spark.createDataFrame([], "id STRING, doc_id STRING, source_id STRING, content STRING, chunk_index INT, token_count INT, created_at INT")
    long = [("s", "u", i, f"text {i}", 1) for i in range(3)] + [("s", "v", 0, "other", 1)]
    first = insert_chunks(empty, spark.createDataFrame(long, schema), then)
    again = [("s", "u", 0, "zz older", 1), ("s", "u", 0, "aa newer", 2)]
    rows = insert_chunks(first, spark.createDataFrame(again, schema), now).collect()
    assert sorted((r.content, r.created_at) for r in rows) == [("aa newer", 2), ("other", 1)]


def test_purge(spark):
    chunks = spark.createDataFrame([("1", "s", LINKS), ("2", "s", "clean prose"), ("3", "t", LINKS)], "id STRING, source_id STRING, content STRING")
    index = {"chunks": chunks, "embeddings": chunks.select(F.col("id").alias("chunk_id"))}
    left, purged = purge_noisy(index)
    assert {tuple(r) for r in purged.collect()} == {("s", 1), ("t", 1)}
    assert [r.chunk_id for r in left["embeddings"].collect()] == ["2"] and left["chunks"].count() == 1
    assert purge_noisy(left)[1].count() == 0
    assert purge_noisy(index, "t")[0]["chunks"].count() == 2


def small_index(spark):
    def table(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "sources": table([("s",), ("t",)], "id STRING"),
        "docs": table([("d", "s"), ("e", "t")], "id STRING, source_id STRING"),
        "chunks": table([("c", "d", "s"), ("c2", "e", "t"), ("c3", "e", "t")], "id STRING, doc_id STRING, source_id STRING"),
        "embeddings": table([("c", "m"), ("c2", "m")], "chunk_id STRING, model STRING"),
        "jobs": table([("j", "s"), ("k", "t")], "id STRING, source_id STRING"),
        "job_logs": table([("j", "x"), ("k", "y"), ("k", "z")], "job_id STRING, message STRING"),
    }


def test_cascade_and_audit(spark):
    index = small_index(spark)
    assert {r.n for r in orphan_audit(index).collect()} == {0}
    gone = spark.createDataFrame([("t",)], "id STRING")
    after = cascade_delete(index, gone)
    assert {r.table: r.n for r in table_counts(after).collect()} == dict.fromkeys(index, 1)
    assert {r.n for r in orphan_audit(after).collect()} == {0}
    broken = {**index, "docs": after["docs"]}
    assert {(r.table, r.reference): r.n for r in orphan_audit(broken).collect() if r.n} == {("chunks", "doc_id -> docs"): 2}


def test_register_and_update(spark):
    new = spark.createDataFrame([("n1", "u1", 1), ("n2", "u2", 2), ("n3", "u2", 3)], "name STRING, url STRING, seq INT")
    known = spark.createDataFrame([("u1",)], "url STRING")
    assert {r.name: r.registered for r in register_sources(known, new).collect()} == {"n1": False, "n2": True, "n3": False}
    sources = spark.createDataFrame([("1", "a", True), ("2", "b", True)], "id STRING, name STRING, enabled BOOLEAN")
    sources = sources.withColumn("updated_at", F.lit(None).cast("timestamp"))
    patches = spark.createDataFrame([("1", None, False)], "id STRING, name STRING, enabled BOOLEAN")
    found = {r.id: r for r in update_sources(sources, patches, F.current_timestamp()).collect()}
    assert (found["1"].name, found["1"].enabled, found["2"].enabled) == ("a", False, True)
    assert found["1"].updated_at is not None and found["2"].updated_at is None


def test_embedding_back_fill(spark):
    chunks = spark.createDataFrame([("1", "s", "alpha beta"), ("2", "s", ""), ("3", "s", "skip"), ("4", "s", "gamma")], "id STRING, source_id STRING, content STRING")
    model = Embedder("lengths", 2, lambda texts: [[] if t == "skip" else [float(len(t)), 1.0] for t in texts])
    stored = spark.createDataFrame([("1", "lengths"), ("4", "other")], "chunk_id STRING, model STRING")
    made = embed_pending(chunks, stored, model)
    assert {r.chunk_id: list(r.vector) for r in made.collect()} == {"2": [0.0, 1.0], "4": [5.0, 1.0]}
    rest = pending_chunks(chunks, stored.unionByName(made.select("chunk_id", "model")), "lengths")
    assert [r.id for r in rest.collect()] == ["3"]
    vectors = hashing_embedder(16).embed(["a b a", "b a a", ""])
    assert vectors[0] == vectors[1] and abs(sum(x * x for x in vectors[0]) - 1) < 1e-9 and not any(vectors[2])


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], "[1, 2.5,NaN,x]")], "a ARRAY<FLOAT>, b ARRAY<FLOAT>, z ARRAY<FLOAT>, t STRING")
    row = df.select(
        cosine(F.col("a"), F.col("b")).alias("ab"), cosine(F.col("a"), F.col("z")).alias("az"), normalise(F.col("a")).alias("n"),
        normalise(F.col("z")).alias("nz"), parse_vector(F.col("t")).alias("p"), format_vector(F.col("a")).alias("f"),
    ).first()
    assert abs(row.ab - 0.96) < 1e-9 and row.az == 0.0 and row.n == [0.6, 0.8] and row.nz == [0.0, 0.0]
    assert row.p == [1.0, 2.5] and row.f == "[3.0,4.0]"
    stats = embedding_stats(df.select(F.lit("m").alias("model"), F.lit(3).alias("dimensions"), F.col("a").alias("vector")))
    assert tuple(stats.first()) == ("m", 3, 1, 1)


def test_back_fill_goes_on_after_failures(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    rows = [(f"c{i:03d}", f"text {i}" + (" poison" if i % 10 == 3 else "")) for i in range(250)] + [("null", None), ("hollow", "hollow")]
    chunks = spark.createDataFrame(rows, "id STRING, content STRING")

    def weak(texts):
        if any("poison" in t for t in texts):
            raise RuntimeError("overloaded")
        return [[] if t == "hollow" else [float(len(t)), 1.0] for t in texts]

    assert back_fill(chunks, Embedder("m", 2, weak), path, slices=3) == 1
    left = {r.chunk_id: (r.tries, r.error) for r in unfilled(spark, path).collect()}
    assert left == {**{f"c{i:03d}": (1, "RuntimeError: overloaded") for i in range(3, 250, 10)}, "hollow": (1, "empty vector")}
    sound = Embedder("m", 2, lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert back_fill(chunks, sound, path, slices=1) == 2
    made = filled(spark, path, sound).collect()
    assert len(made) == len({r.chunk_id for r in made}) == 252 and {r.chunk_id for r in made if r.run == 2} == set(left)
    assert unfilled(spark, path).isEmpty()

    # A job that dies between two slices keeps the first.
    other, calls = f"{path}/other", []
    commit = embedding.commit_version

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("driver lost")
        commit(*args)

    with monkeypatch.context() as m:
        m.setattr(embedding, "commit_version", dies)
        with pytest.raises(OSError):
            back_fill(chunks, sound, other, slices=4)
    half = filled(spark, other, sound).count()
    assert 0 < half < 252 and back_fill(chunks, sound, other, slices=4) == 2
    made = filled(spark, other, sound).collect()
    assert len(made) == len({r.chunk_id for r in made}) == 252 and sum(r.run == 1 for r in made) == half
