from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import jobs as j, stats as s
from corpusloom.operators.embedding import hashing_embedder
from corpusloom.plans.job_plans import stream_ingest, stream_job_log, stream_job_state
from corpusloom.schema import CHUNKS, DOCS, EMBEDDINGS, JOBS, SOURCES
from corpusloom.streaming.feeds import job_state, read_job_logs, read_job_state, write_job_logs, write_job_state
from corpusloom.sources.versions import read_version
from corpusloom.streaming import ingest as ingesting
from corpusloom.streaming.ingest import current_index, run_ingest

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [
        ("1", "s", "done", 0, 3, 1000, '{"chunksDropped":[{"reason":"link_list","count":2},{"reason":"fetch_error","count":1}]}', T0),
        ("2", "s", "failed", 1, 3, 3001, "{broken", T0 + timedelta(hours=1)),
        ("3", "t", "running", 0, 3, None, None, T0 + timedelta(hours=2)),
        ("4", "t", "failed", 3, 3, 500, '{"chunksDropped":[{"reason":"link_list","count":5}]}', T0 + timedelta(hours=3)),
        ("5", "t", "failed", 4, 9, None, "{}", T0 + timedelta(hours=4)),
    ]
    df = spark.createDataFrame(rows, "id STRING, source_id STRING, status STRING, retry_count INT, max_retries INT, duration_ms INT, result STRING, created_at TIMESTAMP")
    return df.withColumn("started_at", F.col("created_at"))


def test_job_figures(spark, jobs):
    assert [r.id for r in j.recent_jobs(jobs, 2).collect()] == ["5", "4"]
    assert tuple(j.job_summary(jobs).first()) == (0, 1, 3, True)
    assert j.avg_duration(jobs).first()[0] == 1500 and j.avg_duration(jobs.limit(0)).first()[0] == 0
    assert {tuple(r) for r in j.dropped_by_reason(jobs).collect()} == {("s", "link_list", 2), ("s", "fetch_error", 1), ("t", "link_list", 5)}
    live = {r.id: r.live_ms for r in j.live_duration(jobs, F.lit(T0 + timedelta(hours=3))).collect()}
    assert live["3"] == 3_600_000 and live["1"] == 1000 and live["5"] is None
    plan = {r.id: (r.attempt, r.exhausted, r.backoff_ms) for r in j.retry_plan(jobs).collect()}
    assert plan == {"2": (2, False, 20_000), "4": (4, True, None), "5": (5, False, 120_000)}
    asked = spark.createDataFrame([("s",), ("t",)], "source_id STRING")
    assert {r.source_id: r.refused for r in j.overlap_guard(asked, jobs).collect()} == {"s": False, "t": True}


def test_log_tail(spark):
    rows = [("a", f"{i:02d}", T0 + timedelta(minutes=i)) for i in range(9)] + [("b", "x", T0)]
    logs = spark.createDataFrame(rows, "job_id STRING, id STRING, created_at TIMESTAMP")
    assert [(r.job_id, r.id) for r in j.log_tail(logs, 3).collect()] == [("a", "06"), ("a", "07"), ("a", "08"), ("b", "x")]


def test_stats_of_an_empty_index(spark):
    tables = {"sources": SOURCES, "docs": DOCS, "chunks": CHUNKS, "embeddings": EMBEDDINGS, "jobs": JOBS}
    empty = {name: spark.createDataFrame([], schema) for name, schema in tables.items()}
    assert set(s.platform_stats(empty).first()) == {0}
    one = {**empty, "sources": spark.createDataFrame([("s", "Docs")], "id STRING, name STRING")}
    assert tuple(s.source_stats(one).first()) == ("s", "Docs", 0, 0, None, None, None)


EVENTS = "job_id STRING, event_id BIGINT, ts TIMESTAMP, source_id STRING, status STRING, duration_ms BIGINT, result STRING"


def test_job_state_stream_equals_batch(spark, tmp_path):
    rows = [
        ("a", 1, T0, "s", "pending", None, None),
        ("a", 2, T0 + timedelta(seconds=1), None, "running", None, None),
        ("b", 3, T0, "t", "pending", None, None),
        ("a", 4, T0 + timedelta(seconds=9), None, "done", 8000, "{}"),
        ("b", 5, T0, None, "running", None, None),  # same time, later event
    ]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")
        write_job_state(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    state = read_job_state(spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out"))
    batch = job_state(spark.createDataFrame(rows, EVENTS))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, batch.collect()))
    assert {r.job_id: (r.source_id, r.status, r.duration_ms) for r in state.collect()} == {"a": ("s", "done", 8000), "b": ("t", "running", None)}


def test_job_log_stream(spark, tmp_path):
    rows = [("1", "a", "x"), ("1", "a", "x"), ("2", "a", "y"), ("3", "b", "z")]
    for _ in range(2):
        spark.createDataFrame(rows, "id STRING, job_id STRING, message STRING").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id STRING, job_id STRING, message STRING").parquet(f"{tmp_path}/in")
        write_job_logs(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "a").awaitTermination()
    stored = spark.read.option("basePath", f"{tmp_path}/out").parquet(f"{tmp_path}/out")
    assert sorted(r.id for r in read_job_logs(stored).collect()) == ["1", "2"]


def test_ingest_skips_unchanged_and_replaces_changed(spark, tmp_path):
    prose = "A paragraph with enough words to be kept as a passage of its own by the chunker, number {}."

    def page(url, n):
        return ("s", url, f"<main><h1>T</h1><p>{prose.format(n)}</p></main>")

    schema = "source_id STRING, url STRING, html STRING"
    model = hashing_embedder(8)
    for pages in ([page("https://a/1", 1), page("https://a/2", 2)], [page("https://a/1", 1), page("https://a/2", 9), page("https://a/3", 3)]):
        spark.createDataFrame(pages, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        run_ingest(stream, f"{tmp_path}/index", f"{tmp_path}/cp", model).awaitTermination()
    index = current_index(spark, f"{tmp_path}/index")
    texts = {r.doc_url: r.content for r in index["chunks"].collect()}
    assert {u: t[-2] for u, t in texts.items()} == {"https://a/1": "1", "https://a/2": "9", "https://a/3": "3"}
    assert index["docs"].count() == 3
    assert {r.chunk_id for r in index["embeddings"].collect()} == {r.id for r in index["chunks"].collect()}
    batches = spark.read.option("basePath", f"{tmp_path}/index/docs").parquet(f"{tmp_path}/index/docs").groupBy("batch").count()
    assert {r.batch: r["count"] for r in batches.collect()} == {0: 2, 1: 2}


def test_ingest_loses_no_passage_across_batches(spark, tmp_path):
    """Two pages share a passage; the first copy changes later. Three batches equal one."""
    prose = "A paragraph with enough words to be kept as a passage of its own by the chunker, number {}."

    def page(url, n, seq):
        return ("s", url, f"<main><h1>T</h1><p>{prose.format(n)}</p></main>", seq)

    schema = "source_id STRING, url STRING, html STRING, seq INT"
    batches = [[page("https://a/1", 1, 1)], [page("https://a/2", 1, 2)], [page("https://a/1", 7, 3)]]

    def ingest(name, parts):
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/in")
            run_ingest(stream, f"{tmp_path}/{name}/index", f"{tmp_path}/{name}/cp", hashing_embedder(8)).awaitTermination()
        chunks = current_index(spark, f"{tmp_path}/{name}/index")["chunks"]
        return sorted((r.doc_url, r.content[-2]) for r in chunks.collect())

    assert ingest("three", batches) == ingest("one", [sum(batches, [])]) == [("https://a/1", "7"), ("https://a/2", "1")]


def test_folded_history_equals_one_batch(spark, tmp_path, monkeypatch):
    """Bases replace old batch folders; a repeated batch changes nothing."""
    monkeypatch.setattr(ingesting, "FOLD", 2)
    path = str(tmp_path / "index")
    page = lambda i, words: ("s", f"https://a/{i}", f"<html><body><h1>T{i}</h1><p>{words * 12}</p></body></html>")
    batches = [[page(i, f"first {i} "), page(9, f"shared text {n} ")] for n, i in enumerate((1, 2, 3, 1, 4))]
    batches.append([page(1, "another body "), page(9, "shared text 4 ")])
    frames = [spark.createDataFrame(rows, "source_id STRING, url STRING, html STRING") for rows in batches]
    for n, frame in enumerate(frames):
        ingesting.ingest_batch(frame, path, hashing_embedder(8), n)
    read = lambda where: {name: sorted(map(str, df.drop("batch").collect())) for name, df in current_index(spark, where).items()}
    found = read(path)
    last = {row[1]: row for rows in batches for row in rows}
    whole = spark.createDataFrame(list(last.values()), "source_id STRING, url STRING, html STRING")
    ingesting.ingest_batch(whole, f"{path}-one", hashing_embedder(8), 0)
    assert found == read(f"{path}-one") and len(found["docs"]) == 5
    number, entries = read_version(spark, path)
    assert sum(e.name == "batch" for e in entries) <= 2 and sum(e.name == "base" for e in entries) == 1
    ingesting.ingest_batch(frames[-1], path, hashing_embedder(8), len(frames) - 1)
    assert read(path) == found and read_version(spark, path)[0] > number
    kept = {p.name for p in (tmp_path / "index" / "docs").iterdir()}
    assert not {"batch=0", "batch=1"} & kept and len(kept) <= 6


@pytest.mark.parametrize(("name", "query"), [("conversations", stream_job_log), ("events", stream_job_state), ("pages", stream_ingest)])
def test_streamed_tables_may_be_folders(spark, tmp_path, name, query):
    file = "/root/testdata/sf0.001"
    spark.read.parquet(f"{file}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    from_folder, from_file = (sorted(map(str, query(spark, d).collect())) for d in (str(tmp_path), file))
    assert from_folder == from_file and from_file
