"""The stored text index against the plain one, over imports, deletions and merges."""

import random
import re
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import text_store
from corpusloom.operators.text_search import exact_score, search_text, text_index, text_match
from corpusloom.operators.text_store import import_chunks, merge_segments, open_text_store
from corpusloom.sources.versions import Entry, commit_version, read_version

CHUNKS = "chunk_id STRING, doc_id STRING, source_name STRING, content STRING"
WORDS = [f"w{i}" for i in range(40)]


def corpus(seed, n=300, first=0):
    """Chunks of very different lengths over few words, some rare."""
    rng = random.Random(seed)
    weights = [1 / (1 + i) for i in range(len(WORDS))]
    rows = []
    for i in range(first, first + n):
        words = rng.choices(WORDS, weights, k=rng.choice((0, 1, 3, 9, 30, 200)))
        rows.append((f"c{i:04d}", f"d{i // 3}", f"s{i % 4}", " ".join(words)))
    return rows


def queries(spark, seed=1, n=25):
    rng = random.Random(seed)
    rows = [(f"q{i}", " ".join(rng.sample(WORDS, rng.choice((1, 2, 3))))) for i in range(n)]
    return spark.createDataFrame([*rows, ("none", "the"), ("unknown", "w1 nowhere")], "query_id STRING, text STRING")


def same(spark, store, rows, k=7, source=None):
    """The store answers like the plain index of `rows`."""
    plain = text_index(spark.createDataFrame(rows, CHUNKS))
    asked = queries(spark)
    found = sorted(map(tuple, search_text(store, asked, k, source).collect()))
    assert found == sorted(map(tuple, search_text(plain, asked, k, source).collect())) and found
    assert sorted(map(tuple, text_match(store, asked).collect())) == sorted(map(tuple, text_match(plain, asked).collect()))


@pytest.fixture
def small(monkeypatch):
    """Many buckets, and a search that reads one before it judges the others."""
    monkeypatch.setattr(text_store, "BUCKET_CHUNKS", 8)
    monkeypatch.setattr(text_store, "FIRST_CELLS", 1)


@pytest.mark.parametrize("source", [None, "s2"])
def test_early_stop_equals_full_search(spark, tmp_path, small, source):
    rows = corpus(3)
    store = import_chunks(spark, str(tmp_path), spark.createDataFrame(rows, CHUNKS))
    assert store.chunks == 300
    same(spark, store, rows, source=source)


def test_many_terms_are_joined(spark, tmp_path, small, monkeypatch):
    monkeypatch.setattr(text_store, "PUSHED_TERMS", 3)
    rows = corpus(4, 120)
    same(spark, import_chunks(spark, str(tmp_path), spark.createDataFrame(rows, CHUNKS)), rows)


def test_search_lists_only_the_parts_of_its_terms(spark, tmp_path):
    store = import_chunks(spark, str(tmp_path), spark.createDataFrame(corpus(5), CHUNKS))
    asked = spark.createDataFrame([("w3",), ("w17",)], "term STRING")
    parts = {r.p for r in asked.select(F.pmod(F.xxhash64("term"), F.lit(store.segments[0].parts)).alias("p")).collect()}
    blocks = store.blocks(asked)
    plan = blocks._jdf.queryExecution().toString()
    listed = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan.split("Physical Plan")[-1])
    assert {int(v) for v in re.findall(r"(?:IN \(|= |,)(\d+)", listed[1])} == parts
    assert "In(term, [" in listed[2] and "w17" in listed[2] and "w3" in listed[2]
    assert len(parts) < store.segments[0].parts


def test_bounds_spare_buckets(spark, tmp_path, small):
    """A word that is dense in short chunks: the long chunks are not read."""
    rows = [(f"a{i}", f"a{i}", "s", "rare " * 5) for i in range(20)] + [(f"b{i}", f"b{i}", "s", "rare " + "filler " * 400) for i in range(200)]
    store = import_chunks(spark, str(tmp_path), spark.createDataFrame(rows, CHUNKS))
    asked = spark.createDataFrame([("q", "rare")], "query_id STRING, text STRING")
    terms = asked.select("query_id", F.col("text").alias("term"))
    cells = store._cells(terms).select("bound", "segment", "bucket").collect()
    least = search_text(store, asked, 5).agg(F.min("score")).first()[0]
    assert sum(c.bound >= least for c in cells) <= 3 < len(cells) / 5
    same_scores = {round(r.score, 9) for r in search_text(store, asked, 5).collect()}
    plain = text_index(spark.createDataFrame(rows, CHUNKS))
    assert same_scores == {round(r.score, 9) for r in search_text(plain, asked, 5).collect()}


def test_imports_and_deletes_equal_a_rebuild(spark, tmp_path, small):
    root = str(tmp_path)
    first, second = corpus(6, 150), corpus(7, 60, first=120)  # documents 40 to 49 come again, with other chunks
    second = [r for r in second if r[0] != "c0121"]  # one of them lost a chunk
    import_chunks(spark, root, spark.createDataFrame(first, CHUNKS))
    import_chunks(spark, root, spark.createDataFrame(second, CHUNKS))
    gone = spark.createDataFrame([("d3",), ("d41",), ("d55",), ("nobody",)], "doc_id STRING")
    third = [("x1", "d9", "s1", "w1 w2 w3"), ("x2", "new", "s1", "w1 w4")]
    store = import_chunks(spark, root, spark.createDataFrame(third, CHUNKS), gone)
    again = {r[1] for r in second}
    live = [r for r in first if r[1] not in again] + second
    live = [r for r in live if r[1] not in {"d3", "d41", "d55", "d9"}] + third
    assert store.chunks == len(live) and len(store.segments) == 3 and store.deletions
    assert {r.chunk_id for r in store.forward().collect()} == {r[0] for r in live}
    same(spark, store, live)
    merged = merge_segments(spark, root)
    assert len(merged.segments) == 1 and not merged.deletions and merged.chunks == len(live)
    same(spark, merged, live)
    assert open_text_store(spark, root, store.version).segments == store.segments  # the older version is still there
    emptied = import_chunks(spark, root, spark.createDataFrame([], CHUNKS), spark.createDataFrame([(r[1],) for r in live], "doc_id STRING"))
    assert emptied.chunks == 0 and not search_text(emptied, queries(spark), 3).collect()
    assert not merge_segments(spark, root).segments


def test_an_import_reads_no_text(spark, tmp_path):
    root = str(tmp_path)
    store = import_chunks(spark, root, spark.createDataFrame(corpus(8, 30), CHUNKS))
    assert "content" not in store.forward().columns


def test_postings_hold_numbers_that_names_resolve(spark, tmp_path):
    """Ids are stored once a chunk and not with every posting."""
    rows = corpus(11, 80)
    store = import_chunks(spark, str(tmp_path), spark.createDataFrame(rows, CHUNKS))
    folder = f"{tmp_path}/{store.segments[0].path}"
    names = spark.read.parquet(f"{folder}/names")
    assert sorted((r.chunk_id, r.source_name) for r in names.collect()) == sorted((r[0], r[2]) for r in rows)
    assert names.select("bucket", "no").distinct().count() == len(rows)
    kinds = dict(spark.read.parquet(f"{folder}/blocks").drop("term").dtypes)
    assert not [name for name, kind in kinds.items() if "string" in kind]


def test_copies_tie_exactly(spark, tmp_path):
    """Equal chunks of many terms have equal scores, so their ranks follow their ids."""
    rng = random.Random(5)
    texts = [" ".join(f"t{rng.randrange(3000)}" for _ in range(150)) for _ in range(60)]
    rows = [(f"c{rng.randrange(10**9)}", f"d{i}{j}", "s", text) for i, text in enumerate(texts) for j in range(8)]
    given = spark.createDataFrame(rows, CHUNKS)
    asked = spark.createDataFrame([(f"q{i}", text) for i, text in enumerate(texts)], "query_id STRING, text STRING")
    for index in (import_chunks(spark, str(tmp_path), given), text_index(given)):
        found = search_text(index, asked, 10).orderBy("query_id", "rank").collect()
        assert len(found) == len(rows) and len({(r.query_id, r.score) for r in found}) == len(texts)
        assert [(r.query_id, r.chunk_id) for r in found] == sorted((r.query_id, r.chunk_id) for r in found)


def test_scores_do_not_depend_on_the_order_of_terms(spark):
    """Sums in two orders that doubles tell apart at 12 digits."""
    rng = random.Random(2)
    drawn = ([rng.uniform(0, 9) for _ in range(90)] for _ in range(1000))
    shares = next(x for x in drawn if round(reduce(add, x), 12) != round(reduce(add, x[::-1]), 12))
    total = lambda values: spark.createDataFrame([(v,) for v in values], "x DOUBLE").coalesce(1).agg(exact_score(F.col("x"))).first()[0]
    assert total(shares) == total(shares[::-1]) == pytest.approx(sum(shares), abs=1e-11)


def test_failed_import_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    rows = corpus(9, 60)
    before = import_chunks(spark, root, spark.createDataFrame(rows, CHUNKS))

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(text_store, "commit_version", fail)
        with pytest.raises(OSError):
            import_chunks(spark, root, spark.createDataFrame(corpus(10, 30), CHUNKS))
    assert open_text_store(spark, root) == before
    same(spark, open_text_store(spark, root), rows)


def test_stems_are_a_property_of_the_store(spark, tmp_path):
    rows = [("c", "d", "s", "Installing configured packages")]
    store = import_chunks(spark, str(tmp_path), spark.createDataFrame(rows, CHUNKS), stem=True)
    asked = spark.createDataFrame([("q", "install package")], "query_id STRING, text STRING")
    assert [r.query_id for r in text_match(store, asked).collect()] == ["q"]
    assert open_text_store(spark, str(tmp_path)).stem
    with pytest.raises(ValueError):
        import_chunks(spark, str(tmp_path), spark.createDataFrame(rows, CHUNKS), stem=False)


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    assert read_version(spark, f"{root}/missing") == (0, [])
    commit_version(spark, root, 1, [Entry("a", "x", {"n": 1}), Entry("b", "y", {})])
    commit_version(spark, root, 2, [])
    assert read_version(spark, root) == (2, [])
    assert read_version(spark, root, 1) == (1, [Entry("a", "x", {"n": 1}), Entry("b", "y", {})])


def test_only_hits_that_can_count_leave_a_bucket(spark, tmp_path, monkeypatch):
    """Two words that all chunks hold: a bucket sends its k best and no posting, copies included."""
    monkeypatch.setattr(text_store, "BUCKET_CHUNKS", 64)
    rows = [(f"c{i:03d}", f"d{i}", "s", "left right " + "left " * (i % 3)) for i in range(200)]
    store = import_chunks(spark, str(tmp_path), spark.createDataFrame(rows, CHUNKS))
    asked = spark.createDataFrame([("q", "left"), ("q", "right")], "query_id STRING, term STRING")
    cells = store._cells(asked)
    assert store._hits(asked, cells).count() == 200
    assert store._hits(asked, cells, 3).groupBy("segment", "bucket").count().agg(F.max("count")).first()[0] == 3
    assert store._hits(asked, cells.withColumn("least", F.lit(1e9)), 3).count() == 0
