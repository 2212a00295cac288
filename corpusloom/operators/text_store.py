"""A stored full-text index that is read in part, stops early, and grows by segments.

A segment holds the postings of one import. Its chunks are dealt into buckets: chunks of similar
length share a bucket, of about `BUCKET_CHUNKS` chunks, and every term has one block of postings for
each bucket it occurs in. The narrow columns of the blocks (term, bucket, size, greatest count of
the term, least length of a chunk) are the term dictionary: they bound every score in the block. Blocks lie in
parts by hash of the term, ordered by term, so a search lists the parts of its terms and pushes the
terms to the scan. Chunks are numbered within their bucket: postings are numbers, and only the matches are
looked up in the names of the buckets. Blocks are built where a bucket's chunks lie, so no posting is shuffled alone.

A query needs all of its terms, so a bucket counts only if all of them have a block there. A top-k
search reads the buckets with the best bounds first; the k-th score found is then the least that
another bucket must be able to reach, and only such buckets are read. Results are those of the full
index, scores included. The blocks of a bucket meet the queries that read it in one task, which
intersects their numbers: blocks move as they are stored, and of a top-k search only the hits that can count leave it.

An import writes a segment of its own and reads no old text. Documents that come again, or are
gone, leave by tombstones: their chunks up to that segment no longer count, and their terms are taken off the
frequencies. `merge_segments` writes one segment without tombstones.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log2
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.arrays import array_rows
from ..settings import materialise
from ..sources.versions import Entry, commit_version, fresh_folder, read_version
from .text_search import K1, B, exact_total, query_terms, search_terms, top_k

BUCKET_CHUNKS = 4096
PART_TOKENS = 1 << 18  # tokens of a segment for each part
MAX_PARTS = 1 << 12
PUSHED_TERMS = 1000  # asked terms that are pushed to the scan by name; more are joined
FIRST_CELLS = 8  # buckets a query reads before it knows the score to beat
ROW_GROUP = 8 << 20  # bytes
_SLACK = 1e-9  # bounds and scores are sums in different order


class Segment(NamedTuple):
    number: int
    path: str
    parts: int
    chunks: int
    tokens: int


class Deletion(NamedTuple):
    """Chunks that left all segments up to a number."""

    upto: int
    path: str
    chunks: int
    tokens: int


class TextStore(NamedTuple):
    """One version of a stored index."""

    spark: SparkSession
    root: str
    version: int
    segments: list[Segment]
    deletions: list[Deletion]
    stem: bool

    @property
    def chunks(self) -> int:
        return sum(s.chunks for s in self.segments) - sum(d.chunks for d in self.deletions)

    @property
    def tokens(self) -> int:
        return sum(s.tokens for s in self.segments) - sum(d.tokens for d in self.deletions)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{path}")

    def blocks(self, asked: DataFrame) -> DataFrame:
        """Blocks of asked terms (term): only their parts are listed, few terms are pushed to the scan."""
        distinct = asked.select("term").distinct()
        few = distinct.limit(PUSHED_TERMS + 1).select("term", _hash("term").alias("h")).collect()
        pushed = len(few) <= PUSHED_TERMS
        top = max((s.parts for s in self.segments), default=1)
        if pushed:
            slots = {r.h % top for r in few}
        else:
            slots = {r.h for r in distinct.select(F.pmod(_hash("term"), F.lit(top)).alias("h")).distinct().collect()}
        found = []
        for segment in self.segments:
            stored = self.spark.read.schema(f"{_BLOCKS}, part INT").parquet(f"{self.root}/{segment.path}/blocks").drop("segment")
            rows = stored.filter(F.col("part").isin({h % segment.parts for h in slots}))
            rows = rows.filter(F.col("term").isin([r.term for r in few])) if pushed else rows.join(distinct, "term", "left_semi")
            found.append(rows.select(F.lit(segment.number).alias("segment"), *(c for c in rows.columns if c != "part")))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], _BLOCKS)

    def gone(self) -> DataFrame:
        """(chunk_id, upto) of the tombstones."""
        rows = [self._read(f"{d.path}/gone").select("chunk_id", F.lit(d.upto).alias("upto")) for d in self.deletions]
        return reduce(DataFrame.unionByName, rows) if rows else self.spark.createDataFrame([], "chunk_id STRING, upto INT")

    def names(self, matched: DataFrame) -> DataFrame:
        """Rows (segment, bucket, no, …) with chunk_id and source_name in place of the numbers, tombstones left out."""
        matched = materialise(matched, "matches")
        found = [self._read(f"{s.path}/names").withColumn("segment", F.lit(s.number)) for s in self.segments]
        known = reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], f"{_NAMES}, segment INT")
        return self._alive(matched.join(known, ["segment", "bucket", "no"])).drop("segment", "bucket", "no")

    def forward(self) -> DataFrame:
        """(segment, chunk_id, doc_id, source_name, n_tokens, terms) of the chunks that count."""
        rows = [self._read(f"{s.path}/chunks").withColumn("segment", F.lit(s.number)) for s in self.segments]
        if not rows:
            return self.spark.createDataFrame([], f"{_FORWARD}, segment INT")
        return self._alive(reduce(DataFrame.unionByName, rows))

    def _alive(self, rows: DataFrame) -> DataFrame:
        if not self.deletions:
            return rows
        gone = self.gone().groupBy("chunk_id").agg(F.max("upto").alias("upto"))
        return rows.join(gone, "chunk_id", "left").filter(F.col("upto").isNull() | (F.col("segment") > F.col("upto"))).drop("upto")

    def frequency(self, blocks: DataFrame) -> DataFrame:
        """(term, df) of the terms of the blocks."""
        held = blocks.select("term", F.col("n").cast("long").alias("n"))
        if self.deletions:
            minus = reduce(DataFrame.unionByName, [self._read(f"{d.path}/minus") for d in self.deletions])
            held = held.unionByName(minus.join(blocks.select("term").distinct(), "term", "left_semi").select("term", (-F.col("n")).alias("n")))
        return held.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    # --- searches ---------------------------------------------------------------------

    def _cells(self, asked: DataFrame) -> DataFrame:
        """(query_id, segment, bucket, bound, terms) of the buckets that have all terms of a query; `terms` are (term, idf)."""
        narrow = ["segment", "term", "bucket", "n", "max_tf", "min_tokens"]
        blocks = materialise(self.blocks(asked).select(narrow), "dictionary")
        n = F.lit(float(self.chunks))
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = self.frequency(blocks).select("term", idf.alias("idf"))
        whole = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
        met = asked.join(whole, "query_id").join(known, "term").join(blocks, "term")
        bound = F.col("idf") * self.weight(F.col("max_tf"), F.col("min_tokens"))
        cells = met.groupBy("query_id", "n_terms", "segment", "bucket").agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum(bound).alias("bound"),
            F.collect_list(F.struct("term", "idf")).alias("terms"),
        )
        return cells.filter("_n = n_terms").drop("_n", "n_terms")

    @property
    def _mean(self) -> float:
        return float((self.tokens / self.chunks if self.chunks else 1.0) or 1.0)

    def weight(self, tf: Column, size: Column) -> Column:
        """The part of BM25 that depends on the chunk."""
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / F.lit(self._mean)))

    def _hits(self, asked: DataFrame, cells: DataFrame, k: int | None = None, scored: bool = True) -> DataFrame:
        """(query_id, segment, bucket, no, shares) of the chunks in cells that have all terms; `shares` are the terms' parts of
        the score, null if nothing is to be scored.

        With `k`, those that can be among the k best of their cell and reach the `least` of the cell. A group is one bucket:
        the blocks of asked terms in about `BUCKET_CHUNKS` chunks.
        """
        key = ["segment", "bucket"]
        blocks = self.blocks(asked).join(cells.select(*key).distinct(), key, "left_semi").select(*key, "term", "nos", "tfs", "sizes")
        needed = cells.select("query_id", *key, "terms", (F.col("least") if "least" in cells.columns else F.lit(None).cast("double")).alias("least"))
        return blocks.groupBy(*key).cogroup(needed.groupBy(*key)).applyInPandas(_intersect(self._mean, k, scored), _MATCHED)

    def match(self, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id) where the chunk contains every term of the query."""
        asked = query_terms(queries, self.stem)
        hits = self._hits(asked, materialise(self._cells(asked), "cells"), scored=False)
        return self.names(hits.drop("shares")).select("query_id", "chunk_id")

    def _scored(self, asked: DataFrame, cells: DataFrame, k: int, source: str | None) -> DataFrame:
        whole = source is None and not self.deletions  # otherwise hits may still drop out
        found = self.names(self._hits(asked, cells, k if whole else None).withColumn("score", exact_total(F.col("shares"))).drop("shares"))
        if source is not None:
            found = found.filter(F.col("source_name") == source)
        return found.select("query_id", "chunk_id", "score")

    def search(self, queries: DataFrame, k: int, source: str | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank): matching chunks by BM25, at most k per query."""
        asked = query_terms(queries, self.stem)
        order = W.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "bucket")
        cells = materialise(self._cells(asked).withColumn("place", F.row_number().over(order)), "cells")
        best = materialise(top_k(self._scored(asked, cells.filter(F.col("place") <= FIRST_CELLS), k, source), k), "best")
        beat = best.filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        rest = cells.filter(F.col("place") > FIRST_CELLS).join(beat, "query_id", "left")
        rest = materialise(rest.filter(F.col("least").isNull() | (F.col("bound") >= F.col("least") - _SLACK)), "cells")
        if rest.isEmpty():
            return best.select("query_id", "chunk_id", "score", "rank")
        return top_k(best.drop("rank").unionByName(self._scored(asked, rest, k, source)), k)


_FORWARD = "chunk_id STRING, doc_id STRING, source_name STRING, n_tokens INT, terms ARRAY<STRING>"
_BLOCKS = (
    "segment INT, term STRING, bucket INT, n INT, max_tf LONG, min_tokens INT, nos ARRAY<INT>, tfs ARRAY<LONG>, sizes ARRAY<INT>"
)
_NAMES = "bucket INT, no INT, chunk_id STRING, source_name STRING"
_MATCHED = "query_id STRING, segment INT, bucket INT, no INT, shares ARRAY<DOUBLE>"


def _intersect(mean: float, k: int | None, scored: bool):
    """Matches of the queries in a bucket by its blocks (see `TextStore._hits`)."""

    def run(key: tuple, blocks: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        place = {term: i for i, term in enumerate(blocks["term"])}
        nos, tfs, sizes = (blocks[c].to_list() for c in ("nos", "tfs", "sizes"))
        found: list[tuple[str, np.ndarray, list]] = []
        for query, terms, least in zip(cells["query_id"], cells["terms"], cells["least"]):
            held = [place[t["term"]] for t in terms]
            order = sorted(held, key=lambda i: len(nos[i]))
            hits = nos[order[0]]
            for i in order[1:]:
                hits = hits[nos[i][np.minimum(np.searchsorted(nos[i], hits), len(nos[i]) - 1)] == hits]
                if not len(hits):
                    break
            if not len(hits):
                continue
            if not scored:
                found.append((query, hits, [None] * len(hits)))
                continue
            at = [np.searchsorted(nos[i], hits) for i in held]
            size = sizes[held[0]][at[0]].astype("float64")
            tf = np.array([tfs[i][a] for i, a in zip(held, at)], dtype="float64")
            idf = np.array([t["idf"] for t in terms])[:, None]
            shares = idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean)))
            if k is not None:
                best = _contenders(shares.sum(axis=0), k, least)
                hits, shares = hits[best], shares[:, best]
            found.append((query, hits, list(shares.T)))
        return pd.DataFrame(
            {
                "query_id": np.repeat(np.array([q for q, _, _ in found], dtype=object), [len(h) for _, h, _ in found]),
                "segment": np.int32(key[0]), "bucket": np.int32(key[1]),
                "no": np.concatenate([np.zeros(0, np.int32), *(h for _, h, _ in found)]),
                "shares": pd.Series([x for _, _, rows in found for x in rows], dtype=object),
            }
        )

    return run


def _contenders(scores: np.ndarray, k: int, least: float) -> np.ndarray:
    """Places of the scores that may be among the k best and reach `least`, whatever the last digits of their exact sums
    are; of equal scores, the first k."""
    order = np.argsort(-scores, kind="stable")
    beat = scores[order[min(k, len(order)) - 1]] if len(order) >= k else -np.inf
    order = order[scores[order] >= (beat if np.isnan(least) else max(beat, least)) - _SLACK]
    ranked = scores[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)])
    return order[np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(ranked)))) < k]


def _hash(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(MAX_PARTS))


def _band(size: Column) -> Column:
    """Lengths in eighths of a power of two."""
    return F.floor(F.log2(size + 1.0) * 8).cast("int")


def open_text_store(spark: SparkSession, root: str, version: int | None = None) -> TextStore:
    """The newest version of the index below `root` (empty if there is none), or an older one."""
    number, entries = read_version(spark, root, version)
    by = lambda name, kind: sorted(kind(**e.info, path=e.path) for e in entries if e.name == name)
    stem = any(e.name == "settings" and e.info["stem"] for e in entries)
    return TextStore(spark, root, number, by("segment", Segment), by("deletion", Deletion), stem)


def _commit(store: TextStore) -> TextStore:
    entries = [Entry("settings", "", {"stem": store.stem})]
    for name, part in (("segment", store.segments), ("deletion", store.deletions)):
        entries += [Entry(name, p.path, {k: v for k, v in p._asdict().items() if k != "path"}) for p in part]
    commit_version(store.spark, store.root, store.version + 1, entries)
    return store._replace(version=store.version + 1)


def _write_segment(store: TextStore, rows: DataFrame, number: int) -> Segment:
    """Store forward rows, the names of their buckets and their blocks.

    Chunks move once, to the task of their bucket, where they are numbered and their terms counted and gathered.
    """
    path = fresh_folder("segment")
    folder = f"{store.root}/{path}"
    rows.write.parquet(f"{folder}/chunks")
    stored = store.spark.read.parquet(f"{folder}/chunks")
    bands = stored.groupBy(_band(F.col("n_tokens")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens")).collect()
    chunks, tokens = sum(r.n for r in bands), sum(r.tokens for r in bands)
    parts = min(MAX_PARTS, 1 << max(4, ceil(log2(max(1, tokens) / PART_TOKENS))))
    first, starts, counts = 0, [], []
    for r in sorted(bands, key=lambda r: r.band):
        starts += [F.lit(r.band), F.lit(first)]
        counts += [F.lit(r.band), F.lit(ceil(r.n / BUCKET_CHUNKS))]
        first += ceil(r.n / BUCKET_CHUNKS)
    if not bands:
        return Segment(number, path, parts, 0, 0)
    band = _band(F.col("n_tokens"))
    bucket = F.create_map(*starts)[band] + F.pmod(F.xxhash64("chunk_id"), F.create_map(*counts)[band]).cast("int")
    dealt = stored.select(bucket.alias("bucket"), "chunk_id", "source_name", "n_tokens", "terms").repartition(first, "bucket")
    order = W.partitionBy("bucket").orderBy("chunk_id", "source_name", "n_tokens")
    numbered = dealt.withColumn("no", F.dense_rank().over(order))
    numbered.select("bucket", "no", "chunk_id", "source_name").distinct().write.parquet(f"{folder}/names")
    words = array_rows(numbered, ["bucket", "no", "n_tokens"], F.col("terms"), "term")
    counted = words.groupBy("bucket", "term", "no", "n_tokens").agg(F.count(F.lit(1)).alias("tf"))
    blocks = counted.groupBy("bucket", "term").agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("max_tf"), F.min("n_tokens").alias("min_tokens"),
        F.sort_array(F.collect_list(F.struct("no", "tf", "n_tokens"))).alias("p"),
    )
    shaped = blocks.select(
        F.pmod(_hash("term"), F.lit(parts)).cast("int").alias("part"), "term", "bucket", "n", "max_tf", "min_tokens",
        F.col("p.no").alias("nos"), F.col("p.tf").alias("tfs"), F.col("p.n_tokens").alias("sizes"),
    )
    ordered = shaped.hint("rebalance", "part").sortWithinPartitions("part", "term", "bucket")
    ordered.write.option("parquet.block.size", ROW_GROUP).partitionBy("part").parquet(f"{folder}/blocks")
    return Segment(number, path, parts, chunks, tokens)


def import_chunks(
    spark: SparkSession, root: str, chunks: DataFrame, gone: DataFrame | None = None, stem: bool | None = None
) -> TextStore:
    """Add chunks (chunk_id, doc_id, source_name, content) as a new segment and return the new version.

    All former chunks of their documents, and of the documents `gone` (doc_id), leave the index.
    `stem` is fixed by the first import. No old text is read.
    """
    store = open_text_store(spark, root)
    if not store.segments and stem is not None:
        store = store._replace(stem=stem)
    elif stem is not None and stem != store.stem:
        raise ValueError("all segments of an index are stemmed, or none")
    ids = [F.col(c).cast("string").alias(c) for c in ("chunk_id", "doc_id", "source_name")]
    terms = search_terms("content", store.stem)
    rows = chunks.select(*ids, terms.alias("terms")).select("chunk_id", "doc_id", "source_name", F.size("terms").alias("n_tokens"), "terms")
    number = max((s.number for s in store.segments), default=0) + 1
    segment = _write_segment(store, rows, number)
    renewed = spark.read.parquet(f"{root}/{segment.path}/chunks").select("doc_id")
    if gone is not None:
        renewed = renewed.unionByName(gone.select(F.col("doc_id").cast("string").alias("doc_id")))
    deletions = store.deletions
    if store.segments:
        path = fresh_folder("deletion")
        left = store.forward().join(renewed.distinct(), "doc_id", "left_semi")
        left.select("chunk_id", "n_tokens", F.array_distinct("terms").alias("terms")).write.parquet(f"{root}/{path}/gone")
        out = spark.read.parquet(f"{root}/{path}/gone")
        terms_out = array_rows(out, [], F.col("terms"), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        terms_out.write.parquet(f"{root}/{path}/minus")
        total = out.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
        if total.n:
            deletions = [*deletions, Deletion(number - 1, path, total.n, total.tokens)]
    segments = [*store.segments, segment] if segment.chunks else store.segments
    return _commit(store._replace(segments=segments, deletions=deletions))


def merge_segments(spark: SparkSession, root: str) -> TextStore:
    """One segment of all chunks that count, without tombstones; older versions stay readable."""
    store = open_text_store(spark, root)
    rows = store.forward().select("chunk_id", "doc_id", "source_name", "n_tokens", "terms")
    segment = _write_segment(store, rows, max((s.number for s in store.segments), default=0) + 1)
    return _commit(store._replace(segments=[segment] if segment.chunks else [], deletions=[]))
