"""Benchmark decontamination by greedy string tiling.

Seeds are windows of `MIN_MATCH` words that a document shares with a benchmark item. Documents
are searched by running Karp-Rabin hashes: a bitmap of the benchmark's hashes (a fixed number of
bits, however large the benchmark is) passes few windows, and these are joined with the
benchmark's windows by their words. For each document and item that share seeds, runs of seeds on
a diagonal are the maximal matches; the longest match without marked words is marked again and
again, and an item counts as leaked if the marked tiles cover `MIN_COVERAGE` of its words. Tiles
may lie in any order in the document, so reordered passages are found.

Defined cases: items of fewer words than a seed are too short to tell and never match; null and
empty texts match nothing; repeated rows (same id, same text) give one result; a null id is kept;
empty tables give no rows; extra columns are left alone.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..settings import materialise
from .jaccard_join import row_keys
from .names import spare_names
from .shingles import window_hashes

MIN_MATCH = 4
MIN_COVERAGE = 0.5
BITMAP_BITS = 22  # the bitmap has 2^22 bits, 512 KB

_WORD = re.compile(r"[^\W_]+")
_DOC = np.int64((1 << 40) - 1)


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return _WORD.findall(text.lower())


def _hashes(words: list[str], size: int) -> np.ndarray:
    return window_hashes([w.encode("utf-8", "surrogatepass") for w in words], size) if len(words) >= size else np.zeros(0, np.uint64)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _item_grams(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"]):
                words = words_of(text)
                slots = _slots(_hashes(words, size))
                rows += [(item, len(words), i, " ".join(words[i : i + size]), int(slot)) for i, slot in enumerate(slots)]
            yield pd.DataFrame(rows, columns=["item", "n_words", "at", "gram", "slot"])

    return run


def item_grams(benchmark: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(item, n_words, at, gram, slot): the windows of every benchmark text; `item` is its hash."""
    plain = benchmark.select(F.xxhash64(F.col(key), F.col(text)).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return plain.mapInPandas(_item_grams(size), "item long, n_words int, at int, gram string, slot int")


def _seeds(bitmap: np.ndarray, size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k1, k2, text in zip(batch["_k1"], batch["_k2"], batch["text"]):
                words = words_of(text)
                slots = _slots(_hashes(words, size))
                hits = np.flatnonzero(bitmap[slots >> 3] >> (slots & 7) & 1)
                rows += [(k1, k2, i, " ".join(words[i : i + size])) for i in hits.tolist()]
            yield pd.DataFrame(rows, columns=["_k1", "_k2", "pos", "gram"])

    return run


def tiles(pairs: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, document start, words) from seeds (item position, document position)."""
    diagonal = pairs[:, 1] - pairs[:, 0]
    order = np.lexsort((pairs[:, 0], diagonal))
    pairs, diagonal = pairs[order], diagonal[order]
    broken = np.flatnonzero((np.diff(diagonal) != 0) | (np.diff(pairs[:, 0]) != 1)) + 1
    starts = np.concatenate(([0], broken))
    lengths = np.diff(np.concatenate((starts, [len(pairs)]))) + size - 1
    heap = [(-int(n), int(i), int(d)) for n, (i, d) in zip(lengths, pairs[starts])]
    heapq.heapify(heap)
    item_marks = np.zeros(int(pairs[:, 0].max()) + size, bool)
    first = int(pairs[:, 1].min())
    doc_marks = np.zeros(int(pairs[:, 1].max()) - first + size, bool)
    found = []
    while heap:
        n, i, d = heapq.heappop(heap)
        n = -n
        marked = item_marks[i : i + n] | doc_marks[d - first : d - first + n]
        if not marked.any():
            item_marks[i : i + n] = True
            doc_marks[d - first : d - first + n] = True
            found.append((i, d, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], marked, [True])).astype(np.int8)))
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a >= size:
                heapq.heappush(heap, (a - b, i + a, d + a))
    return found


def _tile(size: int, coverage: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                packed = np.asarray(row.pairs, np.int64)
                pairs = np.column_stack((packed >> 40, packed & _DOC))
                reach = np.unique((np.unique(pairs[:, 0])[:, None] + np.arange(size)).ravel())
                if len(reach) < coverage * row.n_words:
                    continue  # tiles can't cover more than their seeds
                found = tiles(pairs, size)
                matched = sum(n for _, _, n in found)
                if matched >= coverage * row.n_words:
                    spans = [{"item": i, "doc": d, "words": n} for i, d, n in sorted(found)]
                    rows.append((row.k1, row.k2, row.item, row.n_words, matched, spans))
            yield pd.DataFrame(rows, columns=["_k1", "_k2", "item", "item_words", "matched_words", "tiles"])

    return run


def leaks(
    docs: DataFrame, benchmark: DataFrame, size: int = MIN_MATCH, coverage: float = MIN_COVERAGE,
    key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(_k1, _k2, item, item_words, matched_words, tiles) of every leaked document and item.

    `_k1, _k2` are the row keys of the document, `item` is the hash of the benchmark row.
    """
    spark = docs.sparkSession
    grams = materialise(item_grams(benchmark, size, item_key, item_text), "grams").distinct()
    bitmap = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    slots = grams.select("slot").distinct().toPandas()["slot"].to_numpy()  # at most 2^BITMAP_BITS numbers
    np.bitwise_or.at(bitmap, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    shared = spark.sparkContext.broadcast(bitmap)
    content = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(*row_keys(F.col(key), content), content.alias("text"))

    def seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _seeds(shared.value, size)(batches)

    hits = plain.mapInPandas(seeds, "_k1 long, _k2 int, pos long, gram string")
    met = hits.join(grams.select("item", "n_words", "at", "gram"), "gram")
    pair = F.shiftleft(F.col("at").cast("long"), 40) + F.col("pos")
    gathered = met.groupBy("_k1", "_k2", "item", "n_words").agg(F.collect_set(pair).alias("pairs"))
    schema = "_k1 long, _k2 int, item long, item_words int, matched_words int, tiles array<struct<item:int,doc:long,words:int>>"
    return gathered.withColumnsRenamed({"_k1": "k1", "_k2": "k2"}).mapInPandas(_tile(size, coverage), schema)


def leaked_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(key, item_key, item_words, matched_words, coverage, tiles): one row per leaked document and item."""
    found = materialise(leaks(docs, benchmark, key=key, text=text, item_key=item_key), "leaks")
    named = docs.select(F.col(key), *row_keys(F.col(key), F.coalesce(F.col(text), F.lit("")))).dropDuplicates(["_k1", "_k2"])
    items = benchmark.select(F.col(item_key), F.xxhash64(F.col(item_key), F.col("text")).alias("item")).dropDuplicates(["item"])
    told = found.join(named, ["_k1", "_k2"]).join(items, "item")
    return told.select(key, item_key, "item_words", "matched_words", (F.col("matched_words") / F.col("item_words")).alias("coverage"), "tiles")


def without_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the rows that hold a benchmark item."""
    names = spare_names(docs, "_k1", "_k2")
    found = materialise(leaks(docs, benchmark, key=key, text=text).select("_k1", "_k2"), "leaks").distinct().toDF(*names)
    keys = row_keys(F.col(key), F.coalesce(F.col(text), F.lit("")))
    marked = docs.select("*", *(k.alias(n) for k, n in zip(keys, names)))
    return marked.join(found, names, "left_anti").drop(*names)
