"""Similarity join of documents on the Jaccard measure of their word n-grams, by MinHash banding.

1. One pass over the texts gives each row a key of its words and a hash for each band. Rows with
   equal words form a class; everything below works on one row for each class.
2. A shuffle on the band hashes finds groups of classes that agree in a band. Groups with the same
   members are one group.
3. The texts of classes in groups are read again: a bitmap of fixed size passes their rows and few
   others, so that only their window sets are shuffled, not all texts.
4. The classes of a group meet in cells of two blocks each, so no task sees more than two blocks
   of a group and no pairs are written. In a cell, a pair counts if this group is the first one
   both share, and its full n-gram sets are compared. Cells give back counts of links and a
   spanning label, never pairs.
5. Labels are joined into connected components.

Bands and rows are chosen so that a pair at the threshold is found with probability
`TARGET_RECALL`; similar pairs above it are found more surely.

Defined cases: null and empty texts are equal to each other and to nothing else; texts of fewer
words than a window have one window of all words; repeated rows are rows of one class; a null
document id is kept and never becomes a class id while another is there; an empty table gives no
rows; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..settings import materialise
from .names import spare_names
from .shingles import mix, window_hashes, words_of

WINDOW = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
MOST_HASHES = 160
BLOCK_ROWS = 512  # classes in a block of a group
BLOCK_WINDOWS = 1 << 20  # windows in a block of a group
SOUGHT_BITS = 26  # of the bitmap that tells which texts are read for verification
_CHUNK = 1 << 16  # windows hashed at a time


def choose_bands(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence the fewest chance meetings, with the target recall."""
    best = (1, 1)
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(threshold, 1 - 1e-9) ** rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return drawn[:n] | np.uint64(1), drawn[n:]


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (int64) of non-empty arrays of window hashes."""
    factors, offsets = _coefficients(bands * rows)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    joined = np.concatenate(sets)
    least = np.empty((len(factors), len(sets)), np.uint64)
    for j, (factor, offset) in enumerate(zip(factors, offsets)):
        least[j] = np.minimum.reduceat((joined * factor + offset) >> np.uint64(32), starts)
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        h = np.full(len(sets), np.uint64(band + 1))
        for row in range(rows):
            h = mix(h * np.uint64(0x100000001B3) + least[band * rows + row])
        out[:, band] = h
    return out.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("text")
            keys, sizes, hashes = [], [], [None] * len(texts)
            waiting: list[tuple[int, np.ndarray]] = []

            def flush() -> None:
                if waiting:
                    for (i, _), row in zip(waiting, band_hashes([s for _, s in waiting], bands, rows)):  # noqa: B023
                        hashes[i] = row  # noqa: B023
                    waiting.clear()  # noqa: B023

            load = 0
            for i, text in enumerate(texts):
                words = words_of(text)
                keys.append(hashlib.md5(b" ".join(words)).digest())
                found = window_hashes(words, WINDOW)
                sizes.append(len(found))
                if len(found):
                    waiting.append((i, found))
                    load += len(found)
                if load > _CHUNK:
                    flush()
                    load = 0
            flush()
            yield batch.assign(key=keys, size=sizes, bands=[[] if h is None else h for h in hashes])

    return run


def row_keys(key: Column, text: Column) -> list[Column]:
    """Two hashes that tell rows of different id or text apart."""
    return [F.xxhash64(key, text).alias("_k1"), F.hash(text, key).alias("_k2")]


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), *row_keys(F.col(key), content), content.alias("text"))


def signed_rows(docs: DataFrame, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """(row, doc_id, _k1, _k2, key, size, bands) of every row, written once."""
    plain = _plain(docs, key, text).withColumn("row", F.monotonically_increasing_id())
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, _k1 long, _k2 int, row long, key binary, size int, bands array<long>"
    if kind in ("bigint", "int"):  # nulls would turn numbers into floats
        plain, schema = plain.withColumn("doc_id", F.col("doc_id").cast("string")), schema.replace(kind, "string", 1)
    signed = plain.select("doc_id", "_k1", "_k2", "row", "text").mapInPandas(_sign(bands, rows), schema)
    return materialise(signed.withColumn("doc_id", F.col("doc_id").cast(kind)), "signed")


def classes(signed: DataFrame) -> DataFrame:
    """(node, key, copies, size, bands, _k1, _k2): one row for each distinct sequence of words."""
    first = F.min_by(F.struct("size", "bands", "_k1", "_k2"), "row")
    grouped = signed.groupBy("key").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), first.alias("_f"))
    return materialise(grouped.select("node", "key", "copies", "_f.*"), "classes")


def groups(nodes: DataFrame) -> DataFrame:
    """(node, band, group, members, windows): the groups of two or more classes each class is in."""
    rows = nodes.select("node", "size", F.posexplode("bands").alias("band", "h"))
    mark = F.xxhash64("node")
    counted = rows.groupBy("band", "h").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum(F.col("size").cast("long")).alias("windows"),
        F.struct(F.bit_xor(mark).alias("a"), F.sum(F.shiftright(mark, 20)).alias("b"), F.min("node").alias("c")).alias("who"),
    )
    shared = counted.filter("members > 1").select("band", "h", "members", "windows", F.xxhash64("who", "members").alias("group"))
    return materialise(rows.join(shared, ["band", "h"]).select("node", "band", "group", "members", "windows"), "groups")


def cells(met: DataFrame, block_rows: int, block_windows: int) -> DataFrame:
    """(group, x, y, node, side): every two blocks of a group meet in one cell."""
    once = met.groupBy("group", "node").agg(F.max("members").alias("members"), F.max("windows").alias("windows"))
    blocks = F.greatest(F.ceil(F.col("members") / block_rows), F.ceil(F.col("windows") / block_windows)).cast("int")
    mine = once.select("group", "node", blocks.alias("blocks"), F.pmod(F.hash("node", "group"), blocks).alias("side"))
    dealt = mine.select("group", "node", "side", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return dealt.select("group", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "node", "side")


def sought_bitmap(wanted: DataFrame) -> np.ndarray:
    """Bits of the wanted row keys: 2^SOUGHT_BITS of them (8 MB), however many rows are wanted."""
    slot = F.shiftrightunsigned("_k1", 64 - SOUGHT_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_k1, {64 - SOUGHT_BITS}) % 64 as int))")
    words = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bitmap = np.zeros(1 << (SOUGHT_BITS - 6), np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return bitmap.view(np.uint64)


def _windows(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slot = batch["_k1"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - SOUGHT_BITS)
            hit = (shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            batch = batch[hit]
            texts = batch.pop("text")
            yield batch.assign(windows=[np.unique(window_hashes(words_of(t), WINDOW)).tobytes() for t in texts])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (columns: index in left, index in right)."""
    n, m = len(left), len(right)
    joined = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), [len(s) for s in (*left, *right)])
    column = np.unique(joined, return_inverse=True)[1]
    often = np.bincount(column) > 1
    renamed = np.cumsum(often) - 1
    keep = often[column]
    column, owner = renamed[column[keep]], owner[keep]
    wide = int(often.sum())
    if n * m * wide < 4e6 + len(pairs) * 6e5:  # products of dense blocks
        found = np.zeros((n, m), np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for first in range(0, wide, 2048):
            a, b = np.searchsorted(column, (first, first + 2048))
            dense = np.zeros((n + m, min(2048, wide - first)), np.float32)
            dense[owner[a:b], column[a:b] - first] = 1
            found += dense[:n] @ dense[n:].T
        return np.rint(found[pairs[:, 0], pairs[:, 1]]).astype(np.int64)
    order = np.lexsort((column, owner))
    column, owner = column[order], owner[order]
    cut = np.searchsorted(owner, np.arange(n + m + 1))
    sets = [column[cut[i] : cut[i + 1]] for i in range(n + m)]
    return np.array([len(np.intersect1d(sets[i], sets[n + j], assume_unique=True)) for i, j in pairs], np.int64)


def _verify(threshold: float):
    columns = ["node", "links", "copies", "label"]

    def run(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        group, x, y = key
        cell = cell.drop_duplicates("node").sort_values("node")
        a, b = cell[cell.side == x], cell[cell.side == y]
        empty = pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        if a.empty or b.empty:
            return empty
        path_a, path_b = np.stack(a.path.to_list()), np.stack(b.path.to_list())
        size_a, size_b = (p.windows.map(len).to_numpy() // 8 for p in (a, b))
        least = np.minimum(size_a[:, None], size_b) >= threshold * np.maximum(size_a[:, None], size_b)
        if x == y:
            least = np.triu(least, 1)
        i, j = np.nonzero(least)
        first = np.full(len(i), -1, np.int64)
        open_ = np.ones(len(i), bool)
        for band in range(path_a.shape[1]):
            same = open_ & (path_a[i, band] == path_b[j, band]) & (path_a[i, band] != 0)
            first[same] = path_a[i[same], band] == group
            open_ &= ~same
        pairs = np.column_stack((i, j))[first == 1]
        if not len(pairs):
            return empty
        used_a, at_a = np.unique(pairs[:, 0], return_inverse=True)
        used_b, at_b = np.unique(pairs[:, 1], return_inverse=True)
        sets_a = [np.frombuffer(w, np.uint64) for w in a.windows.iloc[used_a]]
        sets_b = [np.frombuffer(w, np.uint64) for w in b.windows.iloc[used_b]]
        both = _common(sets_a, sets_b, np.column_stack((at_a, at_b)))
        union = size_a[pairs[:, 0]] + size_b[pairs[:, 1]] - both
        pairs = pairs[both >= threshold * union - 1e-9]
        if not len(pairs):
            return empty
        node_a, node_b = a.node.to_numpy()[pairs[:, 0]], b.node.to_numpy()[pairs[:, 1]]
        copies_a, copies_b = a.copies.to_numpy()[pairs[:, 0]], b.copies.to_numpy()[pairs[:, 1]]
        nodes, at = np.unique(np.concatenate((node_a, node_b)), return_inverse=True)
        copies = np.bincount(at, np.concatenate((copies_b, copies_a)), len(nodes)).astype(np.int64)
        p, q = at[: len(pairs)], at[len(pairs) :]
        label = np.arange(len(nodes))
        while True:  # least label of each component of the cell
            low = label.copy()
            np.minimum.at(low, p, label[q])
            np.minimum.at(low, q, label[p])
            low = low[low]
            if (low == label).all():
                break
            label = low
        return pd.DataFrame({"node": nodes, "links": np.bincount(at, minlength=len(nodes)), "copies": copies, "label": nodes[label]})

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of `edges` (node, label): the least node each is connected to.

    Every round, each node takes the least root among its neighbours and then its root's root;
    rounds go on until nothing changes and are written to the shared folder.
    """
    pairs = edges.select("node", "label").union(edges.select("label", "node")).distinct()
    links = materialise(pairs.toDF("node", "next"), "links")
    roots = materialise(links.groupBy("node").agg(F.least(F.min("next"), F.col("node")).alias("root")), "roots")
    while True:
        far = links.join(roots.select(F.col("node").alias("next"), F.col("root").alias("near")), "next")
        low = far.groupBy("node").agg(F.min("near").alias("near"))
        moved = roots.join(low, "node").select("node", "root", F.least("root", "near").alias("near"))
        up = roots.select(F.col("node").alias("near"), F.col("root").alias("top"))
        stepped = materialise(moved.join(up, "near").select("node", "root", F.least("near", "top").alias("next")), "roots")
        roots = stepped.select("node", F.col("next").alias("root"))
        if stepped.filter(F.col("next") != F.col("root")).isEmpty():
            return roots


def linked_rows(
    docs: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text",
    block_rows: int = BLOCK_ROWS, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """(doc_id, class_id, n_links, row, root, _k1, _k2) of every row.

    `class_id` is the least document id among the rows connected by links, `n_links` the number of
    other rows whose n-gram sets reach the threshold, `root` the least row of the connected ones.
    """
    bands, rows = choose_bands(threshold)
    signed = signed_rows(docs, bands, rows, key, text)
    nodes = classes(signed)
    met = groups(nodes)
    path = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda band: F.coalesce(F.element_at("_m", band.cast("int")), F.lit(0).cast("long"))
    )
    paths = met.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("band", "group"))).alias("_m")).select("node", path.alias("path"))
    wanted = paths.join(nodes.select("node", "copies", "_k1", "_k2"), "node")
    wanted = materialise(wanted, "sought")
    shared = docs.sparkSession.sparkContext.broadcast(sought_bitmap(wanted))
    found = _plain(docs, key, text).select("_k1", "_k2", "text").mapInPandas(_windows(shared), "_k1 long, _k2 int, windows binary")
    sets = materialise(found.join(wanted, ["_k1", "_k2"]).select("node", "copies", "path", "windows"), "sets")
    dealt = cells(met, block_rows, block_windows).join(sets, "node")
    found = dealt.groupBy("group", "x", "y").applyInPandas(_verify(threshold), "node long, links long, copies long, label long")
    found = materialise(found, "links")
    totals = found.groupBy("node").agg(F.sum("copies").alias("linked"))
    roots = components(found.select("node", "label"))
    known = nodes.select("node", "key", "copies").join(totals, "node", "left").join(roots, "node", "left")
    known = known.select("key", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    placed = materialise(signed.select("doc_id", "_k1", "_k2", "row", "key").join(known, "key").drop("key"), "placed")
    named = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return placed.join(named, "root").select("doc_id", "class_id", "n_links", "row", "root", "_k1", "_k2")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each group of connected rows: its least row."""
    names = spare_names(docs, "_k1", "_k2")
    kept = linked_rows(docs, key=key, text=text).filter(F.col("row") == F.col("root")).select("_k1", "_k2").toDF(*names)
    content = F.coalesce(F.col(text), F.lit(""))
    marked = docs.select("*", *(k.alias(n) for k, n in zip(row_keys(F.col(key), content), names)))
    return marked.join(materialise(kept, "kept"), names, "left_semi").dropDuplicates(names).drop(*names)
