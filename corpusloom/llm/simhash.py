"""Near-duplicate groups of documents by SimHash fingerprints and Burkhard-Keller trees.

1. Each text becomes one 64-bit fingerprint of its word shingles; a Python worker sees texts only.
   Equal fingerprints are one node from here on.
2. Fingerprints that differ in at most `radius` bits agree in at least m - radius of m blocks of
   bits. Every choice of m - radius blocks deals the nodes into shards of equal bits, so each link
   lies inside a shard. m follows the number of nodes: more nodes, longer equal parts, smaller shards.
3. A shard is cut into blocks of `BLOCK` nodes, and two blocks meet in a cell. One block becomes a
   BK-tree, in which a child hangs at the integer Hamming distance to its parent; the other block's
   nodes follow only edges whose distance is within the radius of their own distance to the parent.
   Trees reach the tasks of their queries by the shuffle: a broadcast would pass all fingerprints
   through the driver and has no bound.
4. A task builds and searches the trees of all its cells level by level. It gives back the
   connected nodes of its cells, never pairs; labels are then joined into components.

Defined cases: a null text counts as empty; texts without words have the fingerprint zero and link
like any other; repeated rows stay rows of their own; a null document id is kept, and is a
component's id only if all its ids are null; an empty table gives no rows; other columns are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..settings import materialise
from .jaccard_join import components

SHINGLE = 4
SEED = 42
RADIUS = 4
BLOCK = 1024  # nodes of a shard in a tree or in a set of queries
VISITS = 1 << 20  # most node visits held at a time
_SLICE = 1 << 16  # shingles hashed at a time
_ROW_COST, _PAIR_COST = 2e-6, 4e-8  # seconds for a dealt row and for a visited pair, measured


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' XXH64 values, as a signed number."""
    import xxhash

    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLICE):
        part = zip(starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist())
        hashes = np.fromiter((digest(text[a:b], SEED) for a, b in part), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t.encode("utf-8", "surrogatepass").lower().split()) for t in texts], dtype="int64")


def with_fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row; only ASCII letters are lower-cased."""
    made = F.pandas_udf(_fingerprints, "long")
    return docs.select(F.col(key).alias("doc_id"), made(F.coalesce(F.col(text), F.lit(""))).alias("fingerprint"))


def choose_blocks(nodes: int, radius: int = RADIUS) -> int:
    """How many blocks of bits make the dealt rows and the visited pairs of `nodes` fingerprints cheapest."""

    def cost(blocks: int) -> float:
        dealt = nodes * comb(blocks, radius)
        return dealt * _ROW_COST + dealt * nodes / 2 ** (64 * (blocks - radius) // blocks) / 2 * _PAIR_COST

    return min(range(radius + 1, 2 * radius + 1), key=cost)


def shard_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks (signed) of every choice of blocks - radius blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cells(nodes: DataFrame, masks: list[int], block: int = BLOCK) -> DataFrame:
    """(mask, bits, x, y, side, fingerprint): every two blocks of a shard of two or more nodes meet in one cell."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)]))
    dealt = nodes.select("fingerprint", keys.alias("k")).select("fingerprint", "k.mask", "k.bits")
    sizes = dealt.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    n_blocks = F.ceil(F.col("members") / block).cast("int")
    mine = dealt.join(sizes.select("mask", "bits", n_blocks.alias("n")), ["mask", "bits"])
    mine = mine.withColumn("side", F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int"))
    other: Column = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    met = mine.select("mask", "bits", "side", "fingerprint", other.alias("other"))
    return met.select("mask", "bits", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"), "side", "fingerprint")


class Forest:
    """BK-trees of many groups of fingerprints, built level by level.

    Every tree is the one that inserting its group in the given order makes: a node's children hang
    at distinct distances, and the first fingerprint at a distance is the child.
    """

    def __init__(self, values: np.ndarray, trees: np.ndarray) -> None:
        n = len(values)
        self.values = values
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        rest, group = np.arange(n), trees
        self.roots = np.zeros(0, np.int64)
        above = None  # node above each open group
        while len(rest):
            order = np.lexsort((rest, group))
            rest, group = rest[order], group[order]
            head = np.concatenate(([True], group[1:] != group[:-1]))
            node = rest[head][np.cumsum(head) - 1]  # the first of a group becomes its node
            if above is None:
                self.roots = rest[head]
            else:
                parent[rest[head]] = above[order][head]
            rest, node = rest[~head], node[~head]
            distance = np.bitwise_count(values[rest] ^ values[node]).astype(np.int64)
            edge[rest] = distance
            group, above = node * 65 + distance, node
        hung = np.flatnonzero(parent >= 0)
        hung = hung[np.lexsort((edge[hung], parent[hung]))]
        self.children = hung
        self.keys = parent[hung] * 65 + edge[hung]  # sorted: the edges of one node lie together

    def near(self, asked: np.ndarray, start: np.ndarray, limit: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(position in asked, node) within the radius; each query enters at its root and sees nodes before its limit."""
        query, node = np.arange(len(asked)), start
        none = np.zeros(0, np.int64)
        hits = [(none, none)]
        while len(query):
            open_ = node < limit[query]  # a child comes after its parent, so nothing below it is before the limit either
            query, node = query[open_], node[open_]
            distance = np.bitwise_count(asked[query] ^ self.values[node]).astype(np.int64)
            close = distance <= radius
            hits.append((query[close], node[close]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
            width = high - low
            query = np.repeat(query, width)
            at = np.arange(len(query)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
            node = self.children[at]
        return np.concatenate([q for q, _ in hits]), np.concatenate([n for _, n in hits])


def least_labels(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least position connected to each of n positions by the links p[i] - q[i]."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, p, label[q])
        np.minimum.at(low, q, label[p])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def cell_links(frame: pd.DataFrame, radius: int) -> pd.DataFrame:
    """(node, label) of the connected fingerprints of whole cells."""
    frame = frame.sort_values(["mask", "bits", "x", "y", "side", "fingerprint"], ignore_index=True)
    changed = np.zeros(len(frame), bool)
    for column in ("mask", "bits", "x", "y"):
        v = frame[column].to_numpy()
        changed[1:] |= v[1:] != v[:-1]
    cell = np.cumsum(changed)
    values = frame["fingerprint"].to_numpy(np.int64).view(np.uint64)
    x, y, side = (frame[c].to_numpy() for c in ("x", "y", "side"))
    grown = np.flatnonzero(side == x)  # block x is the tree; it precedes block y in its cell
    forest = Forest(values[grown], cell[grown])
    n_cells = int(cell[-1]) + 1
    size = np.bincount(cell[grown], minlength=n_cells)
    root = np.full(n_cells, -1, np.int64)
    root[cell[grown[forest.roots]]] = forest.roots
    asked = np.flatnonzero((side == y) & (root[cell] >= 0))
    place = np.cumsum(side == x) - 1
    limit = np.where(x[asked] == y[asked], place[asked], len(grown))  # a member of the tree asks for nodes before itself only
    budget = np.cumsum(size[cell[asked]])
    none = np.zeros(0, np.int64)
    found, at = [(none, none)], 0
    while at < len(asked):
        to = max(at + 1, int(np.searchsorted(budget, (budget[at - 1] if at else 0) + VISITS, "right")))
        part = asked[at:to]
        hit, node = forest.near(values[part], root[cell[part]], limit[at:to], radius)
        found.append((part[hit], grown[node]))
        at = to
    p, q = np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
    nodes, named = np.unique(values[np.concatenate((p, q))].view(np.int64), return_inverse=True)
    label = least_labels(len(nodes), named[: len(p)], named[len(p) :])
    linked = label != np.arange(len(nodes))
    return pd.DataFrame({"node": nodes[linked], "label": nodes[label[linked]]})


def _search(radius: int):
    cell = ["mask", "bits", "x", "y"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Batches come sorted by cell; the last cell of a batch waits for the next one."""
        kept = None
        for batch in batches:
            if batch.empty:
                continue
            if kept is not None:
                batch = pd.concat([kept, batch], ignore_index=True)
            last = (batch[cell] == batch[cell].iloc[-1]).all(axis=1)
            kept = batch[last]
            if not last.all():
                yield cell_links(batch[~last], radius)
        if kept is not None:
            yield cell_links(kept, radius)

    return run


def linked_documents(docs: DataFrame, radius: int = RADIUS, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every row.

    `component_id` is the least document id that links of at most `radius` differing bits reach.
    """
    signed = materialise(with_fingerprint(docs, key, text), "fingerprints")
    nodes = materialise(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    masks = shard_masks(choose_blocks(max(1, nodes.count()), radius), radius)
    cell = ["mask", "bits", "x", "y"]
    dealt = cells(nodes.select("fingerprint"), masks, block).repartition(*cell).sortWithinPartitions(*cell)
    links = materialise(dealt.mapInPandas(_search(radius), "node long, label long"), "links")
    roots = components(links)
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    rooted = rooted.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    known = rooted.join(named, "root").select("fingerprint", "component_id")
    return signed.join(known, "fingerprint").select("doc_id", "fingerprint", "component_id")
