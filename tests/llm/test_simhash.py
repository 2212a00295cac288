"""Fingerprints, trees and components against plain Python."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash
from corpusloom.llm.queries_groups import op12_simhash_bk_trees

from .conftest import FOLDER


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(marked, radius=4):
    """marked: list of (id, fingerprint); the least id of each row's component."""
    values = sorted({f for _, f in marked})
    top = {f: f for f in values}

    def find(f):
        while top[f] != f:
            f = top[f]
        return f

    array = np.array(values, np.uint64)
    for f in values:
        for other in array[np.bitwise_count(array ^ np.uint64(f)) <= radius].tolist():
            top[max(find(f), find(other))] = min(find(f), find(other))
    least = {}
    for i, f in marked:
        root = find(f)
        if i is not None:
            least[root] = min(least.get(root, i), i)
    return [(i, f, least.get(find(f))) for i, f in marked]


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    got = op12_simhash_bk_trees(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{f:016x}", c) for i, f, c in want)
    assert len({c for _, _, c in want}) < len(want)


def test_odd_rows(spark, odd, none):
    got = simhash.linked_documents(odd).collect()
    assert len(got) == odd.count()
    assert not simhash.linked_documents(none).collect()
    rows = odd.select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows])
    key = lambda t: tuple(str(v) for v in t)
    assert sorted(((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("blocks", range(5, 9))
def test_masks_hold_every_link(blocks):
    rng = random.Random(blocks)
    masks = [m % 2**64 for m in simhash.shard_masks(blocks)]
    for _ in range(300):
        change = sum(1 << bit for bit in rng.sample(range(64), 4))
        assert any(change & m == 0 for m in masks)


def test_forest_is_a_bk_tree():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 300, dtype=np.uint64) & np.uint64(0xFFFF)
    values = np.unique(values)
    rng.shuffle(values)
    forest = simhash.Forest(values, np.zeros(len(values), np.int64))
    plain = {}  # node -> {distance: child}, by insertion
    for value in values.tolist():
        at = None if not plain else int(values[0])
        while at is not None and (d := (at ^ value).bit_count()) in plain[at]:
            at = plain[at][d]
        if at is not None:
            plain[at][d] = value
        plain[value] = {}
    assert len(forest.children) == len(values) - 1
    for key, child in zip(forest.keys.tolist(), forest.children.tolist()):
        assert plain[int(values[key // 65])][key % 65] == int(values[child])


def test_dense_and_chained_shards(spark):
    """A shard cut into many blocks, and chains longer than the radius."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    values = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(400)}
    chain, step = [rng.getrandbits(64)], 0
    for step in range(12):
        chain.append(chain[-1] ^ (0b1111 << 4 * step))
    values = sorted(values | set(chain) | {rng.getrandbits(64) for _ in range(300)})
    nodes = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fingerprint long")
    want = {f: c for _, f, c in plain_components([(v, v) for v in values])}
    for blocks in (5, 6):
        cell = ["mask", "bits", "x", "y"]
        dealt = simhash.cells(nodes, simhash.shard_masks(blocks), 64).repartition(5, *cell).sortWithinPartitions(*cell)
        links = dealt.mapInPandas(simhash._search(4), "node long, label long").collect()
        got = plain_components([(v, v) for v in values], radius=0)
        top = {f: f for f in values}

        def find(f):
            while top[f] != f:
                f = top[f]
            return f

        for link in links:
            a, b = find(link.node % 2**64), find(link.label % 2**64)
            top[max(a, b)] = min(a, b)
        assert {f: find(f) for f in values} == want
        assert len(got) == len(values)


def test_small_visits(monkeypatch):
    """Queries are cut so that few visits are held; the result stays."""
    import pandas as pd

    rng = np.random.default_rng(3)
    values = np.unique(rng.integers(0, 2**12, 500))
    frame = pd.DataFrame({"mask": 0, "bits": 0, "x": 0, "y": 0, "side": 0, "fingerprint": values})
    whole = simhash.cell_links(frame, 1)
    monkeypatch.setattr(simhash, "VISITS", 300)
    assert simhash.cell_links(frame, 1).equals(whole)


def test_blocks_follow_the_number_of_nodes():
    assert simhash.choose_blocks(1) == 5
    assert simhash.choose_blocks(10**7) > simhash.choose_blocks(10**5)
    assert simhash.choose_blocks(10**11) == 8


def test_null_ids_alone(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r.component_id for r in simhash.linked_documents(docs.select("*", F.lit(1).alias("fingerprint"))).collect()] == [None, None]
