"""Words, filters, near pairs, forms and roots against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import spelling
from corpusloom.llm.queries_groups import op11_spelling_groups

from .conftest import FOLDER


def plain_words(rows, every=199, least=6, count=5):
    found = Counter()
    for doc, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= count}


def plain_groups(words, letters):
    out = {}
    for w in words:
        near = {w[:i] + w[i + 1 :] for i in range(len(w))}
        near |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = sorted((near & words.keys()) - {w}, key=lambda x: (-words[x], x))
        form = near[0] if near and words[near[0]] >= 5 * words[w] else None
        out[w] = [form, words[w], len(near), words.get(form)]
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def found(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    words = plain_words(rows)
    want = plain_groups(words, sorted(set("".join(words))))
    got = op11_spelling_groups(spark, FOLDER)
    assert got.count() == len(words)
    assert found(got) == want


@pytest.fixture
def vocabulary():
    """Dense words over few letters, counts far apart, one very long word and its variant."""
    rng = random.Random(11)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))): 5 ** rng.randint(1, 8) for _ in range(900)}
    long = "".join(rng.choice("xyz") for _ in range(700))
    return words | {long: 7, long[:300] + "q" + long[301:]: 90, long[:5] + long[6:]: 3000}


def test_dense_words(spark, vocabulary):
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    want = plain_groups(vocabulary, sorted(set("".join(vocabulary))))
    assert found(spelling.spelling_groups(df)) == want
    assert any(form and form != root for _, form, root, *_ in want)  # chains of forms occur


def test_slices_and_weak_filters(spark, vocabulary, monkeypatch):
    """Many broadcast slices, and a filter that passes almost everything, give the same pairs."""
    df = spark.createDataFrame(list(vocabulary.items()), "word string, n long")
    whole = {frozenset((r.word, r.near)) for r in spelling.near_pairs(df).collect()}
    weak = spelling.near_pairs(df, bits=1).collect()
    assert len(weak) == len(whole)
    monkeypatch.setattr(spelling, "SLICE", 64 * spelling.LANES * 7)
    sliced = spelling.near_pairs(df).collect()
    assert len(sliced) == len(whole) and {frozenset((r.word, r.near)) for r in sliced} == whole


def test_filter_has_every_word_and_few_others():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(4000)})
    shards = spelling.Shards({8: 3000})
    hashes = spelling.letters(words) @ spelling._powers(8)
    lanes = np.zeros(shards.total * spelling.LANES, np.uint64)
    block = shards.block(hashes, 8)
    for lane in range(spelling.LANES):
        np.bitwise_or.at(lanes, block[:3000] * spelling.LANES + lane, spelling._lane_bits(hashes[:3000], lane))
    hit = np.all([lanes[block * spelling.LANES + k] & spelling._lane_bits(hashes, k) != 0 for k in range(spelling.LANES)], axis=0)
    assert hit[:3000].all() and hit[3000:].mean() < 0.02


def test_edit_hashes():
    codes = spelling.letters(["aabbc", "cabba"])
    powers = spelling._powers
    spelled = lambda w: spelling.letters([w]) @ powers(len(w))
    alphabet = np.array([97, 98, 99], np.uint64)
    made = set()
    for row, place, letter, hashes in spelling._replaced(codes, alphabet):
        for r, i, c, h in zip(row, place, letter, hashes):
            word = ["aabbc", "cabba"][r]
            assert chr(c) > word[i] and h == spelled(word[:i] + chr(c) + word[i + 1 :])[0]
            made.add((r, i, c))
    assert len(made) == 2 * 2 + 2 * 1 + 2 * 2 + 2 * 1
    row, place, hashes = spelling._shortened(codes)
    assert [(r, i) for r, i in zip(row, place)] == [(0, 0), (0, 2), (0, 4), (1, 0), (1, 1), (1, 2), (1, 4)]
    for r, i, h in zip(row, place, hashes):
        word = ["aabbc", "cabba"][r]
        assert h == spelled(word[:i] + word[i + 1 :])[0]


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    words = plain_words(rows, every=3, least=4, count=1)
    got = spelling.word_counts(odd, min_length=4, min_count=1, drop_every=3)
    assert {r.word: r.n for r in got.collect()} == words
    assert not spelling.spelling_groups(spelling.word_counts(none)).collect()
    clash = odd.select("*", F.lit("x").alias("word"), F.lit(1).alias("n"), F.lit("y").alias("near"))
    assert found(spelling.spelling_groups(spelling.word_counts(clash, min_count=1))) == plain_groups(
        plain_words(rows, every=None, count=1), sorted(set("".join(plain_words(rows, every=None, count=1))))
    )


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.root for r in spelling.roots(chain).collect()} == {"w9"}
