"""Learned and approximate operators against brute force and held-out labels."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm import decontamination, jaccard_join, language_model, quality_model, queries_models, shingles, toxicity
from corpusloom.llm.labels import all_labelled, fold, labelled

from .conftest import FOLDER

LARGER = "/root/testdata/sf0.01"


def test_folds(spark):
    ids = [0, 1, 17, 2**40, -3]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "doc_id long")
    got = {r.doc_id: r.f for r in df.select("doc_id", fold(F.col("doc_id"), 4).alias("f")).collect()}
    assert got == {**{i: zlib.crc32(str(i).encode()) % 4 for i in ids}, None: 0}


def test_samples_are_bounded(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (4, None), (5, 1), (None, 1), (5, 1), (6, 7)], "doc_id long, quality int")
    rows = labelled(odd, labels, "quality", 2).collect()
    assert Counter(r.label for r in rows) == {1: 2, 0: 1} and all(r.text is not None for r in rows)


def test_labels_meet_texts_alike_at_every_size(spark, odd):
    """A few labels take the same road as many: they aren't broadcast, and no text is sorted."""
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (4, None), (None, 1), (1, 0), (6, 7)], "doc_id long, toxic int")
    rows = all_labelled(odd, labels, "toxic")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "Sort " not in plan
    held = {r.doc_id for r in odd.collect()}
    assert {(r.doc_id, r.label) for r in rows.collect()} == {(i, y) for i, y in ((0, 1), (1, 1), (2, 0)) if i in held}


# --- quality trees ----------------------------------------------------------------------
def test_flat_trees_separate():
    draw = np.random.default_rng(1)
    counts = draw.integers(1, 500, (4000, 14)).astype(float)
    label = ((counts[:, 3] / counts[:, 9] > 0.5) ^ (counts[:, 9] > 400)).astype(float)
    model = quality_model.fit(counts[:3000], label[:3000])
    assert ((model.score(counts[3000:]) > 0.5) == label[3000:]).mean() > 0.93

    def walk(tree, row):
        node = 0
        while node < 2**quality_model.DEPTH - 1:
            node = 2 * node + 1 + int(row[model.feature[tree, node]] > model.threshold[tree, node])
        return model.value[tree, node - (2**quality_model.DEPTH - 1)]

    x = quality_model.features(counts[:20])
    assert np.allclose(model.margin(x), [model.base + sum(walk(t, row) for t in range(quality_model.TREES)) for row in x])


def test_statistics(spark):
    text = "Ab ab ab\nCD|e! f,g.\n\nAb ab ab 12"
    got = spark.createDataFrame([(text,)], "t string").select(quality_model.statistics(F.col("t")).alias("c")).first().c
    words = text.split()
    assert got == [
        len(text), len("".join(words)), 4, 1, 1, 1, 1, 1, 2, len(words), len(set(words)), sum(a == b for a, b in zip(words, words[1:])), 4, 4,
    ]


def test_held_out_quality(spark, odd, none):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = queries_models.op4_quality_trees(spark, LARGER).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in held]) > 0.9
    model = quality_model.train(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality_model.with_score(odd.drop("score"), model).collect()} == {0.5}
    assert quality_model.with_score(none, model).count() == 0


# --- toxicity ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def detector():
    words = dict.fromkeys("loser idiot pathetic worthless moron trash stupid".split(), 7.0)
    usual = [(w, 40.0) for w in "the and with harbour lamp rain story about letter number inger".split()]
    return toxicity.Detector(words, {}, toxicity.CharModel.of(usual + [(w, 20.0) for w in words]), (-20.0, 4.0, 0.5))


@pytest.mark.parametrize(
    "text",
    ["an 1d10t here", "s t u p i d", "stuuuuupid!", "p@thet1c", "m0r0n!!", "l.o.s.e.r", "tr4sh", "w0rthle$$", "lo-ser", "id*ot", "I D I O T"],
)
def test_obfuscated_words_are_found(detector, text):
    assert detector.score(text) > 0.5


@pytest.mark.parametrize("text", ["", "the lamp and the rain", "THE!! LAMP!!", "inger### lamp***", "a b c d", "+1 (716) 555-3986", "12:30 3-4"])
def test_clean_words_are_left(detector, text):
    assert detector.score(text) < 0.5


def test_set_apart_words_beside_marks_are_found():
    words = dict.fromkeys("pathetic moron idiot sod".split(), 7.0)
    usual = [(w, 40.0) for w in "the and with harbour lamp rain story such reply".split()]
    found = toxicity.Detector(words, {"losi": 6.0}, toxicity.CharModel.of(usual + [(w, 20.0) for w in [*words, "losing"]]))
    for text in (
        "such a p a t h e t i c, reply", "the m o r o n.", '"i d i o t"', "(m 0 r o n)!!", "what an i d i o t!", "the s o d, and",
        "s o d", "i, d, i, o, t", "l o s i n g", "_m_ o r o n",
    ):
        assert found.hits(text), text
    for text in ("a, b, c", "such a r a i n, story", '"l a m p"', "1. 2. 3. 4.", "- - -", "so d is here"):
        assert not found.hits(text), text


def test_viterbi_is_the_best_path(detector):
    """Against all paths of short lattices."""

    def best(chars):
        paths = [("", 0.0)]
        for i in range(len(chars)):
            paths = [(out + o, cost + c) for out, cost in paths for o, c in toxicity._options(chars, i)]

        def price(out):
            padded = f"^^{out}$"
            return sum(detector.chars.cost(padded[k - 2 : k], padded[k]) for k in range(2, len(padded)))

        return min(cost + price(out) for out, cost in paths), price, paths

    for chars in ("1d10t", "tr@sh", "l-o5er", "aab"):
        least, price, paths = best(chars)
        found = toxicity.decode(chars, detector.chars)
        assert math.isclose(min(c + price(o) for o, c in paths if o == found), least)


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """A word that only many documents together tell apart, with a former limit set low."""
    monkeypatch.setattr(toxicity, "MAX_LABELLED", 3, raising=False)
    rows = [(i, f"tree river n{'abcdefghij'[i % 10]}{'klmnop'[i // 10]} " + ("vilest" if i % 2 else "kindly"), i % 2) for i in range(60)]
    given = spark.createDataFrame(rows, "doc_id LONG, text STRING, toxic INT")
    detector = toxicity.train(given.drop("toxic"), given.drop("text"))
    assert set(detector.words) == {"vilest"}
    scores = {(r.toxic, round(r.score, 9)) for r in toxicity.with_score(given, detector).collect()}
    assert len(scores) == 2 and min(scores)[1] < 0.5 < max(scores)[1]


def test_toxicity_query(spark, odd, none):
    rows = queries_models.op7_noisy_toxicity(spark, LARGER).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and np.mean([p == y for p, y in held]) > 0.85
    blank = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len({r.s for r in toxicity.with_score(odd, blank, name="s").collect()}) == 1
    assert toxicity.with_score(none, blank, name="s").count() == 0


# --- windows, MinHash -------------------------------------------------------------------
def test_windows():
    draw = random.Random(3)
    words = [draw.choice("ab cde f".split()).encode() for _ in range(500)]
    hashes = shingles.window_hashes(words, 5)
    seen = {}
    for i, h in enumerate(hashes.tolist()):
        assert seen.setdefault(tuple(words[i : i + 5]), h) == h
    assert len(set(seen.values())) == len(seen) and len(hashes) == 496
    assert len(shingles.window_hashes(words[:3], 5)) == 1 and len(shingles.window_hashes([], 5)) == 0


def test_bands():
    bands, rows = jaccard_join.choose_bands()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= jaccard_join.MOST_HASHES


def brute_links(texts):
    """links and least connected id by comparing all pairs that share a window."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    both = Counter((a, b) for ids in at.values() for x, b in enumerate(ids) for a in ids[:x])
    links, root = Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [512, 3])
def test_join_is_complete(spark, block):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    draw = random.Random(9)
    base = [f"w{draw.randrange(5000)}" for _ in range(120)]
    more = []
    for i in range(60):
        words = list(base)
        for k in draw.sample(range(120), draw.randrange(3)):
            words[k] = f"x{i}"
        more.append((10_000 + i, " ".join(words)))
    more += [(20_000, None), (20_001, ""), (20_002, "one two"), (20_003, "ONE  two")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = brute_links({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.linked_rows(docs, block_rows=block).collect()}
    assert got == want
    kept = [r.doc_id for r in jaccard_join.one_of_each(docs).collect()]
    assert len(kept) == len({c for c, _ in want.values()}) == len({want[i][0] for i in kept})


def test_join_of_odd_rows(odd, none):
    rows = jaccard_join.linked_rows(odd).collect()
    assert len(rows) == odd.count() and sorted(r.n_links for r in rows) == [0, 0, 0, 2, 2, 2, 2, 2, 2]
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 5
    assert jaccard_join.linked_rows(none).count() == 0 and jaccard_join.one_of_each(none).count() == 0


def test_chains_are_connected(spark):
    edges = [(i, i + 1) for i in range(0, 40, 1)] + [(100, 101), (102, 101)]
    random.Random(2).shuffle(edges)
    roots = jaccard_join.components(spark.createDataFrame([(b, a) for a, b in edges], "node long, label long"))
    assert {(r.node, r.root) for r in roots.collect()} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


# --- string tiling ----------------------------------------------------------------------
def brute_tiling(a, b, k):
    marks_a, marks_b, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in marks_a and j + n not in marks_b:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return total
        total += n
        marks_a |= set(range(i, i + n))
        marks_b |= set(range(j, j + n))


def test_tiles():
    draw = random.Random(4)
    for _ in range(60):
        item = [draw.choice("abcd") for _ in range(draw.randrange(4, 20))]
        doc = [draw.choice("abcd") for _ in range(40)]
        pairs = [(i, j) for i in range(len(item) - 3) for j in range(len(doc) - 3) if item[i : i + 4] == doc[j : j + 4]]
        if pairs:
            found = decontamination.tiles(np.array(pairs), 4)
            assert abs(sum(n for *_, n in found) - brute_tiling(item, doc, 4)) <= 3  # ties may fall differently
            assert all(item[i : i + n] == doc[d : d + n] for i, d, n in found)
            assert len({x for i, _, n in found for x in range(i, i + n)}) == sum(n for *_, n in found)


def test_reordered_passages_are_found(spark, odd, none):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    turned = " ".join(item[6:] + ["and"] + item[:6]).title()
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, f"Before. {turned}! After."), (2, " ".join(item[:4]) + " alone"), (3, None), (4, ""), (1, f"Before. {turned}! After.")],
        "doc_id long, text string",
    ).withColumn("item", F.lit(0))
    rows = decontamination.leaked_documents(docs, benchmark).collect()
    assert [(r.doc_id, r.item_id, r.matched_words, len(r.tiles)) for r in rows] == [(1, 1, 12, 2)]
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, benchmark).collect()) == [2, 3, 4]
    assert decontamination.without_leaks(odd, benchmark).count() == odd.count()
    assert decontamination.leaked_documents(none, benchmark).count() == 0
    assert decontamination.leaked_documents(docs, benchmark.limit(0)).count() == 0


def test_whole_items_are_found(spark):
    benchmark = spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()
    flat = lambda t: " ".join(decontamination.words_of(t))
    docs = {r.doc_id: flat(r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    want = {(d, b.item_id) for b in benchmark for d, t in docs.items() if f" {flat(b.text)} " in f" {t} "}
    assert {(r.doc_id, r.item_id) for r in queries_models.op5_string_tiling(spark, LARGER).collect()} >= want


# --- language model ---------------------------------------------------------------------
def test_language_model(spark, odd, none):
    rows = queries_models.op6_log_bilinear(spark, LARGER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        mine = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(counts[w] > 0 for w in mine), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine), rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    strange = language_model.score_documents(odd, F.lit(True)).collect()
    assert len(strange) == odd.count() and all(r.score <= 0 for r in strange)
    assert language_model.score_documents(none, F.lit(True)).count() == 0
    assert language_model.score_documents(odd, F.lit(False)).count() == odd.count()


def test_probabilities_are_normalised():
    words = [language_model.END, *(f"w{i}".encode() for i in range(999))]
    totals = np.random.default_rng(0).uniform(1, 9, language_model.FREQUENT + language_model.SUFFIXES + 1)
    vocabulary = language_model.Vocabulary(words, np.arange(1000, 0, -1), {}, totals, 500_500, 1000)
    model = language_model.LogBilinear.start(vocabulary)
    draw = np.random.default_rng(5)
    before = draw.integers(0, 50, 20_000)
    after = (before * 7 + 3) % 50  # the next class follows from the one before
    trainer = language_model.Trainer(model, totals / totals.sum(), 1)
    for _ in range(60):
        trainer.step(before, np.roll(before, 1), after)
    table = trainer.m.log_probabilities(np.arange(50), np.arange(50))
    assert np.allclose(np.exp(table).sum(axis=1), 1, atol=1e-4)
    assert table[np.arange(50), (np.arange(50) * 7 + 3) % 50].mean() > np.log(0.2)


def test_sums_of_products_are_those_of_scores():
    totals = np.random.default_rng(0).uniform(1, 9, language_model.FREQUENT + language_model.SUFFIXES + 1)
    vocabulary = language_model.Vocabulary([], np.empty(0), {}, totals, 500, 100)
    model = language_model.LogBilinear.start(vocabulary)
    draw = np.random.default_rng(3)
    ones, twos = (draw.normal(0, 4, (90, language_model.WIDTH)).astype(np.float32) for _ in range(2))
    ones[:5] *= 200  # far beyond what a product of exps can hold
    a, b = draw.integers(0, 90, 5000), draw.integers(0, 90, 5000)
    scores = (ones[a] + twos[b]).astype(np.float64) @ model.target.T + model.bias
    top = scores.max(axis=1)
    want = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
    assert np.allclose(model.log_class_sums(ones, twos, a, b), want, rtol=1e-4, atol=1e-4)


def test_words_of_arrow_texts():
    texts = ["", " ", "One\ttwo\x0b\x0cTHREE \r\n", "a\x1cb \u00c4\u00e4 \u00a0 \u2003x", "\n" * 3, "end"]
    sizes, words = language_model.split_words(pa.array(texts))
    want = [t.encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and words.to_pylist() == [w for ws in want for w in ws]


def test_trainers_are_not_the_shuffle_partitions(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    plain = DataFrame.repartition
    monkeypatch.setattr(type(docs), "repartition", lambda df, n, *by: plain(df, max(n, 60) if by else n, *by))
    rounds = [language_model.deal(docs, 16, low, high) for low, high in language_model.ROUNDS]
    assert [d.rdd.getNumPartitions() for d in rounds] == [16] * 3
    assert sum(d.count() for d in rounds) == 2000
    assert all(len(set(d.rdd.glom().map(len).collect())) > 1 and 0 not in d.rdd.glom().map(len).collect() for d in rounds)


def test_words_beyond_the_frequent_are_learned(spark):
    draw = random.Random(7)
    lines = [f"f{i} " * 120 for i in range(500)] + [f"w{i}ab v{i}cd" for i in range(40) for _ in range(60)] + ["once"]
    draw.shuffle(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").coalesce(1)
    counts = language_model.count_words(docs)
    words = language_model.vocabulary(counts)
    assert words.own == 501 + 80 - language_model.FREQUENT  # with the end; "once" is too rare
    words.prepare()
    at = {w: i for i, w in enumerate(words.words)}
    asked = np.array([words.n_classes + 1 + at[f"w{i}ab".encode()] - language_model.FREQUENT for i in range(40)])
    cls, own = words.parted(asked)
    opening = np.full(40, words.n_classes)
    right = np.array([at[f"v{i}cd".encode()] - language_model.FREQUENT for i in range(40)])
    target = np.full(40, words.suffix(b"cd"))
    trainer = language_model.Trainer(language_model.LogBilinear.start(words), words.totals / words.totals.sum(), 1, words.inside)
    for _ in range(200):
        trainer.step(cls, opening, target, own, np.full(40, -1), right)
    model = trainer.m
    r = model.vectors(cls, opening, own, np.full(40, -1))
    inside = np.zeros(language_model.SUFFIXES + 1)
    leaves = np.arange(words.own + language_model.SUFFIXES + 1)
    of = np.concatenate([words.classes[language_model.FREQUENT : language_model.FREQUENT + words.own] - language_model.FREQUENT, np.arange(len(inside))])
    np.add.at(inside, of, np.exp(model.log_leaves(np.repeat(r[:1], len(leaves), axis=0), leaves, words.inside)))
    assert np.allclose(inside, 1, atol=1e-4)  # every class is shared out whole
    better = model.log_leaves(r, right, words.inside) - model.log_leaves(r, np.roll(right, 1), words.inside)
    assert (better > 0).mean() > 0.9  # one suffix, equal counts: told apart by their own vectors
    trained = language_model.train(docs, words)
    assert np.isfinite(trained.rows).all() and (trained.rows[own] != language_model.LogBilinear.start(words).rows[own]).any(axis=1).all()


def test_frames_are_plain():
    assert isinstance(next(toxicity._features(toxicity.Detector({}, {}, toxicity.CharModel()))(iter([pd.DataFrame({"label": [1], "text": [""]})]))), pd.DataFrame)
