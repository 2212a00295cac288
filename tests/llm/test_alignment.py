"""Groups, links and counts against plain Python."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusloom.llm import alignment
from corpusloom.llm.queries_groups import op13_diagonal_alignment, tokenizer_files

from .conftest import FOLDER


@pytest.fixture(scope="module")
def plain_tokens():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def tokens(text):
        """((ids, bytes of each token) of both sides), or None without tokens."""
        if not text:
            return None
        whole = " " + text
        found = first.encode(whole, add_special_tokens=False)
        a = [whole.encode()[x:y] for x, y in byte_ranges(whole, found)]
        b = []
        for i in (ids_b := second.encode(text)):
            piece = second.id_to_piece(i)
            b.append(bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode())
        if b"".join(a) != whole.encode() or b"".join(b) != whole.encode():
            return None
        return (found.ids, a), (ids_b, b)

    letters = {c: i for i, c in enumerate(bytes_to_letters())}

    def byte_ranges(whole, found):
        at = 0
        for token in found.tokens:
            assert all(c in letters for c in token)
            yield at, at + len(token)  # one letter of a byte-level token stands for one byte
            at += len(token)

    return tokens


def bytes_to_letters():
    keep = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    out, more = [], 0
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(256 + more))
            more += 1
    return out


def plain_rows(rows, tokens):
    """Rows as the query gives them."""
    groups_of, held = [], Counter()
    for _, text in rows:
        found = tokens(text)
        groups = []
        if found:
            (ids_a, a), (ids_b, b) = found
            ends_a, ends_b = np.cumsum([*map(len, a)]).tolist(), np.cumsum([*map(len, b)]).tolist()
            cuts = sorted(set(ends_a) & set(ends_b))
            groups = [([], []) for _ in cuts]
            for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
                for i, end in zip(ids, ends):
                    groups[bisect_left(cuts, end)][side].append(i)
        groups_of.append(groups)
        held.update({(x, y) for g in groups for x in g[0] for y in g[1]})
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc, _), groups in zip(rows, groups_of):
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        said = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((
            doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
            sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else "",
        ))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def same(got, want):
    return sorted(map(str, got)) == sorted(map(str, want))


def test_query_equals_brute_force(spark, plain_tokens, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("length(text) < 3000")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = op13_diagonal_alignment(spark, str(tmp_path))
    assert got.columns == [*COLUMNS, "groups_sha256"]
    assert same([tuple(r) for r in got.collect()], plain_rows(rows, plain_tokens))


ODD = [
    "a▁b", "<s> </s> <0x41> <|endoftext|>", "日本語のテキスト 你好", "🤖🤖 emoji 🇩🇪", "tab\tnew\n\n\nline\r\n", "\x00\x01", "=" * 3000, "naïve façade",
    "   lead and trail   ", "x", "🤖" * 400,
]


@pytest.mark.parametrize("most", [1 << 20, 5, 0])
def test_odd_rows_and_rare_pairs(spark, odd, none, plain_tokens, most):
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    docs = odd.withColumn("text", F.substring("text", 1, 4000)).unionByName(more, allowMissingColumns=True)
    docs = docs.withColumn("links", F.lit("x")).withColumn("groups", F.lit("y"))
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = alignment.aligned_documents(docs, tokenizer_files(), keep_groups=False, most=most)
    want = plain_rows(rows, plain_tokens)
    assert same([tuple(r) for r in got.collect()], want)
    assert [w[1] for w in want if w[0] == 100] == [0]  # U+2581 does not come back as itself
    assert not alignment.aligned_documents(none, tokenizer_files(), most=most).collect()


def test_groups_are_the_common_ends():
    rng = random.Random(2)
    for _ in range(400):
        last = rng.randint(1, 120)
        share = rng.choice((0.1, 0.5, 0.95))
        a, b = ([e for e in range(1, last) if rng.random() < share] + [last] for _ in range(2))
        if rng.random() < 0.3:
            b = a[: rng.randint(0, len(a))] + [e for e in a if e == last]
            b = sorted(set(b))
        ends_a, ends_b = alignment.group_ends(a, b)
        assert [a[i - 1] for i in ends_a] == [b[j - 1] for j in ends_b] == sorted(set(a) & set(b))


def test_wide_groups_count_like_narrow_ones(monkeypatch):
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 9, 300).astype("<u4"), rng.integers(0, 5, 260).astype("<u4")
    ends_a, ends_b = np.array([1, 40, 41, 300]), np.array([3, 4, 200, 260])
    narrow = alignment.linked_pairs(a, b, ends_a, ends_b)
    monkeypatch.setattr(alignment, "WIDE", 10)
    wide = alignment.linked_pairs(a, b, ends_a, ends_b)
    assert all((x == y).all() for x, y in zip(narrow, wide))
    assert narrow[1].sum() == 1 * 3 + 39 * 1 + 1 * 196 + 259 * 60


def test_groups_are_kept_as_text(spark):
    docs = spark.createDataFrame([("k", "plain words here"), (None, None)], "name string, body string")
    got = {r.doc_id: r for r in alignment.aligned_documents(docs, tokenizer_files(), key="name", text="body").collect()}
    assert got["k"].groups.count("|") == got["k"].n_groups > 0 and got[None].groups == ""


def test_frequent_floor(spark):
    pairs = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [40] * 5 + [900])], "a int, n long")
    kept = lambda most: sum(n >= alignment.frequent_floor(pairs, most) for n in [1] * 50 + [2] * 20 + [40] * 5 + [900])
    assert [kept(m) for m in (0, 1, 6, 30, 76)] == [0, 1, 6, 26, 76]
    assert alignment.frequent_floor(pairs.limit(0), 10) == 1
