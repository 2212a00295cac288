"""Harmonic packing against the tokenizer itself."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm.packing import Packer, _Bins, pack
from corpusloom.llm.queries_models import packer
from corpusloom.llm.tokens import encoder

from .conftest import FOLDER


@pytest.fixture(scope="module")
def plain():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


def check(rows, texts, plain, capacity=2048):
    """Every id in exactly one piece, sequences without gaps; returns the share of padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        want = [*plain.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        copies = len(pieces) * 0 + sum(p.start == 0 for p in pieces)
        pieces = sorted(pieces, key=lambda p: p.start)
        got = [i for p in pieces[::copies] for i in np.frombuffer(p.ids, "<u4").tolist()]
        assert got == want and all(p.doc_tokens == len(want) for p in pieces)
    padding = used = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length
            at += p.length
        assert at <= capacity
        used += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / used


def test_documents(spark, plain):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for parts in (1, 7):
        assert check(pack(docs.repartition(parts), packer()).collect(), texts, plain) < 0.03


def test_odd_rows(odd, none, plain):
    texts = {r.doc_id: r.text for r in odd.collect()}
    check(pack(odd, packer()).collect(), texts, plain)
    assert pack(none, packer()).count() == 0


def test_large_ids_beside_nulls(spark):
    docs = spark.createDataFrame([(2**60 + 1, "a"), (None, "b")], "doc_id long, text string")
    assert {r.doc_id for r in pack(docs, packer()).collect()} == {2**60 + 1, None}


@pytest.mark.parametrize("tokens", [1, 127, 128, 129, 1024, 1500, 2047, 2048, 2049, 10_000])
def test_cuts(tokens):
    lengths = Packer("").cuts(tokens)
    assert sum(lengths) == tokens and max(lengths) <= 2048 and all(n > 0 for n in lengths)
    fixed = [n for n in lengths if n > 128]
    assert all(n == 2048 // (2048 // n) for n in fixed)


def test_bins_hold_a_fixed_count():
    bins = _Bins(2048, 0)
    full = [p for i in range(100) for p in bins.add(("d", 0, 400, 400, b""))]
    assert len(full) == 100 and max(p[-1] for p in full) == 4 * 400


def test_encoders_agree(plain):
    both = encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ("a  b", "it's 's", "\n\n x \t y ", "<|endoftext|>", "é à 1234 --- ñ", "русский", "x 你好", "a\xa0b", "\x85 z"):
        assert both.encode([text])[0].tolist() == plain.encode(text, add_special_tokens=False).ids
