"""Alignment of two tokenizers' tokens on the same texts, by diagonal run skipping.

1. Workers encode each text with both tokenizers and compare the arrays of token ends (byte offsets).
   While tokens correspond one to one, the index shift between the arrays is constant: stretches of
   doubling length are compared at that shift, and the last one is halved down to the first
   difference. There a small merge of the two arrays finds the next common end, which closes an
   irregular group and sets the new shift. All counts of a document follow from the ends of its
   groups; the linked id pairs of a document are kept once each, with their number, beside its row.
2. The documents that hold a pair are counted corpus-wide by a shuffle on the pair.
3. The most frequent pairs, at most `FREQUENT` of them, and the highest count of each id of the first
   vocabulary are broadcast, and the stored pairs of each row are looked up where they lie. Only
   rarer pairs are shuffled, to an exact join with their counts.

Token ids of both sides fit 32 bits; a pair is one 64-bit number.

Defined cases: null and empty texts, and texts that one of the tokenizers does not give back byte
by byte, have no tokens: counts of zero and an empty group text. Repeated rows count as documents
of their own. A null document id is kept. An empty table gives no rows. Groups of many tokens on
both sides are expanded by distinct ids. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..settings import materialise

FREQUENT = 1 << 20  # pairs broadcast at most (some 40 MB)
WIDE = 1 << 14  # links of a group from which its ids are made distinct first


class Side:
    """A tokenizer in a worker: ids of texts that start with a space; of each id its bytes, their number and its digits."""

    def __init__(self, encode: Callable[[Sequence[str]], list[np.ndarray]], pieces: list[bytes]) -> None:
        self.encode = encode
        self.pieces = np.array([*pieces, None], object)[:-1]  # an array of objects, whatever the lengths
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.digits = np.array([*map(str, range(len(pieces))), None], object)[:-1]


class Tokenizers(NamedTuple):
    """Where the two vocabularies lie; `ranks` and `pattern` as in `tokens`."""

    bytes_bpe: str
    pieces: str
    ranks: str | None = None
    pattern: str | None = None


_LOADED: dict[Tokenizers, tuple[Side, Side]] = {}


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stay, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def sides(files: Tokenizers) -> tuple[Side, Side]:
    """The worker's tokenizers for these files."""
    if files not in _LOADED:
        import sentencepiece

        from .tokens import encoder

        first = encoder(files.bytes_bpe, files.ranks, files.pattern)
        letter = _byte_letters()
        spelled = {i: token for token, i in first.tokenizer.get_vocab().items()}
        table = [
            bytes(map(letter.__getitem__, spelled[i])) if set(spelled[i]) <= letter.keys() else spelled[i].encode()
            for i in range(max(spelled) + 1)
        ]
        second = sentencepiece.SentencePieceProcessor(model_file=files.pieces)
        named = [second.id_to_piece(i) for i in range(second.get_piece_size())]
        parts = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(named)]
        _LOADED[files] = (
            Side(lambda texts: first.encode([" " + t for t in texts]), table),
            Side(lambda texts: [np.asarray(ids, "<u4") for ids in second.encode(list(texts), num_threads=1)], parts),
        )
    return _LOADED[files]


def group_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes just after each group in two increasing lists of token ends with the same last value."""
    first_a: list[int] = []  # runs of groups: ends of the first one, and how many follow one to one
    first_b: list[int] = []
    widths: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n:
        if a[i] == b[j]:  # a one-to-one stretch at the shift j - i
            width = 2
            while i + width <= n and a[i : i + width] == b[j : j + width]:
                width *= 2
            good, bad = width // 2, min(width, n - i + 1, m - j + 1)
            while bad - good > 1:  # the stretch holds `good` equal ends and not `bad`
                half = (good + bad) // 2
                if a[i + good : i + half] == b[j + good : j + half]:
                    good = half
                else:
                    bad = half
            first_a.append(i + 1)
            first_b.append(j + 1)
            widths.append(good)
            i += good
            j += good
        else:
            x, y = a[i], b[j]
            while x != y:  # the side behind takes its next token
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i += 1
            j += 1
            first_a.append(i)
            first_b.append(j)
            widths.append(1)
    width = np.array(widths, np.int64)
    step = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
    return np.repeat(np.array(first_a), width) + step, np.repeat(np.array(first_b), width) + step


def linked_pairs(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, links) of one document: its distinct linked id pairs in order, and how often each occurs."""
    low_a, low_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    n_a, n_b = ends_a - low_a, ends_b - low_b
    high, low = ids_a.astype(np.int64) << 32, ids_b.astype(np.int64)
    plain = n_a * n_b <= WIDE
    # Every first token of a narrow group is repeated for each second token of its group.
    token_group = np.repeat(np.arange(len(n_a)), n_a)
    kept = np.flatnonzero(plain[token_group])
    times = n_b[token_group[kept]]
    at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low_b[token_group[kept]], times)
    pairs = [np.repeat(high[kept], times) | low[at]]
    counts = [np.ones(len(pairs[0]), np.int64)]
    for g in np.flatnonzero(~plain):
        a, often_a = np.unique(high[low_a[g] : ends_a[g]], return_counts=True)
        b, often_b = np.unique(low[low_b[g] : ends_b[g]], return_counts=True)
        pairs.append((a[:, None] | b).ravel())
        counts.append((often_a[:, None] * often_b).ravel())
    pair, many = np.concatenate(pairs), np.concatenate(counts)
    order = np.argsort(pair, kind="stable")
    pair, many = pair[order], many[order]
    head = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    return pair[head], np.add.reduceat(many, head)


def groups_text(digits_a: np.ndarray, digits_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group in order."""
    said = digits_a[ends_a - 1] + "|" + digits_b[ends_b - 1]
    low_a, low_b = np.concatenate(([0], ends_a[:-1])), np.concatenate(([0], ends_b[:-1]))
    wide = np.flatnonzero((ends_a - low_a > 1) | (ends_b - low_b > 1))
    cuts = zip(wide.tolist(), low_a[wide].tolist(), ends_a[wide].tolist(), low_b[wide].tolist(), ends_b[wide].tolist())
    a, b = digits_a.tolist(), digits_b.tolist()
    for g, i, to_i, j, to_j in cuts:
        said[g] = f"{','.join(a[i:to_i])}|{','.join(b[j:to_j])}"
    return ";".join(said.tolist())


class Aligned(NamedTuple):
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups: str = ""
    pairs: np.ndarray = np.zeros(0, np.int64)
    links: np.ndarray = np.zeros(0, np.int64)


def align(text: str, ids_a: np.ndarray, ids_b: np.ndarray, a: Side, b: Side) -> Aligned:
    """The groups and links of one text; nothing if a side does not give its bytes back."""
    whole = b" " + text.encode("utf-8", "surrogatepass")
    if not text or any(b"".join(side.pieces[ids].tolist()) != whole for side, ids in ((a, ids_a), (b, ids_b))):
        return Aligned()
    ends_a, ends_b = group_ends(*(np.cumsum(side.sizes[ids]).tolist() for side, ids in ((a, ids_a), (b, ids_b))))
    pairs, links = linked_pairs(ids_a, ids_b, ends_a, ends_b)
    said = groups_text(a.digits[ids_a], b.digits[ids_b], ends_a, ends_b)
    return Aligned(len(ids_a), len(ids_b), len(ends_a), int(links.sum()), said, pairs, links)


_TEXTS = 64  # texts encoded at a time


def _align(files: Tokenizers, keep_groups: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = sides(files)
        for batch in batches:
            for at in range(0, len(batch), _TEXTS):
                part = batch.iloc[at : at + _TEXTS]
                texts = part["text"].to_list()
                found = [align(*one, a, b) for one in zip(texts, a.encode(texts), b.encode(texts))]
                yield pd.DataFrame(
                    {
                        "row": part["row"].array,
                        "doc_id": part["doc_id"].array,
                        "n_a": [f.n_a for f in found],
                        "n_b": [f.n_b for f in found],
                        "n_groups": [f.n_groups for f in found],
                        "n_links": [f.n_links for f in found],
                        "groups": [f.groups if keep_groups or not f.groups else hashlib.sha256(f.groups.encode()).hexdigest() for f in found],
                        "ids_a": [(f.pairs >> 32).astype(np.int32) for f in found],
                        "ids_b": [(f.pairs & 0xFFFFFFFF).astype(np.int32) for f in found],
                        "links": [f.links for f in found],
                    }
                )

    return run


ALIGNED = (
    "row long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "ids_a array<int>, ids_b array<int>, links array<long>"
)


def aligned_rows(docs: DataFrame, files: Tokenizers, key: str = "doc_id", text: str = "text", keep_groups: bool = True) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, ids_a, ids_b, links) of every row, written once.

    `groups` holds the ids of each group as text, or the text's SHA-256 without `keep_groups`; `ids_a`,
    `ids_b` and `links` are the distinct linked pairs and how often each occurs in the row.
    """
    plain = docs.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = plain.withColumn("row", F.monotonically_increasing_id()).mapInPandas(_align(files, keep_groups), ALIGNED)
    return materialise(rows.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType)), "aligned")


def held_pairs(aligned: DataFrame) -> DataFrame:
    """(row, a, b, links) of the distinct linked pairs of each row."""
    held = aligned.select("row", F.explode(F.arrays_zip("ids_a", "ids_b", "links")).alias("p"))
    return held.select("row", F.col("p.ids_a").alias("a"), F.col("p.ids_b").alias("b"), F.col("p.links").alias("links"))


def judged_pairs(held: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many rows each pair is linked, and whether no pair of `a` is linked in more."""
    pairs = materialise(held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "pairs")
    highest = pairs.groupBy("a").agg(F.max("n").alias("top"))  # as many rows as the first vocabulary has ids
    return materialise(pairs.join(F.broadcast(highest), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best")), "judged")


def frequent_floor(pairs: DataFrame, most: int) -> int:
    """The least count from which at most `most` pairs remain."""
    eighth = F.floor(F.log2("n") * 8)
    steps = pairs.groupBy(eighth.alias("step")).agg(F.count(F.lit(1)).alias("pairs"), F.max("n").alias("top")).orderBy(F.desc("step")).collect()
    floor, total = (steps[0].top + 1 if steps else 1), 0
    for step, below in zip(steps, [*steps[1:], None]):
        total += step.pairs
        if total > most:
            break
        floor = below.top + 1 if below else 1
    return floor


def aligned_documents(
    docs: DataFrame, files: Tokenizers, key: str = "doc_id", text: str = "text", keep_groups: bool = True, most: int = FREQUENT
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row.

    The count of an id pair is the number of rows it is linked in. `count_sum` adds the counts of
    all links, `n_best` counts the links whose count is the highest of their first id.
    """
    aligned = aligned_rows(docs, files, key, text, keep_groups)
    held = held_pairs(aligned)
    judged = judged_pairs(held)
    floor = frequent_floor(judged, most)
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum")]
    common, rare = F.broadcast(judged.filter(F.col("n") >= floor)), judged.filter(F.col("n") < floor)
    totals = held.join(common, ["a", "b"]).groupBy("row").agg(*sums)
    if floor > 1:
        seldom = held.join(common.select("a", "b"), ["a", "b"], "left_anti").join(rare, ["a", "b"]).groupBy("row").agg(*sums)
        totals = totals.unionByName(seldom).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    known = aligned.drop("ids_a", "ids_b", "links").join(totals, "row", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return known.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *counts, "groups")
