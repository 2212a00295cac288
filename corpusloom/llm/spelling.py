"""Groups of spelling variants in the vocabulary of a corpus, by Bloom-guided neighbourhoods.

1. Workers count the words of whole texts; counts meet by a shuffle on the word.
2. Every word of the vocabulary sets eight bits in one block of a blocked Bloom filter. The filter
   is sharded by length: each length owns a run of blocks in proportion to its words, so a
   candidate is tested against words of its own length only.
3. Each word generates its edits inside a task, as numbers: hashes of edited words follow from
   sums over the word, so no edited word is spelled out before the filter has passed it. Of two
   words that differ by one replaced letter, the one with the lower letter generates the other; an
   insertion is the deletion of the longer word. So every near pair comes from one of its words.
4. Only edits that the filter passes are shuffled, to an exact join with the vocabulary that
   removes the false ones.
5. Forms are the best near words; roots follow by doubling joins over the words that have a form.

The filter is sized by the counted words, `BITS` for each. It is broadcast in slices of `SLICE`
bits, one pass over the words of the lengths concerned for each slice, so neither the broadcast nor
the share of false passes grows with the vocabulary.

Defined cases: null and empty texts have no words; a null document id counts as an empty one;
repeated rows count again; an empty table gives no rows; very long words work like others (their
edits are generated in blocks of positions); other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from ..settings import materialise
from .shingles import mix

# --- fixed values: what a word is ------------------------------------------------------
LETTERS = "a-zÀ-ÿ"  # once A to Z are lower-cased
MIN_LENGTH = 6
MIN_COUNT = 5
FORM_RATIO = 5
# ---------------------------------------------------------------------------------------
BITS = 16  # of the filter for each word
LANES = 8  # 64-bit lanes of a block; a word sets one bit in each
SLICE = 1 << 28  # bits broadcast at a time (32 MB)
EDITS = 1 << 18  # edits generated at a time
TASK_WORDS = 1 << 13  # words a task generates edits for
_WORDS = 1 << 18  # words a task counts before it passes them on
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _counts(min_length: int, drop_every: int | None):
    word = re.compile(f"[{LETTERS}]{{{min_length},}}")

    def of(key: str, text: str) -> Iterator[tuple[str, int]]:
        for run, n in Counter(word.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
            if drop_every:
                h = zlib.crc32(f"{key}:{run}".encode())
                if h % drop_every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < min_length:
                        continue
            yield run, n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: Counter[str] = Counter()
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"]):
                for found, n in of(key, text):
                    known[found] += n
                if len(known) > _WORDS:
                    yield pd.DataFrame({"word": list(known), "n": list(known.values())})
                    known.clear()
        if known:
            yield pd.DataFrame({"word": list(known), "n": list(known.values())})

    return run


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    drop_every: int | None = None,
) -> DataFrame:
    """(word, n): maximal runs of Latin letters of at least `min_length`, seen at least `min_count` times.

    With `drop_every`, runs whose crc32 with their document's id it divides lose one letter, as typing errors would.
    """
    plain = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counted = plain.mapInPandas(_counts(min_length, drop_every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class Shards:
    """Where the words of each length lie in the filter: first block and number of blocks."""

    def __init__(self, sizes: dict[int, int], bits: int = BITS) -> None:
        self.first, self.blocks, self.total = {}, {}, 0
        for length in sorted(sizes):
            self.first[length] = self.total
            self.blocks[length] = -(-sizes[length] * bits // (64 * LANES))
            self.total += self.blocks[length]

    def block(self, hashes: np.ndarray, length: int) -> np.ndarray:
        return (mix(hashes) % np.uint64(self.blocks[length])).astype(np.int64) + self.first[length]

    def lengths(self, low: int, high: int) -> list[int]:
        """Lengths with blocks in the slice."""
        return [n for n, first in self.first.items() if first < high and first + self.blocks[n] > low]


def _lane_bits(hashes: np.ndarray, lane: int) -> np.ndarray:
    """The bit of a lane, from other bits of the hash than its block."""
    return np.uint64(1) << ((mix(hashes ^ np.uint64(_INVERSE)) >> np.uint64(6 * lane)) & np.uint64(63))


def _powers(n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(_BASE))
    steps[0] = 1
    return np.cumprod(steps)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, one row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _by_length(words: pd.Series, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions) of bounded groups of words of one length."""
    lengths = words.map(len).to_numpy()
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        step = max(1, most // length)
        for i in range(0, len(at), step):
            yield length, at[i : i + step]


def _bits_of(shards: Shards):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for length, at in _by_length(batch["word"], EDITS):
                hashes = letters(batch["word"].iloc[at].to_list()) @ _powers(length)
                block = shards.block(hashes, length)
                for lane in range(LANES):
                    slots.append(block * LANES + lane)
                    bits.append(_lane_bits(hashes, lane))
            slot, where = np.unique(np.concatenate(slots), return_inverse=True)
            joined = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(joined, where, np.concatenate(bits))
            yield pd.DataFrame({"slot": slot, "bits": joined.view(np.int64)})

    return run


def _replaced(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, new letter, hash) of replacements by a higher letter, in blocks of positions."""
    rows, length = codes.shape
    powers = _powers(length)
    whole = codes @ powers
    step = max(1, EDITS // max(1, rows * len(alphabet)))
    for a in range(0, length, step):
        old = codes[:, a : a + step, None]
        row, place, letter = np.nonzero(alphabet > old)
        change = (alphabet[letter] - codes[row, a + place]) * powers[a + place]
        yield row, a + place, alphabet[letter], whole[row] + change


def _shortened(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of deletions; of equal letters in a row only the first is deleted."""
    rows, length = codes.shape
    parts = codes * _powers(length)
    before = np.cumsum(parts, axis=1) - parts
    after = before[:, -1:] + parts[:, -1:] - before - parts
    hashes = before + after * np.uint64(_INVERSE)
    first = np.ones(codes.shape, bool)
    first[:, 1:] = codes[:, 1:] != codes[:, :-1]
    row, place = np.nonzero(first)
    return row, place, hashes[row, place]


def _edits(shards: Shards, alphabet: np.ndarray, filter_: Broadcast, low: int):
    def passed(hashes: np.ndarray, length: int) -> np.ndarray:
        """Positions of the hashes whose bits are all set in this slice; most fall at the first lane."""
        block = shards.block(hashes, length) - low
        left = np.flatnonzero((block >= 0) & (block < len(filter_.value) // LANES))
        for lane in range(LANES):
            left = left[(filter_.value[block[left] * LANES + lane] & _lane_bits(hashes[left], lane)) != 0]
        return left

    high = low + SLICE // (64 * LANES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = set(shards.lengths(low, high))
        for batch in batches:
            words, at_word, near = batch["word"], [], []
            for length, at in _by_length(words, EDITS):
                if length not in asked and length - 1 not in asked:
                    continue
                codes = letters(words.iloc[at].to_list())
                if length in asked:
                    for row, place, letter, hashes in _replaced(codes, alphabet):
                        for i in passed(hashes, length).tolist():
                            word = words.iat[at[row[i]]]
                            at_word.append(at[row[i]])
                            near.append(f"{word[: place[i]]}{chr(letter[i])}{word[place[i] + 1 :]}")
                if length - 1 in asked:
                    row, place, hashes = _shortened(codes)
                    for i in passed(hashes, length - 1).tolist():
                        word = words.iat[at[row[i]]]
                        at_word.append(at[row[i]])
                        near.append(word[: place[i]] + word[place[i] + 1 :])
            if near:
                yield batch[["word", "n"]].iloc[at_word].reset_index(drop=True).assign(near=near)

    return run


def near_pairs(words: DataFrame, bits: int = BITS) -> DataFrame:
    """(word, n, near, near_n): each two words of (word, n) that differ by one edit, once."""
    session = words.sparkSession
    length = F.length("word")
    facts = words.groupBy(length.alias("length")).agg(F.count(F.lit(1)).alias("words")).collect()
    shards = Shards({r.length: r.words for r in facts if r.length}, bits)
    dealt = words.repartition(max(1, -(-sum(r.words for r in facts) // TASK_WORDS)), "word")
    used = words.select(F.explode(F.array_distinct(F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0)))).alias("c")).distinct()
    alphabet = np.array(sorted(ord(r.c) for r in used.collect()), np.uint64)  # as many as there are letters
    bitmap = words.select("word").mapInPandas(_bits_of(shards), "slot long, bits long")
    bitmap = materialise(bitmap.groupBy("slot").agg(F.bit_or("bits").alias("bits")), "bloom")
    found = None
    for low in range(0, max(1, shards.total), SLICE // (64 * LANES)):
        high = min(shards.total, low + SLICE // (64 * LANES))
        set_ = bitmap.filter(F.col("slot").between(low * LANES, high * LANES - 1)).toPandas()
        lanes = np.zeros((high - low) * LANES, np.int64)
        lanes[set_["slot"].to_numpy(np.int64) - low * LANES] = set_["bits"].to_numpy(np.int64)
        shared = session.sparkContext.broadcast(lanes.view(np.uint64))
        near = dealt.filter(length.isin(*{n + more for n in shards.lengths(low, high) for more in (0, 1)}) if shards.total else F.lit(False))
        part = near.mapInPandas(_edits(shards, alphabet, shared, low), "word string, n long, near string")
        found = part if found is None else found.unionByName(part)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(known, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where following forms from word to word ends."""
    reached = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = materialise(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reached = stepped.select("word", "root")
        if stepped.filter("moved").isEmpty():
            return reached


def spelling_groups(words: DataFrame, ratio: int = FORM_RATIO, bits: int = BITS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    `form` is the near word seen most often (ties: the lowest), if it is seen at least `ratio` times as often.
    """
    words = materialise(words, "vocabulary")
    pairs = materialise(near_pairs(words, bits), "near")
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near"))
    around = pairs.unionByName(back).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = F.col("best.near_n") >= F.col("n") * ratio
    around = materialise(
        around.select("word", "n_near", F.when(strong, F.col("best.near")).alias("form"), F.when(strong, F.col("best.near_n")).alias("form_n")), "forms"
    )
    followed = roots(around.filter("form is not null").select("word", "form"))
    placed = words.join(around, "word", "left").join(followed, "word", "left")
    return placed.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
