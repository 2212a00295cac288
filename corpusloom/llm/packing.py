"""Harmonic packing of documents into token sequences of a fixed capacity.

Class k holds pieces of more than capacity / (k + 1) and at most capacity / k tokens, so k of them
always fit into one sequence. A document is cut into pieces of exactly capacity / 1 tokens, then
capacity / 2, … until what is left is short (`FINE`): cut pieces fill their class without padding,
and a rest of s tokens wastes at most s * s / capacity. Every worker fills the bins of each class
with k pieces on its own and sets the pieces of its open bins aside. These are gathered by ever
fewer workers in the same way; the last one has less than one bin a class and closes it with
first-fit decreasing.

Defined cases: a null or empty text is the end token alone, repeated rows are packed each, an
empty table gives no rows, extra columns are left alone. Memory is that of one batch and of one
open bin for each class, however long a text is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..settings import materialise

FINE = 16  # pieces of this class and above are not cut further
GATHER = 64  # workers whose open bins meet in one worker of the next round
_OPEN = -1  # sequence of a piece that waits for the next round
_SCHEMA = "doc_id string, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


@dataclass(frozen=True)
class Packer:
    """Tokenizer files and the shape of the sequences."""

    tokenizer: str
    ranks: str | None = None
    pattern: str | None = None
    capacity: int = 2048
    end_id: int = 1

    def cuts(self, tokens: int) -> list[int]:
        """Lengths of the pieces of a document."""
        lengths = [self.capacity] * (tokens // self.capacity)
        rest = tokens % self.capacity
        while rest and self.capacity // rest < FINE:
            size = self.capacity // -(-self.capacity // rest)
            lengths.append(size)
            rest -= size
        return [*lengths, rest] if rest else lengths


class _Bins:
    """Open bins of one worker; full ones are handed out at once."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = defaultdict(list)

    def add(self, piece: tuple) -> list[tuple]:
        length = piece[2]
        count = self.capacity // length
        waiting = self.open[count]
        waiting.append(piece)
        return self.close(self.open.pop(count)) if len(waiting) == count else []

    def close(self, pieces: list[tuple]) -> list[tuple]:
        sequence, at, placed = self.next_id, 0, []
        self.next_id += 1
        for piece in pieces:
            placed.append((*piece, sequence, at))
            at += piece[2]
        return placed

    def rest(self) -> list[tuple]:
        return [piece for waiting in self.open.values() for piece in waiting]

    def first_fit(self) -> list[tuple]:
        """Close the remaining pieces, the longest first, each into the first bin with room."""
        bins: list[list[tuple]] = []
        room: list[int] = []
        for piece in sorted(self.rest(), key=lambda p: -p[2]):
            fit = next((i for i, left in enumerate(room) if left >= piece[2]), None)
            if fit is None:
                bins.append([])
                room.append(self.capacity)
                fit = len(bins) - 1
            bins[fit].append(piece)
            room[fit] -= piece[2]
        return [placed for pieces in bins for placed in self.close(pieces)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[part.split()[0] for part in _SCHEMA.split(", ")])


def _first_id(round_: int) -> int:
    """Sequence numbers of different rounds and workers never meet."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (round_ << 56) + ((context.partitionId() if context else 0) << 32)


def _pieces(packer: Packer, batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    from .tokens import encoder

    coder = encoder(packer.tokenizer, packer.ranks, packer.pattern)
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            ids = np.append(coder.encode([text])[0], np.uint32(packer.end_id)).astype("<u4", copy=False)
            start = 0
            for length in packer.cuts(len(ids)):
                yield (doc_id, start, length, len(ids), ids[start : start + length].tobytes())
                start += length


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield (row.doc_id, row.start, row.length, row.doc_tokens, row.ids)


def _fill(packer: Packer, round_: int, last: bool):
    """A worker of a round: fill bins, then hand on or close what is left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = _Bins(packer.capacity, _first_id(round_))
        done: list[tuple] = []
        size = 0
        for piece in _stored(batches) if round_ else _pieces(packer, batches):
            done += (full := bins.add(piece))
            size += sum(p[2] for p in full)
            if size > 1 << 20:
                yield _frame(done)
                done, size = [], 0
        done += bins.first_fit() if last else [(*piece, _OPEN, 0) for piece in bins.rest()]
        if done:
            yield _frame(done)

    return run


def pack(docs: DataFrame, packer: Packer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): one row per piece.

    `ids` are the piece's token ids as little-endian unsigned 32-bit numbers; `start` counts the
    document's ids before it, `offset` those of the sequence before it. Each round is written to
    the shared folder, so a lost worker repeats its own part only.
    """
    rows = docs.select(F.col(key).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    workers = rows.rdd.getNumPartitions()
    sealed: DataFrame | None = None
    round_ = 0
    while True:
        last = round_ > 0 and workers == 1
        done = materialise(rows.mapInPandas(_fill(packer, round_, last), _SCHEMA), f"packed{round_}")
        placed = done.filter(F.col("sequence_id") != _OPEN)
        sealed = placed if sealed is None else sealed.unionByName(placed)
        if last:
            return sealed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[key].dataType))
        workers = max(1, workers // GATHER)
        rows = done.filter(F.col("sequence_id") == _OPEN).coalesce(workers)
        round_ += 1
