"""Log-bilinear language model with noise-contrastive training, and a unigram base beside it.

Words are counted over all training documents. Every word that occurs at least sqrt(tokens) /
`ROOT_PART` (and `LEAST`) times has a vector as a context and a vector and a bias as a target; their
number grows with the corpus, to `MOST_VECTORS` words. The context vector of a token is the sum of a
linear map of each of the two tokens before it, and a word scores its product with the context plus
its bias.

Probabilities are normalised over classes: the `FREQUENT` most frequent tokens are classes of their own, all
other words fall into classes by their last two bytes. Classes of many words are split by the words' checksums,
so that classes and the words in a class both number about the root of the words with vectors. The
probability of a word is that of its class, by vectors and biases of the classes, times its share among the
words of the class, by its own. One more target of each class stands for all rarer words (and those of
more than `KNOWN_BYTES` bytes); they share its probability by their counts (add 0.1).

Both levels are trained by noise-contrastive estimation: a batch shares one sample of classes and one
of words, drawn by frequency. Training reads every training document once, in `ROUNDS` of growing size.
In a round the documents are dealt by their hash to a number of trainers that grows with the root of
the tokens, so that what they send grows in proportion to the corpus, and results do not depend on
how the table is partitioned. Each trainer starts from the same parameters; these are then averaged
by tokens, those of words by the tokens that used them; a trainer sends only the rows it used.
Biases start at the log frequencies, so the model starts as the unigram model.

Scoring keeps the `KNOWN` most frequent words in memory, and more if more have vectors (a bound, not
a cut: counts of all other words are joined exactly) and normalises each distinct context of a load once. As exp
turns sums into products, each of its two words meets the classes once and a context is a product of two rows.

Defined cases: null and empty texts are the end token alone; repeated rows count and score each;
an empty training set leaves uniform classes; an empty table gives no rows; extra columns are left
alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..settings import materialise

FREQUENT, SUFFIXES = 192, 63  # classes of single tokens, and of suffixes besides the one for the rest
LEAST, ROOT_PART = 8, 64  # occurrences of a word with vectors: at least LEAST and sqrt(tokens) / ROOT_PART
MOST_VECTORS = 1 << 19  # words with vectors; with both vectors 138 MB
SPLIT = 256  # words with vectors in a class before it is split, or the root of their number
TRAINER_ROOT = 700  # trainers: one for each so many of the root of the tokens
KNOWN = 131_072  # words whose counts every task knows
KNOWN_BYTES = 32  # longer words are joined
WIDTH, NOISE, WORD_NOISE, BATCH, RATE = 32, 24, 64, 8192, 0.08
ROUNDS = ((0, 1), (1, 4), (4, 10))  # tenths of the training documents
END = b""  # no word is empty
_COUNTED, _LOAD = 12 << 20, 5 << 20  # bytes of text counted, or trained on and scored, at a time
_ROWS = 1024  # contexts normalised at a time, so that their scores stay in the cache
_BLOCK = 1024  # rows of contexts and leaves sent together
_COLUMNS, _PAIRS = 64, 2048  # classes and contexts of a product at a time
_WILD = 40  # products of exp of scores within it neither overflow nor vanish in float32


def _loads(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `size` bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(ends):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(first, last - first)
            first = last


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Number of words of each text and all words: between ASCII white space, with A-Z lowered; the ends are left out."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    words = pc.list_flatten(lists).cast(pa.binary())
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # a text without words has one empty string
    if not filled.all():
        sizes[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[~filled]] = 0
        words = words.filter(pa.array(filled))
    return sizes, words


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for load in _loads(batches, _COUNTED):
        _, words = split_words(load["text"])
        counted = pc.value_counts(words)
        yield pa.record_batch([counted.field("values"), counted.field("counts")], names=["word", "n"])
        yield pa.record_batch([pa.array([END]), pa.array([load.num_rows])], names=["word", "n"])


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, the end token included; written once."""
    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_count, "word binary, n long")
    return materialise(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")


@dataclass
class Inside:
    """The targets inside the classes that are not single tokens.

    A leaf is a word with vectors, by rank, or one of each class for its other words. Leaves of a
    class have neighbouring places.
    """

    place: np.ndarray  # of each leaf
    cls: np.ndarray  # class of each leaf, from the first class that is no single token
    starts: np.ndarray  # first place of each class, and the end
    share: np.ndarray  # of each place in all leaves

    @staticmethod
    def of(classes: np.ndarray, mass: np.ndarray, rest: np.ndarray) -> Inside:
        """`classes` and `mass` of the words, `rest` of the other words of each class."""
        cls = np.concatenate((classes, np.arange(len(rest)))).astype(np.int64)
        order = np.argsort(cls, kind="stable")
        place = np.empty(len(cls), np.int64)
        place[order] = np.arange(len(cls))
        starts = np.concatenate(([0], np.cumsum(np.bincount(cls, minlength=len(rest)))))
        whole = np.concatenate((mass, rest))[order]
        return Inside(place, cls, starts, whole / whole.sum())


@dataclass
class Vocabulary:
    """Counts of the known words, classes, and what the unigram base needs."""

    words: list[bytes]
    counts: np.ndarray
    suffixes: dict[bytes, tuple[int, int, int]]  # class, first of its further parts, number of parts
    totals: np.ndarray  # sum of (count + 0.1) by class, with the unseen word of each suffix class
    tokens: int
    distinct: int
    own: int = 0  # words beyond the FREQUENT that have vectors
    other: tuple[int, int, int] = (FREQUENT + SUFFIXES, 0, 1)  # the class of all other suffixes
    inside: Inside | None = None
    rest: np.ndarray | None = None  # sum of (count + 0.1) of the other words of each suffix class
    known: pa.Array | None = field(default=None, repr=False)
    classes: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None, "classes": None}

    @property
    def n_classes(self) -> int:
        return len(self.totals)

    def suffix(self, word: bytes) -> int:
        first, further, parts = self.suffixes.get(word[-2:], self.other)
        part = zlib.crc32(word) % parts if parts > 1 else 0
        return further + part - 1 if part else first

    def prepare(self) -> None:
        if self.known is None:
            self.known = pa.array(self.words, pa.binary())
            self.classes = np.array([i if i < FREQUENT else self.suffix(w) for i, w in enumerate(self.words)], np.int64)

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(start of each text, index of the known word or -1 and class of each token, the tokens that are not known).

        Each text is closed by the end token, which is the first of the known words if there are any.
        """
        sizes, words = split_words(texts)
        ends = np.cumsum(sizes + 1) - 1
        inner = np.ones(len(words) + len(ends), bool)
        inner[ends] = False
        found = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False)
        at = np.full(len(inner), 0 if self.words else -1, np.int64)
        at[inner] = found
        cls = self.classes.take(at) if self.words else np.full(len(at), self.suffix(END))
        rest = words.filter(pa.array(found < 0))
        cls[np.flatnonzero(inner & (at < 0))] = [self.suffix(w) for w in rest.to_pylist()]
        return ends - sizes, at, cls, rest

    def leaves(self, at: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Leaf of each token; -1 where the class is a single token."""
        own = (at >= FREQUENT) & (at < FREQUENT + self.own)
        return np.where(own, at - FREQUENT, np.where(cls >= FREQUENT, self.own + cls - FREQUENT, -1))

    def contexts(self, cls: np.ndarray, leaves: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both contexts of each token: a class, the opening, or beyond it a word with vectors."""
        ids = np.where((leaves >= 0) & (leaves < self.own), self.n_classes + 1 + leaves, cls)
        return contexts(ids, starts, self.n_classes)

    def parted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class or opening, word with vectors or -1) of contexts."""
        own = np.maximum(ids - self.n_classes - 1, -1)
        if not self.own:
            return ids, own
        return np.where(own < 0, ids, self.classes[FREQUENT + np.maximum(own, 0)]), own

    @property
    def base_log(self) -> float:
        return math.log10(self.tokens + 0.1 * (self.distinct + 1))


def _most_frequent(counts: DataFrame, needed: float = math.inf) -> pd.DataFrame:
    """At most KNOWN short words from the most frequent down, the end token first; all of `needed` occurrences.

    A histogram of the counts, an eighth of a power of two wide, tells the least count that still
    fits, so only words that are kept are sent.
    """
    short = counts.filter((F.octet_length("word") <= KNOWN_BYTES) & (F.col("word") != F.lit(END)))
    level = F.floor(F.log2("n") * 8)
    left, least = KNOWN - 1, None
    lowest = math.inf if math.isinf(needed) else math.floor(math.log2(needed) * 8)
    for row in sorted(short.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= row["count"]
        if left < 0 and row.level < lowest:
            break
        least = row.level
    end = counts.filter(F.col("word") == F.lit(END))
    kept = end if least is None else short.filter(level >= least).unionByName(end)
    top = kept.toPandas()
    top["word"] = [bytes(w) for w in top["word"]]
    top["_end"] = top["word"] != END
    return top.sort_values(["_end", "n", "word"], ascending=[True, False, True], ignore_index=True)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """At most KNOWN words, or those with vectors, SUFFIXES suffixes and the classes' masses reach the driver."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    needed = max(LEAST, math.sqrt(whole.n) / ROOT_PART)
    top = _most_frequent(counts, needed)
    words = [bytes(w) for w in top["word"]]
    own = max(0, min(MOST_VECTORS, 1 + int((top["n"].to_numpy()[1:] >= needed).sum())) - FREQUENT)
    rare = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w,) for w in words[:FREQUENT]], "word binary")), "word", "left_anti")
    ending, mass = F.substring("word", -2, 2), F.sum(F.col("n") + 0.1).alias("mass")
    best = rare.groupBy(ending.alias("suffix")).agg(mass).orderBy(F.desc("mass"), "suffix").limit(SUFFIXES).collect()
    suffixes = {bytes(r.suffix): FREQUENT + i for i, r in enumerate(best)}
    other = FREQUENT + SUFFIXES
    of = np.array([suffixes.get(w[-2:], other) for w in words[FREQUENT : FREQUENT + own]], np.int64)
    parts = -(-np.bincount(of, minlength=other + 1) // max(SPLIT, math.isqrt(own)))
    layout, further = {}, other + 1
    for first in range(FREQUENT, other + 1):
        n = max(1, int(parts[first]))
        layout[first] = first, further, n
        further += n - 1
    totals = np.full(further, 0.1)
    single = top["n"].to_numpy(np.float64)[:FREQUENT] + 0.1
    totals[: len(single)] = single
    # The mass of every class, split ones by the same checksum that `Vocabulary.suffix` takes.
    named = F.create_map(*(F.lit(v) for s, first in suffixes.items() for v in (s, first))) if suffixes else None
    first = F.coalesce(named[ending], F.lit(other)) if suffixes else F.lit(other)
    pieces = F.create_map(*(F.lit(v) for first, (_, _, n) in layout.items() for v in (first, n)))
    held = rare.select("n", first.alias("first"), F.crc32("word").alias("h"))
    for r in held.groupBy("first", F.pmod("h", pieces[F.col("first")]).alias("part")).agg(mass).collect():
        cls = layout[r.first][1] + r.part - 1 if r.part else r.first
        totals[cls] += r.mass
    found = Vocabulary(words, top["n"].to_numpy(np.int64), {s: layout[f] for s, f in suffixes.items()}, totals, int(whole.n), int(whole.v))
    found.own, found.other = own, layout[other]
    classes = np.array([found.suffix(w) for w in words[FREQUENT : FREQUENT + own]], np.int64) - FREQUENT
    mine = found.counts[FREQUENT : FREQUENT + own] + 0.1
    found.rest = np.maximum(0.1, totals[FREQUENT:] - np.bincount(classes, mine, len(totals) - FREQUENT))
    found.inside = Inside.of(classes, mine, found.rest)
    return found


@dataclass
class LogBilinear:
    """Context vectors, a map for each context position, class vectors and biases.

    `rows` has the vectors of words as contexts, then vectors and biases (last column) of the leaves by place.
    """

    context: np.ndarray
    near: np.ndarray
    far: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    rows: np.ndarray
    own: int = 0

    @staticmethod
    def start(vocabulary: Vocabulary) -> LogBilinear:
        draw = np.random.default_rng(11)
        n = vocabulary.n_classes
        small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        eye = np.eye(WIDTH, dtype=np.float32)
        bias = np.log(vocabulary.totals / vocabulary.totals.sum()).astype(np.float32)
        share = vocabulary.inside.share if vocabulary.inside else np.empty(0)
        rows = np.zeros((vocabulary.own + len(share), WIDTH + 1), np.float32)
        rows[vocabulary.own :, WIDTH] = np.log(share)
        context, target = small(n + 1, WIDTH), small(n, WIDTH)
        rows[: vocabulary.own, :WIDTH] = small(vocabulary.own, WIDTH)  # leaves start at zero, so contexts must differ
        return LogBilinear(context, eye.copy(), eye * 0.5, target, bias, rows, vocabulary.own)

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.near, self.far, self.target, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def like(self, flat: np.ndarray) -> LogBilinear:
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        parts = (v.reshape(p.shape).astype(np.float32) for v, p in zip(np.split(flat, cuts), self.parts()))
        return LogBilinear(*parts, self.rows.copy(), self.own)

    def side(self, plan: np.ndarray, at: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """What a token before adds to a context vector by a linear map, from its class and its word with a vector (-1: none)."""
        r = (self.context @ plan).take(at, axis=0)
        if own is not None:
            mine = np.flatnonzero(own >= 0)
            r[mine] += self.rows.take(own[mine], axis=0)[:, :WIDTH] @ plan
        return r

    def vectors(self, one: np.ndarray, two: np.ndarray, ones: np.ndarray | None = None, twos: np.ndarray | None = None) -> np.ndarray:
        """Context vectors from the classes just before and before that, and their words with vectors (-1: none)."""
        r = self.side(self.near, one, ones)
        r += self.side(self.far, two, twos)
        return r

    def log_classes(self, r: np.ndarray) -> np.ndarray:
        """log p of every class after each context vector."""
        scores = r @ self.target.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def log_leaves(self, r: np.ndarray, leaves: np.ndarray, inside: Inside) -> np.ndarray:
        """log p of each leaf inside its class after the context vector beside it."""
        return self.log_inside(lambda at: _with_one(r.take(at, axis=0)), leaves, inside)

    def log_inside(self, vectors: Callable[[np.ndarray], np.ndarray], leaves: np.ndarray, inside: Inside) -> np.ndarray:
        """log p of each leaf inside its class; `vectors` gives the context vectors of some places, with a one at their end."""
        out = np.empty(len(leaves))
        cls = inside.cls.take(leaves)
        order = _order(cls)
        cuts = np.flatnonzero(np.diff(cls[order])) + 1
        for at in np.split(order, cuts) if len(order) else []:
            a, b = inside.starts[cls[at[0]]], inside.starts[cls[at[0]] + 1]
            row = self.rows[self.own + a : self.own + b].T
            for i in range(0, len(at), _ROWS):
                some = at[i : i + _ROWS]
                z = vectors(some) @ row
                mine = z[np.arange(len(some)), inside.place[leaves[some]] - a]
                out[some] = mine - _log_sums(z)
        return out

    def log_class_sums(self, ones: np.ndarray, twos: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """log of the sum over classes of exp of their scores, for the context vectors ones[a] + twos[b].

        Sums beyond what float32 holds are taken the plain way.
        """
        total = np.zeros(len(a), np.float32)
        wild = np.zeros(len(ones), bool), np.zeros(len(twos), bool)
        for c in range(0, len(self.bias), _COLUMNS):
            target = self.target[c : c + _COLUMNS].T
            sides = ones @ target + self.bias[c : c + _COLUMNS], twos @ target
            for side, far in zip(sides, wild):
                if side.max(initial=0) > _WILD or side.min(initial=0) < -_WILD:
                    far |= (np.abs(side) > _WILD).any(axis=1)
                    np.clip(side, -_WILD, _WILD, out=side)
                np.exp(side, out=side)
            each = np.ones(target.shape[1], np.float32)
            for i in range(0, len(a), _PAIRS):
                product = sides[0].take(a[i : i + _PAIRS], axis=0)
                product *= sides[1].take(b[i : i + _PAIRS], axis=0)
                total[i : i + _PAIRS] += product @ each
        out = np.log(total)
        plain = np.flatnonzero(wild[0][a] | wild[1][b])
        for i in range(0, len(plain), _ROWS):
            at = plain[i : i + _ROWS]
            out[at] = _log_sums((ones[a[at]] + twos[b[at]]) @ self.target.T + self.bias)
        return out

    def log_probabilities(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log p of every class after each context (class just before, class before that)."""
        return self.log_classes(self.vectors(one, two))


def _order(at: np.ndarray) -> np.ndarray:
    """Stable order of numbers below 2^32, by halves of 16 bits, which numpy sorts by their digits."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    high = at >> 16
    return order.take(np.argsort(high.take(order).astype(np.uint16), kind="stable")) if high.any() else order


def _summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers, how often each occurs, and the sum of its rows."""
    order = _order(at)
    ordered = at.take(order)
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[starts], np.diff(starts, append=len(at)), np.add.reduceat(rows.take(order, axis=0), starts, axis=0)


def _add_rows(n: int, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of each number below n."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    some, _, sums = _summed(at, rows)
    out[some] = sums
    return out


def _odds(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(z)), within bounds; `z` is overwritten."""
    np.exp(np.clip(z, -30, 30, out=z), out=z)
    z += 1
    return np.divide(1, z, out=z)


def _with_one(r: np.ndarray) -> np.ndarray:
    """Context vectors with a last column of ones, which meets the biases."""
    out = np.ones((len(r), r.shape[1] + 1), np.float32)
    out[:, :-1] = r
    return out


def _log_sums(z: np.ndarray) -> np.ndarray:
    """log of the sum of exp of each row; `z` is overwritten."""
    top = z.max()
    if top > 60:  # far from where float32 overflows, nothing has to be taken off
        top = z.max(axis=1)
        z -= top[:, None]
    else:
        top = 0
    np.exp(z, out=z)
    return top + np.log(np.maximum(z @ np.ones(z.shape[1], np.float32), 1e-37))


class Trainer:
    """Noise-contrastive steps with one sample of classes and one of words for a whole batch, scaled by AdaGrad."""

    def __init__(self, model: LogBilinear, noise: np.ndarray, seed: int, inside: Inside | None = None) -> None:
        self.m, self.noise = model.like(model.flat()), noise
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.draw = np.random.default_rng(seed)
        self.heat = [np.full(p.shape, 1e-3, np.float32) for p in self.m.parts()]
        self.inside = inside
        if inside is not None:
            self.reach = np.cumsum(inside.share)
            self.log_words = np.log(WORD_NOISE * inside.share).astype(np.float32)
        self.warm = np.ones(self.m.rows.shape, np.float32)
        self.used = np.zeros(len(self.m.rows), np.float32)

    def _rows_step(self, at: np.ndarray, slopes: np.ndarray) -> None:
        """AdaGrad on the rows of contexts and leaves that a batch uses."""
        rows, times, slope = _summed(at, slopes)
        warm = self.warm.take(rows, axis=0)
        warm += slope * slope
        self.warm[rows] = warm
        slope *= RATE
        slope /= np.sqrt(warm, out=warm)
        slope += self.m.rows.take(rows, axis=0)
        self.m.rows[rows] = slope
        self.used[rows] += times

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, ones=None, twos=None, leaves=None) -> None:
        """A batch of contexts and classes, with the words with vectors and the leaves if there are any."""
        m = self.m
        fake = self.draw.choice(len(self.noise), NOISE, p=self.noise)
        r = m.vectors(one, two, ones, twos)
        shift = m.bias - self.log_noise
        target = m.target.take(word, axis=0)
        up = _odds(np.einsum("ij,ij->i", r, target) + shift.take(word))
        other = r @ m.target[fake].T
        other += shift[fake]
        down = _odds(np.negative(other, out=other))  # taken off, not added
        n_classes = len(m.bias)
        d_r = target
        d_r *= up[:, None]
        d_r -= down @ m.target[fake]
        d_target = _add_rows(n_classes, word, up[:, None] * r)
        np.subtract.at(d_target, fake, down.T @ r)
        d_bias = np.bincount(word, up, n_classes) - np.bincount(fake, down.sum(axis=0), n_classes)
        deep = np.flatnonzero(leaves >= 0) if leaves is not None else np.empty(0, np.int64)
        asked = [(own, np.flatnonzero(own >= 0)) for own in (ones, twos) if own is not None]
        n_used = sum(len(at) for _, at in asked) + (len(deep) + WORD_NOISE if len(deep) else 0)
        used, slopes, filled = np.empty(n_used, np.int64), np.empty((n_used, WIDTH + 1), np.float32), 0
        if len(deep):
            mine, place = r.take(deep, axis=0), self.inside.place.take(leaves.take(deep))
            drawn = np.searchsorted(self.reach, self.draw.random(WORD_NOISE) * self.reach[-1], "right")
            row, noise = m.rows.take(m.own + place, axis=0), m.rows[m.own + drawn]
            up = _odds(np.einsum("ij,ij->i", mine, row[:, :WIDTH]) + row[:, WIDTH] - self.log_words.take(place))[:, None]
            z = mine @ noise[:, :WIDTH].T
            z += noise[:, WIDTH] - self.log_words[drawn]
            down = _odds(np.negative(z, out=z))
            row *= up
            push = row[:, :WIDTH]
            push -= down @ noise[:, :WIDTH]
            d_r[deep] += push
            n = filled = len(deep)
            used[:n] = m.own + place
            np.multiply(mine, up, out=slopes[:n, :WIDTH])
            slopes[:n, WIDTH] = up[:, 0]
            filled += WORD_NOISE
            used[n:filled] = m.own + drawn
            slopes[n:filled, :WIDTH] = -(down.T @ mine)
            slopes[n:filled, WIDTH] = -down.sum(axis=0)
        d_one, d_two = (_add_rows(n_classes + 1, at, d_r) for at in (one, two))
        d_context = d_one @ m.near.T + d_two @ m.far.T
        plans = [m.context.T @ d_one, m.context.T @ d_two]
        for i, ((own, at), plan) in enumerate(zip(asked, (m.near, m.far))):
            rows, some = own.take(at), d_r.take(at, axis=0)
            plans[i] = plans[i] + m.rows.take(rows, axis=0)[:, :WIDTH].T @ some
            last = filled + len(at)
            used[filled:last] = rows
            slopes[filled:last, :WIDTH] = some @ plan.T
            slopes[filled:last, WIDTH] = 0
            filled = last
        steps = [d_context, *plans, d_target, d_bias]
        for part, heat, slope in zip(m.parts(), self.heat, steps):
            slope = (slope / len(word)).astype(np.float32)
            heat += slope * slope
            part += RATE * slope / np.sqrt(heat)
        if n_used:
            self._rows_step(used, slopes)


def contexts(classes: np.ndarray, starts: np.ndarray, opening: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the token before and of the one before that; `opening` before a text."""
    one = np.concatenate(([opening], classes[:-1]))
    one[starts] = opening
    two = np.concatenate(([opening], one[:-1]))
    two[starts] = opening
    return one, two


def _train(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, model = shared.value
        words.prepare()
        trainer = Trainer(model, words.totals / words.totals.sum(), TaskContext.get().partitionId(), words.inside)
        seen = 0
        for load in _loads(batches, _LOAD):
            starts, known, cls, _ = words.look_up(load["text"])
            leaves = words.leaves(known, cls)
            (one, ones), (two, twos) = map(words.parted, words.contexts(cls, leaves, starts))
            order = trainer.draw.permutation(len(cls))
            for first in range(0, len(order), BATCH):
                at = order[first : first + BATCH]
                trainer.step(*(v.take(at) for v in (one, two, cls, ones, twos, leaves)))
            seen += len(cls)
        if seen:
            yield _sent(-1, seen, np.empty(0), np.empty(0), trainer.m.flat().astype(np.float64) * seen)
            used = np.flatnonzero(trainer.used)
            for rows in np.split(used, np.flatnonzero(np.diff(used // _BLOCK)) + 1) if len(used) else []:
                n = trainer.used[rows]
                yield _sent(int(rows[0]) // _BLOCK, 0, rows % _BLOCK, n, trainer.m.rows[rows] * n[:, None])

    return run


_SENT = "block int, n long, at binary, used binary, sum binary"


def _sent(block: int, n: int, at: np.ndarray, used: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    raw = [at.astype(np.int16).tobytes(), used.astype(np.float32).tobytes(), total.tobytes()]
    numbers = [pa.array([block], pa.int32()), pa.array([n], pa.int64())]
    return pa.record_batch(numbers + [pa.array([v], pa.binary()) for v in raw], names=["block", "n", "at", "used", "sum"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each block; block -1 has the parameters that every task uses."""
    seen, total = 0, None
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, n, at, used, raw in zip(*(batch[c] for c in ("block", "n", "at", "used", "sum"))):
            block, at, used, raw = block.as_py(), at.as_buffer(), used.as_buffer(), raw.as_buffer()
            if block < 0:
                part = np.frombuffer(raw)
                total = part.copy() if total is None else total + part
                seen += n.as_py()
                continue
            if block not in blocks:
                blocks[block] = np.zeros(_BLOCK, np.float32), np.zeros((_BLOCK, WIDTH + 1), np.float32)
            rows = np.frombuffer(at, np.int16)
            blocks[block][0][rows] += np.frombuffer(used, np.float32)
            blocks[block][1][rows] += np.frombuffer(raw, np.float32).reshape(-1, WIDTH + 1)
    if seen:
        yield _sent(-1, seen, np.empty(0), np.empty(0), total)
    for block, (used, sums) in blocks.items():
        rows = np.flatnonzero(used)
        yield _sent(block, 0, rows, used[rows], sums[rows])


def deal(docs: DataFrame, trainers: int, low: int, high: int, key: str = "doc_id") -> DataFrame:
    """Texts of the tenths from `low` to below `high`, one partition a trainer, in order of their hash.

    The partition is named, not hashed: the number of trainers, and with it what they send, is never
    that of the session's shuffle partitions.
    """
    hashed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(key, "text").alias("h"))
    tenth = F.pmod("h", F.lit(10))
    mine = hashed.filter((tenth >= low) & (tenth < high))
    trainer = F.pmod(F.shiftright("h", 16), F.lit(trainers)).cast("int")  # apart from the tenths
    return mine.repartitionById(trainers, trainer).sortWithinPartitions("h").select("text")


def train(docs: DataFrame, words: Vocabulary, key: str = "doc_id") -> LogBilinear:
    """Rounds of parallel steps; one sum of each parameter reaches the driver in a round."""
    model = LogBilinear.start(words)
    trainers = max(1, round(math.sqrt(words.tokens) / TRAINER_ROOT))
    for low, high in ROUNDS:
        shared = docs.sparkSession.sparkContext.broadcast((words, model))
        sent = deal(docs, trainers, low, high, key).mapInArrow(_train(shared), _SENT)
        sums = sent.repartition(16, "block").mapInArrow(_add, _SENT).collect()
        whole = [row for row in sums if row.block < 0]
        if whole:
            model = model.like(sum(np.frombuffer(row["sum"]) for row in whole) / sum(row.n for row in whole))
            for row in sums:
                if row.block >= 0:
                    at = row.block * _BLOCK + np.frombuffer(row["at"], np.int16).astype(np.int64)
                    used = np.frombuffer(row["used"], np.float32)[:, None]
                    model.rows[at] = np.frombuffer(row["sum"], np.float32).reshape(-1, WIDTH + 1) / used
    return model


def log_tokens(words: Vocabulary, model: LogBilinear, cls: np.ndarray, leaves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log p of the class of each token after its context and, where it has one, of its leaf inside the class."""
    before = words.contexts(cls, leaves, starts)
    seen = np.zeros(words.n_classes + 1 + words.own, bool)
    for ids in before:
        seen[ids] = True
    ids = np.flatnonzero(seen)
    place = np.cumsum(seen) - 1
    one, two = (place.take(c) for c in before)
    at, own = words.parted(ids)
    near, far = model.side(model.near, at, own), model.side(model.far, at, own)
    pairs, where = np.unique(one * len(ids) + two, return_inverse=True)
    logs = -model.log_class_sums(near, far, pairs // len(ids), pairs % len(ids)).astype(np.float64).take(where)
    near, far = _with_one(near), np.pad(far, ((0, 0), (0, 1)))
    target = np.hstack([model.target, model.bias[:, None]]).astype(np.float32)

    def vectors(some: np.ndarray) -> np.ndarray:
        r = near.take(one.take(some), axis=0)
        r += far.take(two.take(some), axis=0)
        return r

    for i in range(0, len(cls), _PAIRS):
        some = np.arange(i, min(i + _PAIRS, len(cls)))
        logs[some] += np.einsum("ij,ij->i", vectors(some), target.take(cls[some], axis=0))
    deep = np.flatnonzero(leaves >= 0)
    if len(deep):
        logs[deep] += model.log_inside(lambda some: vectors(deep.take(some)), leaves.take(deep), words.inside)
    return logs


def _rare(texts: np.ndarray, n_texts: int, words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Distinct words and their times of each text, given the text of each word, as lists."""
    coded = words.dictionary_encode()
    n = max(1, len(coded.dictionary))
    found, times = np.unique(texts * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    cuts = pa.array(np.searchsorted(found, np.arange(n_texts + 1) * n), pa.int32())
    return pa.ListArray.from_arrays(cuts, coded.dictionary.take(pa.array(found % n))), pa.ListArray.from_arrays(cuts, pa.array(times))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = shared.value
        words.prepare()
        log_count = np.log10(np.append(words.counts, 0) + 0.1)
        log_rest = np.log10(words.rest)
        for load in _loads(batches, _LOAD):
            starts, at, cls, rest = words.look_up(load["text"])
            leaves = words.leaves(at, cls)
            logs = log_tokens(words, model, cls, leaves, starts)
            sizes = np.diff(starts, append=len(at))
            known = at >= 0
            joined = ~known
            joined[starts + sizes - 1] = False
            counted = np.where(joined, 0, log_count.take(at, mode="wrap"))
            logs = logs / math.log(10) + np.where(leaves >= words.own, counted - log_rest[np.maximum(cls - FREQUENT, 0)], 0)
            sums = (np.add.reduceat(v, starts) for v in (known.astype(np.int64), counted, logs))
            texts = np.repeat(np.arange(len(starts)), sizes)[joined]
            columns = [load["row"], load["_key"], pa.array(sizes), *map(pa.array, sums), *_rare(texts, len(starts), rest)]
            yield pa.record_batch(columns, names=["row", "_key", "n_tokens", "n_known", "base", "model", "rare", "times"])

    return run


def score_documents(docs: DataFrame, trained_on: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row.

    `trained_on` marks the rows to learn from; both scores are log10 probabilities of the text.
    """
    plain = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(trained_on, F.lit(False)).alias("_train"))
    learned = plain.filter("_train").select(key, "text")
    counts = count_words(learned)
    words = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((words, train(learned, words, key)))
    rows = plain.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("_key"), "text")
    schema = "row long, _key string, n_tokens long, n_known long, base double, model double, rare array<binary>, times array<long>"
    scored = materialise(rows.mapInArrow(_score(shared), schema), "scored")
    pairs = F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("times"))
    single = scored.select("row", F.explode(pairs).alias("p")).select("row", "p.word", "p.times")
    counted = single.join(counts, "word", "left")
    n = F.coalesce("n", F.lit(0))
    rest = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + 0.1)).alias("rest"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more")
    )
    whole = scored.drop("rare", "times").join(rest, "row", "left")
    extra = F.coalesce("rest", F.lit(0.0))
    return whole.select(
        F.col("_key").cast(docs.schema[key].dataType).alias(key),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * words.base_log).alias("base_score"),
        (F.col("model") + extra).alias("score"),
    )
