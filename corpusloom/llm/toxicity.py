"""Toxicity of texts written through a noisy channel.

Words are restored first: leetspeak, stretched letters, separators inside words and letters set
apart by blanks make a lattice of characters, and Viterbi decoding under a trigram character model
picks the likeliest path. The restored words are looked up in a lexicon of words and word
beginnings that the labelled toxic documents use more often than the clean ones, and a logistic
function of a document's strongest hits is its score.

Everything is learned from all labelled documents: two thirds give the lexicon, the rest calibrates
the score. Counts and the sums of the calibration are Spark aggregates. The character model knows
the `MAX_WORDS` most frequent words.

Defined cases: a null or empty text has no hits; without labels or hits every score is the same;
repeated rows get equal scores; an empty table gives no rows; extra columns are kept.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..settings import materialise
from .labels import all_labelled

MAX_WORDS = 50_000  # words in the character model
MAX_TERMS = 4_000  # entries of the lexicon
SPREAD = 1.64  # standard deviations by which counts are held back
MIN_ODDS = 1.5
PREFIXES = (4, 5, 6)
REMEMBERED = 400_000  # tokens a worker keeps weights of

# --- fixed values: what a character may stand for ------------------------------------
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "#": "h", "*": "aeiou",
}
SEPARATORS = ".-_*~'`,:;/\\ ·​‌‍⁠﻿"
COSTS = {"swap": 0.7, "wild": 1.6, "repeat": 0.3, "drop": 0.4, "mark": 1.4, "digit": 6.0}

_ALONE = r"(?:\S|(?:[^\w\s]|_)*[^\W_](?:[^\w\s]|_)*)"  # one character, or one letter or digit between marks
_SPACED = re.compile(rf"(?<!\S){_ALONE}(?:[ \t]+{_ALONE}){{2,}}(?!\S)")
_MARKED = re.compile(r"[\W_]+")
_EDGES = "".join(c for c in SEPARATORS) + "\"?()[]{}<>%&=^“”„‘’«»…"
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_STRETCHED = re.compile(r"(.)\1\1")
_DOUBLED = re.compile(r"(.)\1")
_NO_LETTERS = re.compile(r"[\W\d_]+")
_MARKS = re.compile(r"[!$#*+|@€£¥]+\Z")
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class CharModel:
    """Interpolated trigram model of the letters of words; `^` opens and `$` closes a word."""

    counts: dict[str, float] = field(default_factory=dict)

    @staticmethod
    def of(words: Iterable[tuple[str, float]]) -> CharModel:
        counts: dict[str, float] = defaultdict(float)
        for word, n in words:
            padded = f"^^{word}$"
            for i in range(2, len(padded)):
                for size in (1, 2, 3):
                    counts[padded[i - size + 1 : i + 1]] += n
                    counts[padded[i - size + 1 : i] + "\0"] += n
        return CharModel(dict(counts))

    def cost(self, context: str, char: str) -> float:
        """-ln p(char | two characters before)."""
        get = self.counts.get
        p = 1e-5
        for size, share in ((1, 0.05), (2, 0.25), (3, 0.7)):
            before = context[3 - size :]
            total = get(before + "\0", 0.0)
            if total:
                p += share * get(before + char, 0.0) / total
        return -math.log(p)


def _options(chars: str, i: int) -> list[tuple[str, float]]:
    """What the character at `i` may be, with the cost of writing it so."""
    c = chars[i]
    found = []
    if _LETTER.match(c):
        found.append((c, 0.0))
    else:
        meant = STANDS_FOR.get(c, "")
        found += [(m, COSTS["wild" if len(meant) > 2 else "swap"]) for m in meant]
        found.append(("", COSTS["drop"] if c in SEPARATORS else COSTS["digit"] if c in STANDS_FOR or c.isdigit() else COSTS["mark"]))
    if i and c == chars[i - 1]:
        found.append(("", COSTS["repeat"]))
    return found


def decode(chars: str, model: CharModel) -> str:
    """The likeliest word behind noisy characters (Viterbi over the last two letters)."""
    states: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
    for i in range(len(chars)):
        options = _options(chars, i)
        moved: dict[str, tuple[float, tuple]] = {}
        for last, (cost, path) in states.items():
            for out, price in options:
                total = cost + price + (model.cost(last, out) if out else 0.0)
                state = last[1] + out if out else last
                if state not in moved or total < moved[state][0]:
                    moved[state] = (total, (path, out) if out else path)
        states = moved
    _, path = min((cost + model.cost(last, "$"), path) for last, (cost, path) in states.items())
    letters = []
    while path:
        path, out = path
        letters.append(out)
    return "".join(reversed(letters))


@dataclass
class Detector:
    """Lexicon, character model and calibration."""

    words: dict[str, float]
    prefixes: dict[str, float]
    chars: CharModel
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    _memory: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self.single = {_DOUBLED.sub(r"\1", word): weight for word, weight in self.words.items()}
        self.longest = max(map(len, self.words), default=0)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memory": {}}

    def weight(self, word: str) -> float:
        """Evidence of a restored word."""
        best = self.words.get(word, 0.0)
        for size in PREFIXES:
            if len(word) > size:
                best = max(best, self.prefixes.get(word[:size], 0.0))
        return best

    def token(self, token: str) -> float:
        """Evidence of a token as written or as restored."""
        core = token.strip(_EDGES)
        if _PLAIN.match(core):
            return max(self.weight(core), self._decoded(core) if _DOUBLED.search(core) else 0.0)
        if not _LETTER.search(core):
            return 0.0
        best = max((self.weight(part) for part in _NO_LETTERS.split(core)), default=0.0)
        marks = _MARKS.search(core)  # cries and marks behind a word
        if marks:
            word = core[: marks.start()]
            best = max(best, self._decoded(word))
            if _PLAIN.match(word) and (len(marks[0]) > 2 or "!" in marks[0]):
                return best
        return max(best, self._decoded(core))

    def _decoded(self, chars: str) -> float:
        """Evidence of a restored word; how often its letters are doubled doesn't matter."""
        if not (_PLAIN.match(chars) and not _STRETCHED.search(chars)):
            chars = decode(chars, self.chars)
        return self._restored(chars)

    def _restored(self, word: str) -> float:
        return max(self.weight(word), self.single.get(_DOUBLED.sub(r"\1", word), 0.0))

    def spaced(self, letters: str) -> float:
        """Evidence in letters set apart: any restored stretch of them may be a word.

        Marks beside a letter are left out. Stretches are weighed like words written together, from
        the three letters on that a run has at least.
        """
        alone = (c if len(c) == 1 else _MARKED.sub("", c) for c in letters.split())
        restored = decode("".join(alone), self.chars)
        longest = max(self.longest, PREFIXES[-1] + 1)
        ends = range(3, len(restored) + 1)
        return max((self._restored(restored[a:b]) for b in ends for a in range(max(0, b - longest), b - 2)), default=0.0)

    def hits(self, text: str) -> list[float]:
        """Evidence of the distinct tokens of a text."""
        low = text.lower()
        memory = self._memory
        found = []
        for token in set(low.split()):
            w = memory.get(token)
            if w is None:
                w = self.token(token)
                if len(memory) > REMEMBERED:
                    memory.clear()
                if len(token) <= 40:
                    memory[token] = w
            if w:
                found.append(w)
        found += [w for m in _SPACED.finditer(low) if (w := self.spaced(m[0]))]
        return found

    def features(self, text: str) -> tuple[float, float]:
        """The strongest evidence, and the next two together."""
        found = sorted(self.hits(text), reverse=True)
        return (found[0] if found else 0.0, sum(found[1:3]))

    def score(self, text: str) -> float:
        x = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def logistic(rows: DataFrame, ridge: float = 1.0, steps: int = 30) -> tuple[float, ...]:
    """Weights of a logistic regression with intercept on (label, first, next) by Newton's method; evidence never counts
    against. Each step is one aggregate, whose sums are decimals, so that the order of rows doesn't matter."""
    full = [F.lit(1.0), F.col("first"), F.col("next")]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    w = np.zeros(3)
    if rows.select("label").distinct().count() < 2:
        return tuple(w.tolist())
    penalty = np.diag([1e-6, ridge, ridge])

    def total(x: Column) -> Column:
        return F.sum(x.cast("decimal(28,18)")).cast("double")

    for _ in range(steps):
        z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), sum((F.lit(float(v)) * x for v, x in zip(w, full)), F.lit(0.0))))
        known = rows.withColumn("p", 1 / (1 + F.exp(-z)))
        p = F.col("p")
        found = known.agg(*[total((p - F.col("label")) * x) for x in full], *[total(p * (1 - p) * full[i] * full[j]) for i, j in pairs]).first()
        curve = np.zeros((3, 3))
        for (i, j), value in zip(pairs, found[3:]):
            curve[i, j] = curve[j, i] = value
        before = w.copy()
        w -= np.linalg.solve(curve + penalty, np.array(found[:3]) + penalty @ w)
        w[1:] = np.maximum(w[1:], 0)
        if np.abs(w - before).max() < 1e-10:
            break
    return tuple(w.tolist())


def _lexicon(rows: list, toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Terms whose cautious log odds are high enough."""
    words, prefixes = {}, {}
    for row in rows:
        least = row.n_toxic - SPREAD * math.sqrt(row.n_toxic)
        most = row.n_clean + SPREAD * math.sqrt(row.n_clean) + 1
        odds = math.log(max(least, 1e-9) / toxic) - math.log(most / (clean + 1))
        if odds > MIN_ODDS:
            (words if row.term[0] == "=" else prefixes)[row.term[1:]] = odds
    return words, prefixes


def _beginnings(size: int) -> Column:
    """The distinct beginnings of `size` letters of longer words."""
    longer = F.filter("words", lambda w: F.length(w) > size)
    return F.array_distinct(F.transform(longer, lambda w: F.concat(F.lit("^"), F.substring(w, 1, size))))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Detector:
    """Learn from all labelled documents; aggregates alone reach the driver."""
    rows = all_labelled(docs, labels, label, key, text)
    known = materialise(rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(3))), "toxic_labelled")
    fitting = known.filter("part > 0")
    sizes = {r.label: r["count"] for r in fitting.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    named = fitting.select("label", tokens.alias("words"))
    starts = [_beginnings(n) for n in PREFIXES]
    terms = named.select("label", F.explode(F.concat(F.transform("words", lambda w: F.concat(F.lit("="), w)), *starts)).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("label").alias("n_toxic"), F.sum(1 - F.col("label")).alias("n_clean"))
    often = counted.filter((F.col("n_toxic") >= max(4, toxic // 300)) & (F.col("n_toxic") * clean > 8 * F.col("n_clean") * toxic))
    words, prefixes = _lexicon(often.orderBy(F.desc("n_toxic"), "term").limit(MAX_TERMS).collect(), toxic, clean)
    usual = named.select(F.explode("words").alias("word")).groupBy("word").count().filter(F.length("word") <= 40)
    frequent = [(r.word, float(r["count"])) for r in usual.orderBy(F.desc("count"), "word").limit(MAX_WORDS).collect()]
    weight = 0.02 * sum(n for _, n in frequent) / max(1, len(words))
    detector = Detector(words, prefixes, CharModel.of(frequent + [(w, weight) for w in words]))
    checked = known.filter("part = 0").mapInPandas(_features(detector), "label double, first double, next double")
    detector.weights = logistic(materialise(checked, "toxic_features"))
    return detector


def _features(detector: Detector):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(float(y), *detector.features(t)) for y, t in zip(batch["label"], batch["text"])]
            yield pd.DataFrame(found, columns=["label", "first", "next"])

    return run


def with_score(docs: DataFrame, detector: Detector, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability that a document is toxic, in place of a column called `name`; all others are kept."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([detector.score(t) for t in texts], dtype=float)

    return docs.withColumn(name, scored(F.coalesce(F.col(text), F.lit(""))))
