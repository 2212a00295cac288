"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are column functions over the whole text. The trees are fitted with numpy on the
statistics of at most `MAX_LABELLED` labelled documents of each class (a few numbers a document),
flattened into arrays of features, thresholds and leaf values, and all documents run through all
trees level by level without branching.

Defined cases: a null text is empty and is scored as any other; without labels, or with one class
only, every score is the share of good documents (0.5 without labels); repeated rows get equal
scores; an empty table gives no rows; extra columns are kept by `with_score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let
from .labels import labelled
from .quality_rules import SPACES, SYMBOLS, count_chars, words

MAX_LABELLED = 20_000  # labelled documents of each class in the fit
TREES, DEPTH, BINS = 80, 4, 64
RATE, SHRINK, MIN_ROWS = 0.15, 1.0, 20.0


def statistics(text: Column) -> Column:
    """Raw counts of a text as an array of doubles."""

    def of_words(w: Column) -> Column:
        after = F.slice(w, F.lit(2), F.size(w))
        same = F.filter(F.zip_with(w, after, lambda a, b: a == b), lambda s: s)
        return F.array(F.size(w), F.size(F.array_distinct(w)), F.size(same))

    def of_lines(lines: Column) -> Column:
        return F.array(F.size(lines), F.size(F.array_distinct(lines)))

    plain = F.coalesce(text, F.lit(""))
    chars = F.array(
        F.length(plain),
        F.length(F.translate(plain, SPACES, "")),
        F.length(plain) - F.length(F.regexp_replace(plain, r"\p{Lu}+", "")),
        count_chars(plain, SYMBOLS),
        count_chars(plain, "|"),
        count_chars(plain, "!"),
        count_chars(plain, ".?:;"),
        count_chars(plain, ","),
        count_chars(plain, "0123456789"),
    )
    counts = F.concat(chars, let(words(plain), of_words), let(F.split(plain, "\n"), of_lines))
    return counts.cast("array<double>")


def features(counts: np.ndarray) -> np.ndarray:
    """Ratios the trees split on, from rows of raw counts."""
    size, word_chars, upper, symbols, bars, cries, stops, commas, digits, n, distinct, same, lines, distinct_lines = counts.T
    a_word, a_char, a_line = np.maximum(n, 1), np.maximum(size, 1), np.maximum(lines, 1)
    return np.column_stack(
        [
            np.log1p(n), distinct / a_word, same / a_word, word_chars / a_word, upper / a_char, symbols / a_word, bars / a_word,
            cries / a_word, stops / a_word, commas / a_word, digits / a_char, n / a_line, distinct_lines / a_line,
        ]
    )


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: split feature and threshold by (tree, node), value by (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - (2**DEPTH - 1)]
        return total

    def score(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(features(counts)))) if len(counts) else np.zeros(0)


def _bins(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of every value and the upper edges of the bins, by quantiles of each column."""
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)])
    return binned, edges


def fit(counts: np.ndarray, label: np.ndarray) -> Trees:
    """Boost trees on the logistic loss; each level of a tree is one histogram over all nodes."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    share = float(np.clip(label.mean(), 1e-3, 1 - 1e-3)) if len(label) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(np.unique(label)) < 2:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    x = features(counts)
    binned, edges = _bins(x)
    n_features, n = binned.shape
    margin = np.full(n, base)
    grown = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = label - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = (node - first) * BINS
            sums = np.empty((3, n_features, width, BINS))
            for f in range(n_features):
                slot = at + binned[f]
                for k, weight in enumerate((slope, curve, None)):
                    sums[k, f] = np.bincount(slot, weight, width * BINS).reshape(width, BINS)
            left = sums.cumsum(axis=3)
            whole = left[:, :, :, -1:]
            right = whole - left
            gain = left[0] ** 2 / (left[1] + SHRINK) + right[0] ** 2 / (right[1] + SHRINK) - whole[0] ** 2 / (whole[1] + SHRINK)
            gain[(left[2] < MIN_ROWS) | (right[2] < MIN_ROWS)] = 0
            best = gain.transpose(1, 0, 2).reshape(width, -1)
            choice = best.argmax(axis=1)
            worth = best[np.arange(width), choice] > 1e-6
            split_feature, split_bin = choice // BINS, np.minimum(choice % BINS, BINS - 2)
            feature[first : first + width] = split_feature
            threshold[first : first + width] = np.where(worth, edges[split_feature, split_bin], np.inf)
            here = node - first
            node = 2 * node + 1 + (x[np.arange(n), split_feature[here]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + SHRINK)
        margin += value[leaf]
        grown.append((feature, threshold, value))
    return Trees(*(np.array(part) for part in zip(*grown)), base)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Trees:
    """Fit on at most MAX_LABELLED documents of each class; only their counts reach the driver."""
    sample = labelled(docs, labels, label, MAX_LABELLED, key, text)
    rows = sample.select(statistics(F.col("text")).alias("counts"), F.col("label").cast("double").alias("label")).toPandas()
    order = np.lexsort(np.stack(rows["counts"].to_list()).T) if len(rows) else []
    rows = rows.iloc[order]
    return fit(np.stack(rows["counts"].to_list()) if len(rows) else np.zeros((0, 14)), rows["label"].to_numpy())


def with_score(docs: DataFrame, model: Trees, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the probability that a document is good, in place of a column called `name`; all others are kept."""

    @F.pandas_udf("double")
    def scored(counts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(counts.to_list()))) if len(counts) else pd.Series([], dtype=float)

    return docs.withColumn(name, scored(statistics(F.col(text))))
