"""Line-first cleaning by rules.

Every line is tried against the rules for symbols, shouting, sentence punctuation, navigation and
boilerplate; failing lines and later copies of a line are removed; a document that loses more than
`MAX_LOST` percent of its words this way is rejected. Documents that are too short or mostly repeat
their own three-word windows fail before that.

All steps are column functions inside one row, so nothing is shuffled. The repeat count sorts
window hashes only for texts that have equal windows.

Defined cases: a null or empty text has no words and is rejected; repeated rows are judged each;
an empty table gives no rows; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import let

# --- fixed values: classes of characters and limits of the base rules -----------------
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words

# --- limits of the line rules ---------------------------------------------------------
SEPARATORS = "|›»•·→"
SENTENCE_MARKS = r"[.!?:;…。！？]"
BOILERPLATE = (
    r"(?i)all rights reserved|privacy policy|terms of (use|service)|accept (all )?cookies|licensed under|"
    r"enable javascript|subscribe to our|click here|sign (in|up) to|back to top"
)
PER_SYMBOL = 4  # words a line needs for each symbol or separator
PER_MARK = 2  # words a line needs for each exclamation mark
UNPUNCTUATED = 25  # words from which a line needs a sentence mark
MAX_LOST = 50  # percent of the words


def count_chars(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def has_word(line: Column) -> Column:
    return line.rlike(WORD)


def passes(line: Column) -> Column:
    """Whether a line with words meets every line rule."""
    return let(
        F.regexp_count(line, F.lit(WORD)),
        lambda n: (count_chars(line, SYMBOLS) * PER_SYMBOL < n)
        & (count_chars(line, SEPARATORS) * PER_SYMBOL < n)
        & (count_chars(line, "!") * PER_MARK < n)
        & ((n < UNPUNCTUATED) | line.rlike(SENTENCE_MARKS))
        & ~line.rlike(BOILERPLATE),
    )


def _shifted(values: Column) -> Column:
    """The element after each element; null after the last."""
    return F.slice(values, F.lit(2), F.size(values))


def repeated_words(tokens: Column) -> Column:
    """Words in three-word windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def marked(pairs: Column) -> Column:
            before = F.concat(F.slice(pairs, 1, 1), F.slice(pairs, F.lit(1), F.size(pairs) - 1))
            row = F.arrays_zip(pairs.alias("own"), before.alias("before"), _shifted(pairs).alias("after"))
            twice = F.filter(
                row,
                lambda r: ((r["own"]["h"] == r["before"]["h"]) & (r["own"]["p"] != r["before"]["p"]))
                | F.coalesce(r["own"]["h"] == r["after"]["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twice, lambda r: r["own"]["p"]))

        def union(starts: Column) -> Column:
            steps = F.zip_with(starts, _shifted(starts), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

        return let(let(ordered, marked), union)

    def windows(t: Column) -> Column:
        n = F.size(t) - 2
        zipped = F.arrays_zip(F.slice(t, F.lit(1), n).alias("a"), F.slice(t, F.lit(2), n).alias("b"), F.slice(t, F.lit(3), n).alias("c"))
        hashes = F.transform(zipped, lambda w: F.xxhash64(w["a"], w["b"], w["c"]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return F.when(F.size(tokens) < 3, 0).otherwise(windows(tokens))


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words, base_failed, kept, cleaned)."""
    content = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(key), content.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), has_word)
    facts = cut.select(
        key,
        let(words(F.col("_text")), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated"))).alias("_w"),
        let(
            lines,
            lambda ls: F.struct(
                (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"), F.array_distinct(F.filter(ls, passes)).alias("good")
            ),
        ).alias("_l"),
        F.length(F.translate("_text", SPACES, "")).cast("long").alias("word_chars"),
        count_chars(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
    )
    good = F.aggregate("_l.good", F.lit(0), lambda n, line: n + F.regexp_count(line, F.lit(WORD)))
    counted = facts.select(
        key,
        F.col("_w.n").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("_l.dup").cast("long").alias("n_dup_lines"),
        F.col("_w.repeated").cast("long").alias("n_repeat_words"),
        (F.col("_w.n") - good).cast("long").alias("n_lost_words"),
        F.array_join("_l.good", "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    kept = ~failed & (F.col("n_lost_words") * 100 <= F.col("n_words") * MAX_LOST)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words"]
    return counted.select(key, *names, failed.alias("base_failed"), kept.alias("kept"), "cleaned")
