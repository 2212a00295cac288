"""English stemming (M. Porter, "An algorithm for suffix stripping", 1980) on arrays of words."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F, types as T

# --- fixed values: the suffix tables of the published algorithm --------------------------
STEP_2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"),
    ("biliti", "ble"),
)
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)
# -----------------------------------------------------------------------------------------
_VOWEL = "(?:[aeiou]|(?<=[^aeiou])y)"
_RUN = re.compile(f"{_VOWEL}+(?:(?!{_VOWEL})[a-z])+")
_SHORT = re.compile(f"(?:^|.*)(?!{_VOWEL})[a-z]{_VOWEL}(?!{_VOWEL})[^wxy]$")


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    return len(_RUN.findall(stem))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeiou"


def _replace(word: str, table, least: int) -> str:
    """Apply the longest matching suffix whose stem has more than `least` sequences."""
    for suffix, new in sorted(table, key=lambda pair: -len(pair[0])):
        if word.endswith(suffix):
            stem = word.removesuffix(suffix)
            return stem + new if _measure(stem) > least else word
    return word


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word.removesuffix(suffix)
        if stem != word and re.search(_VOWEL, stem):
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _SHORT.match(stem) else stem
    return word


def _final(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _SHORT.match(stem)):
            word = stem
    return word[:-1] if _double(word) and word[-1] == "l" and _measure(word) > 1 else word


@lru_cache(maxsize=1 << 17)
def stem(word: str) -> str:
    """Stem of a lower-case English word; anything but a-z stays as it is."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    word = _past(_plural(word))
    if word.endswith("y") and re.search(_VOWEL, word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP_2, 0), STEP_3, 0)
    if not word.endswith("ion") or word.endswith(("sion", "tion")):
        word = _replace(word, [(s, "") for s in STEP_4], 1)
    return _final(word)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_words(words: pa.Array) -> pa.Array:
    """Stems of arrays of words, on the flattened values of a batch."""
    flat = pa.array([stem(w) for w in words.flatten().to_pylist()], pa.string())
    sizes = [len(w) if w.is_valid else 0 for w in words]
    offsets = pa.array([0, *accumulate(sizes)], pa.int32())
    return pa.ListArray.from_arrays(offsets, flat)
