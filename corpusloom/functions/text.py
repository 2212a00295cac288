"""Column functions on text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..settings import (
    BREADCRUMB_LINE,
    FENCE_LINE,
    HTML_TAG_LINE,
    LINK_LIST_LINE,
    LINK_LIST_RATIO,
    MIN_CHUNK_CHARS,
    NON_BLANK_LINE,
    PAGINATION_LINE,
    STOP_WORDS,
    WIDE_WS,
    WS,
)

# (?m) multi-line, (?d) only \n ends a line.
_LINES = "(?md)"


def ws_trim(c: Column) -> Column:
    """Strip Unicode white space at both ends (plain `trim` only strips blanks)."""
    return F.btrim(c, F.lit(WS))


def _plain_ws(c: Column) -> Column:
    """Map the white space outside ASCII to blanks, so that the fast classes \\s and \\S are exact."""
    return F.translate(c, WIDE_WS, " " * len(WIDE_WS))


def word_count(c: Column) -> Column:
    return F.regexp_count(_plain_ws(c), F.lit(r"\S+"))


def long_enough(c: Column) -> Column:
    return F.length(ws_trim(c)) > MIN_CHUNK_CHARS


def norm_key(c: Column) -> Column:
    """Case- and spacing-insensitive form used to recognise repeated passages."""
    return F.trim(F.regexp_replace(_plain_ws(F.lower(c)), r"\s+", " "))


def content_hash(c: Column) -> Column:
    return F.md5(c)


def stable_id(*parts: Column) -> Column:
    """Deterministic id, so that a repeated import updates instead of appending."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def _outside_fences(c: Column) -> Column:
    """Text with fenced code cut out: the pieces between fence lines alternate outside/inside."""
    pieces = F.filter(F.split(c, _LINES + FENCE_LINE), lambda _, i: i % 2 == 0)
    return F.when(F.contains(c, F.lit("```")), F.array_join(pieces, "\n")).otherwise(c)


def is_link_list(c: Column) -> Column:
    """More than 70 % of the non-blank lines outside code are list items that open with a link."""
    prose = _outside_fences(c)
    links = F.regexp_count(prose, F.lit(_LINES + LINK_LIST_LINE))
    lines = F.regexp_count(prose, F.lit(_LINES + NON_BLANK_LINE))
    return F.contains(c, F.lit("](")) & (lines > 0) & (links / lines > LINK_LIST_RATIO)


def _drop_lines(c: Column, noisy: Callable[[Column], Column]) -> Column:
    """Remove the lines outside code fences for which `noisy(trimmed line)` holds."""

    def cleaned(piece: Column) -> Column:
        return F.array_join(F.filter(F.split(piece, "\n"), lambda ln: ~noisy(ws_trim(ln))), "\n")

    pieces = F.split(c, _LINES + FENCE_LINE)
    fences = F.regexp_extract_all(c, F.lit(f"{_LINES}({FENCE_LINE})"), F.lit(1))
    kept = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, cleaned(p)).otherwise(p))
    woven = F.array_join(F.flatten(F.zip_with(kept, fences, lambda p, f: F.array(p, F.coalesce(f, F.lit(""))))), "")
    return F.when(F.contains(c, F.lit("```")), woven).otherwise(cleaned(c))


def strip_html_lines(c: Column) -> Column:
    """Drop lines that are a single HTML tag, leaving fenced code alone."""
    tagless = ~F.contains(c, F.lit("<"))
    return F.when(tagless, c).otherwise(_drop_lines(c, lambda ln: ln.rlike(HTML_TAG_LINE)))


def strip_crawler_noise(c: Column) -> Column:
    """Drop Next/Previous lines and breadcrumb chains, leaving fenced code alone."""
    linkless = ~F.contains(c, F.lit("]("))
    noisy = lambda ln: ln.rlike(PAGINATION_LINE) | ln.rlike(BREADCRUMB_LINE)
    return F.when(linkless, c).otherwise(_drop_lines(c, noisy))


def analyse(c: Column) -> Column:
    """Search terms of a text in order: lower-case letter/digit runs without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(STOP_WORDS))
