"""Markdown splitting: the one sequential step of the chunker, run on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F, types as T

from ..settings import HEADING_LINE, MAX_CHUNK_CHARS, MIN_CHUNK_CHARS, WS

_HEADING = re.compile(HEADING_LINE, re.MULTILINE)
_PIECE = 256  # texts whose passages are handed back at a time
PASSAGES = T.ArrayType(
    T.StructType()
    .add("content", T.StringType())
    .add("heading", T.StringType())
    .add("heading_path", T.ArrayType(T.StringType()))
)


def _cuts(text: str, heads: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Character ranges of the passages of one document.

    A passage ends before a heading that is not deeper than the heading before it, and after
    the first line that brings it to the size limit; lines are never split.
    """
    ends = [at for (_, last, _), (at, level, _) in zip(heads, heads[1:]) if level <= last]
    start = 0
    for end in [*ends, len(text)]:
        while 0 <= (newline := text.find("\n", start + MAX_CHUNK_CHARS - 1)) < end:
            yield start, newline + 1
            start = newline + 1
        if text[start:end].strip(WS):
            yield start, end
            start = end


def passages(text: str) -> Iterator[tuple[str, str | None, list[str | None]]]:
    """(content, heading, heading path) of each passage longer than the minimum."""
    text += "\n"
    heads = [(m.start(), len(m[1]), m[2]) for m in _HEADING.finditer(text)]
    seen, heading, path = 0, None, []
    for start, end in _cuts(text, heads):
        while seen < len(heads) and heads[seen][0] < end:
            _, level, heading = heads[seen]
            path = (path + [None] * 6)[: level - 1] + [heading]
            seen += 1
        content = text[start:end].strip(WS)
        if len(content) > MIN_CHUNK_CHARS:
            yield content, heading, path


def outline(text: str) -> Iterator[tuple[int, str, list[str | None]]]:
    """(level, heading, path) of each heading line; a level that was skipped is an empty place in the path."""
    path: list[str | None] = []
    for match in _HEADING.finditer(text):
        level = len(match[1])
        path = (path + [None] * 6)[: level - 1] + [match[2]]
        yield level, match[2], path


OUTLINE = T.ArrayType(
    T.StructType().add("level", T.IntegerType()).add("heading", T.StringType()).add("path", T.ArrayType(T.StringType()))
)


@F.arrow_udf(OUTLINE)
def outline_rows(texts: pa.Array) -> pa.Array:
    offsets, rows = [0], []
    for text in texts:
        rows += outline(text.as_py()) if text.is_valid else ()
        offsets.append(len(rows))
    levels, headings, paths = zip(*rows) if rows else ((), (), ())
    fields = [pa.array(levels, pa.int32()), pa.array(headings, pa.string()), pa.array(paths, pa.list_(pa.string()))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=["level", "heading", "path"]))


def _split(texts: pa.Array) -> pa.Array:
    offsets, contents, headings, paths = [0], [], [], []
    for text in texts:
        for content, heading, path in passages(text.as_py()) if text.is_valid else ():
            contents.append(content)
            headings.append(heading)
            paths.append(path)
        offsets.append(len(contents))
    rows = pa.StructArray.from_arrays(
        [
            pa.array(contents, pa.string()),
            pa.array(headings, pa.string()),
            pa.array(paths, pa.list_(pa.string())),
        ],
        names=["content", "heading", "heading_path"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


@F.arrow_udf(PASSAGES)
def split_passages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Passages of each text. A batch is handed back in pieces, so a task holds it and the passages of one piece."""
    for texts in batches:
        for first in range(0, len(texts), _PIECE):
            yield _split(texts[first : first + _PIECE])
