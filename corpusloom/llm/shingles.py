"""Hashes of word windows inside a task, vectorised over the bytes of whole batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base)
    steps[0] = 1
    return np.cumprod(steps)


_CACHE = {"up": _powers(_BASE, 1 << 16), "down": _powers(_INVERSE, 1 << 16)}


def _grown(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_CACHE[name]) < n:
        _CACHE[name] = _powers(base, 1 << int(n - 1).bit_length())
    return _CACHE[name][:n]


def window_hashes(words: Sequence[bytes], size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` words; of all words together if there are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    data = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    data *= _grown("up", _BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data, out=sums[1:])
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(data)]))
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return mix((sums[ends] - sums[starts]) * _grown("down", _INVERSE, len(data) + 1)[starts])


def words_of(text: str) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.lower().encode("utf-8", "surrogatepass").split()
