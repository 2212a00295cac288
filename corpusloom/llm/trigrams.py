"""Boolean trigram queries from regular expressions.

A query is a disjunction of conjunctions: a set of sets of trigrams, lower-cased. Any text that
matches the expression contains all trigrams of at least one inner set. None stands for an
expression from which no trigram can be derived.

The expression is walked once. Where a part can only be one of a few strings they are multiplied
out with their neighbours, so trigrams across part borders count; otherwise the exact strings
gathered so far are turned into trigrams and gathering starts anew.
"""

from __future__ import annotations

import re._constants as kind
import re._parser as parser
from collections.abc import Iterable

Query = frozenset[frozenset[str]]

MOST_STRINGS = 24  # exact strings kept for a part before they are turned into trigrams
ANYTHING: Query = frozenset([frozenset()])


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _both(a: Query, b: Query) -> Query:
    return _least(x | y for x in a for y in b)


def _least(sets: Iterable[frozenset[str]]) -> Query:
    """Drop sets that contain another one: the smaller set already implies them."""
    kept: list[frozenset[str]] = []
    for s in sorted(set(sets), key=lambda s: (len(s), sorted(s))):
        if not any(k <= s for k in kept):
            kept.append(s)
    return frozenset(kept)


def _strings(query: Query, exact: set[str]) -> Query:
    return _both(query, _least(_trigrams(s) for s in exact))


def _one(op: object, value: object) -> tuple[Query, set[str] | None]:
    """(query, exact strings) of one element; None if its strings are not few."""
    if op is kind.LITERAL:
        return ANYTHING, {chr(value).lower()}
    if op is kind.IN:
        chars: set[str] = set()
        for what, x in value:
            if what is kind.LITERAL:
                chars.add(chr(x).lower())
            elif what is kind.RANGE and x[1] - x[0] < MOST_STRINGS:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return ANYTHING, None
        return ANYTHING, chars if len(chars) <= MOST_STRINGS else None
    if op is kind.SUBPATTERN:
        return _sequence(value[-1])
    if op is kind.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        exact = set().union(*(e or set() for _, e in parts))
        if all(e is not None for _, e in parts) and len(exact) <= MOST_STRINGS and all(q == ANYTHING for q, _ in parts):
            return ANYTHING, exact
        return _least(s for q, e in parts for s in (_strings(q, e) if e is not None else q)), None
    if op in (kind.MAX_REPEAT, kind.MIN_REPEAT, kind.POSSESSIVE_REPEAT):
        low, high, inner = value
        query, exact = _sequence(inner)
        if low == 0:
            small = high == 1 and exact is not None and query == ANYTHING
            return ANYTHING, ({""} | exact) if small else None
        if exact is not None and low == high == 1:
            return query, exact
        return _strings(query, exact) if exact is not None else query, None
    if op is kind.AT or op in (kind.ASSERT, kind.ASSERT_NOT):
        return ANYTHING, {""}
    return ANYTHING, None


def _sequence(elements: Iterable[tuple]) -> tuple[Query, set[str] | None]:
    query, exact, whole = ANYTHING, {""}, True
    for op, value in elements:
        q, strings = _one(op, value)
        query = _both(query, q)
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            continue
        query = _strings(query, exact)
        whole = False
        exact = strings if strings is not None else {""}
    if whole and query == ANYTHING:
        return ANYTHING, exact
    return _strings(query, exact), None


def trigram_query(pattern: str) -> Query | None:
    """The query of an expression, or None if a text without any trigram might match."""
    query, exact = _sequence(parser.parse(pattern))
    if exact is not None:
        query = _strings(query, exact)
    return None if frozenset() in query else query
