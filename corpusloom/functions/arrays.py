"""Helpers on arrays.

A plain explode makes the optimizer add a "not empty" filter on the array, which evaluates a
computed array (a Python split, a regex extraction, parsed JSON) a second time. The row helpers
explode with outer semantics and drop the empty rows by the exploded position instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_rows(df: DataFrame, keep: list[str], array: Column, value: str, pos: str = "_pos") -> DataFrame:
    """One row per array element with its position from 0; `pos` is dropped unless named."""
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())
    return rows.drop(pos) if pos == "_pos" else rows


def struct_rows(df: DataFrame, keep: list[str], array: Column, pos: str = "_pos") -> DataFrame:
    """One row per struct element, its fields as columns; `pos` as in `array_rows`."""
    named = [] if pos == "_pos" else [pos]
    return array_rows(df, keep, array, "_row", pos).select(*keep, *named, "_row.*")
