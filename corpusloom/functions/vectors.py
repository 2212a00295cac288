"""Vector column functions (arrays of floats, arithmetic in double precision)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(_dot(v, v))


def normalise(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    length = norm(v)
    scaled = F.transform(F.array(length), lambda n: F.transform(v, lambda x: x.cast("double") / n))
    return F.when(length > 0, F.element_at(scaled, 1)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side has no length."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(_dot(a, b) / scale)


def parse_vector(text: Column) -> Column:
    """`[1,2,3]` -> array; entries that are not numbers are dropped."""
    body = F.regexp_replace(text, r"^\s*\[|\]\s*\z", "")
    numbers = F.transform(F.split(body, ","), lambda s: F.trim(s).try_cast("double"))
    return F.filter(numbers, lambda x: x.isNotNull() & ~F.isnan(x))


def format_vector(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))
