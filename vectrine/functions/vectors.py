"""Vector arithmetic as Column expressions over arrays of doubles; it all stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """Stored float arrays are widened before any arithmetic."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, also where f uses it in a lambda over many elements."""
    return F.element_at(F.transform(F.array(value), f), 1)


def unit(v: Column) -> Column:
    """Unit vector; a zero or non-finite norm is an error."""
    error = F.raise_error(F.lit("a zero or non-finite vector has no direction")).cast("array<double>")
    return bound(norm(v), lambda n: F.when((n > 0) & (n < F.lit(float("inf"))), F.transform(v, lambda x: x / n)).otherwise(error))


def unit_or_zero(v: Column) -> Column:
    return bound(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; null where a norm is zero."""
    den = norm(a) * norm(b)
    return F.when(den > 0, clip(dot(a, b) / den))


def cosine_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(cosine(a, b), F.lit(0.0))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(v: Column, by: Column) -> Column:
    return bound(by, lambda k: F.transform(v, lambda x: x * k))


def reject(v: Column, direction: Column) -> Column:
    """What is left of v without its part along a direction."""
    error = F.raise_error(F.lit("a zero or non-finite vector has no direction")).cast("double")
    square = dot(direction, direction)
    part = F.when((square > 0) & (square < F.lit(float("inf"))), dot(v, direction) / square).otherwise(error)
    return bound(part, lambda k: F.zip_with(v, direction, lambda x, d: x - k * d))


def masked_add(v: Column, delta: Column, mask: Column) -> Column:
    return F.when(mask, plus(v, delta)).otherwise(v)


def slices(v: Column, width: int, layer: Column) -> Column:
    """The layer-th run of width elements."""
    return F.slice(v, layer * width + 1, F.lit(width))


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(v, lambda x: x - top - F.log(total))


def divergence(p: Column, q: Column) -> Column:
    """KL divergence of q from p, both as logarithms of probabilities."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)
