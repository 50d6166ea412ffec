"""Column functions with the numerical conventions of signal tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def half_even(x: Column, places: int = 2) -> Column:
    """Rounds x scaled by a power of ten to the even neighbour."""
    return F.rint(x * 10**places) / 10**places


def whole(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Log odds of a score kept within [eps, 1 - eps]."""
    p = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(p / (1 - p))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def relu6(x: Column) -> Column:
    return F.least(relu(x), F.lit(6.0))


def decibel_ratio(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return 10 * F.log10((a + eps) / (b + eps))


def power_to_db(p: Column, floor: float = 1e-10) -> Column:
    return 10 * F.log10(F.greatest(p, F.lit(floor)))


def argmax(values: Column) -> Column:
    """Position from 0 of the largest element, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pad_or_trim(samples: Column, n: int) -> Column:
    """The first n elements, with zeros after a shorter array."""
    return F.slice(F.concat(samples, F.array_repeat(F.lit(0.0), n)), 1, n)


def mono(channels: Column) -> Column:
    """Mean over the channels of each frame."""
    return F.transform(channels, lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c))
