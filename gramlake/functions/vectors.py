"""Array expressions: norms, products and distances of ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x) -> Column:
    return F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v)


def dot(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: a * b))


def norm(x) -> Column:
    return F.sqrt(F.aggregate(_c(x), F.lit(0.0), lambda a, v: a + v * v))


def once(x, of) -> Column:
    """of(x), where x is computed once a row. A lambda computes what it refers to again for each element,
    unless that is a variable of a lambda around it."""
    return F.element_at(F.transform(F.array(_c(x)), of), 1)


def unit(x, floor: float = 1e-10) -> Column:
    """x over its norm, the norm not under floor."""
    return once(x, lambda y: once(F.greatest(norm(y), F.lit(floor)), lambda n: F.transform(y, lambda v: v / n)))


def distance(x, y) -> Column:
    return F.sqrt(total(F.zip_with(_c(x), _c(y), lambda a, b: (a - b) * (a - b))))


def running(x) -> Column:
    """SP8: cumulative sums."""
    start = F.array().cast("array<double>")
    return F.aggregate(_c(x), start, lambda a, v: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + v)))


def shares(x, eps: float = 1e-12) -> Column:
    """x over its sum plus eps."""
    return once(x, lambda y: once(total(y) + F.lit(eps), lambda s: F.transform(y, lambda v: v / s)))


def l1(x, y) -> Column:
    return total(F.zip_with(_c(x), _c(y), lambda a, b: F.abs(a - b)))


def padded(x, n) -> Column:
    """x with zeros up to length n."""
    return F.concat(_c(x), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), _c(n) - F.size(_c(x)))))
