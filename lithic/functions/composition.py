"""Compositions: parts of a whole as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithic.functions.arrays import array_mean, array_sum, let


def parts(*columns: Column | str) -> Column:
    return F.array(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns))


def close(p: Column) -> Column:
    """Parts divided by their sum."""
    return let(array_sum(p), lambda s: F.transform(p, lambda x: x / s))


def is_closed(p: Column, tolerance: float = 1e-10) -> Column:
    """Whether all parts are there and add up to 1; otherwise a row counts as missing."""
    return F.forall(p, lambda x: x.isNotNull()) & (F.abs(array_sum(p) - 1) < tolerance)


def clr(p: Column) -> Column:
    """Centred log ratios."""
    return let(F.transform(p, lambda x: F.log(x)), lambda logs: let(array_mean(logs), lambda m: F.transform(logs, lambda x: x - m)))


def clr_inverse(z: Column) -> Column:
    """Softmax, the inverse of `clr`."""
    return close(let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))


def aitchison(a: Column, b: Column) -> Column:
    """Euclidean distance between centred log ratios."""
    return F.sqrt(array_sum(F.zip_with(clr(a), clr(b), lambda x, y: (x - y) * (x - y))))
