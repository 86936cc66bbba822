"""Reductions of one array of realizations per row, all inside the projection: no explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once. An expression named inside a lambda is otherwise
    evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean(a: Column) -> Column:
    """The values that are neither null nor NaN."""
    return F.filter(F.transform(a, lambda x: x.cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))


def array_var(a: Column) -> Column:
    """Population variance."""
    square = lambda a: let(array_mean(a), lambda m: F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a))
    return let(a, lambda a: F.when(F.size(a) > 0, square(a)))


def sorted_quantile(s: Column, q: float | Column) -> Column:
    """Quantile of a sorted array with linear interpolation between order statistics; null if empty."""
    at = (F.lit(float(q)) if not isinstance(q, Column) else q) * (F.size(s) - 1)
    low = F.floor(at).cast("int")
    a = F.try_element_at(s, low + 1)
    b = F.try_element_at(s, F.least(low + 2, F.size(s)))
    return F.when(F.size(s) > 0, a + (b - a) * (at - low))


def quantiles(sims: Column, probabilities: list[float]) -> Column:
    """map<probability, quantile> of an array of realizations."""
    return let(F.array_sort(clean(sims)), lambda s: F.create_map(*(x for p in probabilities for x in (F.lit(float(p)), sorted_quantile(s, p)))))


def cdf(sims: Column, cutoff: float | Column) -> Column:
    """Share of realizations at or below a cut-off; null if there are none."""
    c = F.lit(float(cutoff)) if not isinstance(cutoff, Column) else cutoff
    return let(clean(sims), lambda v: F.when(F.size(v) > 0, F.size(F.filter(v, lambda x: x <= c)) / F.size(v)))


def crps(truth: Column, sims: Column) -> Column:
    """Energy form of the score, mean |X - y| - mean |X - X'| / 2, from one sorted pass."""

    def score(s: Column) -> Column:
        miss = array_mean(F.transform(s, lambda x: F.abs(x - truth)))
        # The sum over pairs of |x_i - x_j| is 2 * sum_i (2 i - n + 1) x_i, i from 0.
        spread = let(F.size(s), lambda n: array_sum(F.transform(s, lambda x, i: x * (2 * i - n + 1))) / (n * n))
        return F.when(F.size(s) > 0, miss - spread)

    return let(F.array_sort(clean(sims)), score)


def interval_score(truth: Column, sims: Column, alpha: float = 0.05) -> Column:
    """Width of the central interval plus 2 / alpha times how far the truth lies outside."""
    zero = F.lit(0.0)
    ends = let(F.array_sort(clean(sims)), lambda s: F.struct(sorted_quantile(s, alpha / 2).alias("a"), sorted_quantile(s, 1 - alpha / 2).alias("b")))
    return let(ends, lambda e: (e["b"] - e["a"]) + 2 / alpha * (F.greatest(e["a"] - truth, zero) + F.greatest(truth - e["b"], zero)))


def simplex(z: Column) -> Column:
    """Euclidean projection of an array onto the unit simplex (sparsemax)."""


    def threshold(down: Column) -> Column:
        tops = F.transform(down, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("k"), array_sum(F.slice(down, F.lit(1), i + 1)).alias("c")))
        held = F.filter(tops, lambda t: 1 + t["k"] * t["x"] > t["c"])
        return F.get(F.transform(F.slice(held, -1, 1), lambda t: (t["c"] - 1) / t["k"]), F.lit(0))

    tau = let(F.reverse(F.transform(F.array_sort(z), lambda x: x.cast("double"))), threshold)
    return F.when(F.size(z) > 0, let(tau, lambda t: F.transform(z, lambda x: F.greatest(x - t, F.lit(0.0)))))
