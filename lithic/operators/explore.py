"""What a look at the data needs: bins, densities, components and running means, as small tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithic.functions.core import percentiles


def padded_range(df: DataFrame, column: str, margin: float = 0.1) -> DataFrame:
    """One row: low and high of a column, widened by a share of its span (by 1 if it has none)."""
    lo, hi = F.min(column), F.max(column)
    pad = F.when(hi > lo, (hi - lo) * margin).otherwise(1.0)
    return df.agg((lo - pad).alias("low"), (hi + pad).alias("high"))


def color_limits(df: DataFrame, column: str, clip: float | None = None) -> tuple[float, float] | None:
    """Two quantiles of the finite values; None if they are the same."""
    clip = clip or 0.0
    low, high = percentiles(df, column, [clip, 1 - clip])
    return None if low is None or low >= high else (low, high)


def counts_2d(df: DataFrame, x: str, y: str, low: tuple[float, float], high: tuple[float, float], bins: int = 60) -> DataFrame:
    """i, j, n: points per cell of a plane; empty cells are absent, the upper edges belong to the last cells."""
    step = [(b - a) / bins for a, b in zip(low, high)]
    cell = [F.least(F.floor((F.col(c) - a) / s), F.lit(bins - 1)).cast("int") for c, a, s in zip((x, y), low, step)]
    inside = F.col(x).between(low[0], high[0]) & F.col(y).between(low[1], high[1])
    return df.where(inside).groupBy(cell[0].alias("i"), cell[1].alias("j")).agg(F.count("*").alias("n"))


def bin_count(n_points: int, most: int) -> int:
    """Cells per axis for a sample: its cube root doubled, `most` at most."""
    return max(1, min(most, math.ceil(2 * n_points ** (1 / 3))))


def density_curve(df: DataFrame, column: str, low: float, high: float, points: int = 200, bins: int = 2_000) -> DataFrame:
    """x, density: a Gaussian kernel estimate with Scott's width.

    All values count: they are binned finely first, so that the sum runs over bins times points.
    """
    n, std = df.agg(F.count(column), F.stddev_pop(column)).first()
    width = max((std or 0.0) * max(n, 1) ** -0.2, (high - low) / bins)
    lo, step = low - 4 * width, (high - low + 8 * width) / bins
    binned = df.where(F.col(column).isNotNull()).groupBy(F.floor((F.col(column) - lo) / step).alias("b")).agg(F.count("*").alias("n"), F.avg(column).alias("v"))
    grid = F.explode(F.array(*(F.lit(float(g)) for g in np.linspace(low, high, points))))
    d = (F.col("x") - F.col("v")) / width
    return binned.where(F.col("b").between(-1, bins)).select("n", "v", grid.alias("x")).groupBy("x").agg((F.sum(F.col("n") * F.exp(-d * d / 2)) / (n * width * math.sqrt(2 * math.pi))).alias("density"))


def density_grid(df: DataFrame, x: str, y: str, low: tuple[float, float], high: tuple[float, float], grid: int = 60, bins: int = 120) -> DataFrame:
    """x, y, density on a mesh, from all points binned finely first."""
    n, sx, sy = df.agg(F.count("*"), F.stddev_pop(x), F.stddev_pop(y)).first()
    width = [max((s or 0.0) * max(n, 1) ** (-1 / 6), (b - a) / bins) for s, a, b in zip((sx, sy), low, high)]
    binned = df.dropna(subset=[x, y]).groupBy(*(F.floor((F.col(c) - a) / ((b - a) / bins)).alias(k) for c, k, a, b in zip((x, y), "ij", low, high))).agg(F.count("*").alias("n"), F.avg(x).alias("u"), F.avg(y).alias("v"))
    gx, gy = (F.explode(F.array(*(F.lit(float(g)) for g in np.linspace(a, b, grid)))) for a, b in zip(low, high))
    spread = binned.select("n", "u", "v", gx.alias("x")).where(F.abs(F.col("x") - F.col("u")) < 6 * width[0]).select("*", gy.alias("y")).where(F.abs(F.col("y") - F.col("v")) < 6 * width[1])
    q = ((F.col("x") - F.col("u")) / width[0]) ** 2 + ((F.col("y") - F.col("v")) / width[1]) ** 2
    return spread.groupBy("x", "y").agg((F.sum(F.col("n") * F.exp(-q / 2)) / (n * 2 * math.pi * width[0] * width[1])).alias("density"))


def normal_curve(df: DataFrame, column: str, low: float, high: float, points: int = 200) -> DataFrame:
    """x, density of the normal with a column's mean and deviation."""
    m, s = df.agg(F.avg(column), F.stddev_pop(column)).first()
    x = df.sparkSession.range(points).select((F.lit(low) + F.col("id") * ((high - low) / max(points - 1, 1))).alias("x"))
    d = (F.col("x") - m) / s
    return x.withColumn("density", F.exp(-d * d / 2) / (s * math.sqrt(2 * math.pi)))


def moving_average(df: DataFrame, order: str, value: str, window: int, by: list[str] = ()) -> DataFrame:
    """Mean of `window` successive values, where there are as many. Give `by` for large tables: each group is one window."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(window - 1), 0)
    return df.withColumn("average", F.avg(value).over(w)).withColumn("__n", F.count("*").over(w)).where(F.col("__n") == window).drop("__n")


def step_path(bins: DataFrame) -> DataFrame:
    """Bins (lo, hi, value) as corner points of a line, with a null where a bin doesn't touch the one before."""
    w = Window.orderBy("lo")
    gap = F.lag("hi").over(w).isNotNull() & (F.abs(F.lag("hi").over(w) - F.col("lo")) > 1e-12)
    at = F.row_number().over(w)
    points = F.array(F.when(F.col("__gap"), F.struct(F.lit(0).alias("k"), F.col("lo").alias("x"), F.lit(None).cast("double").alias("y"))), F.struct(F.lit(1).alias("k"), F.col("lo").alias("x"), F.col("value").alias("y")), F.struct(F.lit(2).alias("k"), F.col("hi").alias("x"), F.col("value").alias("y")))
    marked = bins.withColumns({"bin": at, "__gap": gap})
    return marked.select("bin", F.explode(F.filter(points, lambda p: p.isNotNull())).alias("p")).select("bin", "p.k", "p.x", "p.y")


def strided(df: DataFrame, order: str, stride: int) -> DataFrame:
    """Every stride-th row by a dense id, whole rows kept."""
    return df.where(F.pmod(order, F.lit(stride)) == 0)


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population covariance and number of complete rows, in one aggregate of d * d sums."""
    full = df.dropna(subset=columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = full.agg(F.count("*"), *(F.avg(c) for c in columns), *(F.covar_pop(a, b) for a, b in pairs)).first()
    d = len(columns)
    cov = np.zeros((d, d))
    for (a, b), v in zip(pairs, row[1 + d :]):
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = v
    return np.array(row[1 : 1 + d], float), cov, row[0]


def principal_components(df: DataFrame, columns: list[str], explained: float = 0.9) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows with scores pc_0, pc_1, .. on as few components as reach the share (two at least); axes and shares."""
    mean, cov, _ = moments(df, columns)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, axes = np.maximum(values[order], 0), axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(len(order))] < 0, -1, 1)
    share = values / values.sum()
    k = min(len(columns), max(2, int(np.searchsorted(np.cumsum(share), explained - 1e-12) + 1)))
    scores = {f"pc_{j}": sum(((F.col(c) - float(m)) * float(axes[i, j]) for i, (c, m) in enumerate(zip(columns, mean))), F.lit(0.0)) for j in range(k)}
    return df.withColumns(scores), axes[:, :k], share[:k]


def logarithm(df: DataFrame, columns: list[str], compositional: bool = False) -> DataFrame:
    """Columns as logs or centred log ratios; values that are not positive are refused by name."""
    low = df.agg(*(F.min(c).alias(c) for c in columns)).first()
    bad = [c for c in columns if low[c] is not None and low[c] <= 0]
    if bad:
        raise ValueError(f"not positive: {bad}")
    logs = {c: F.log(c) for c in columns}
    if not compositional:
        return df.withColumns(logs)
    mean = sum((logs[c] for c in columns[1:]), logs[columns[0]]) / len(columns)
    return df.withColumns({c: logs[c] - mean for c in columns})


def plotting_positions(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """Rows with their Hazen position (rank - 1/2) / n within each group."""
    w = Window.partitionBy(*by)
    return df.withColumn("position", (F.row_number().over(w.orderBy(column)) - 0.5) / F.count("*").over(w))


def weighted_quantiles(df: DataFrame, value: str, weight: str, probabilities: list[float], by: list[str] = ()) -> DataFrame:
    """Quantiles by the midpoint rule: linear in the cumulated weight up to the middle of each value."""
    w = Window.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), ((run - F.col(weight) / 2) / F.sum(weight).over(w)).alias("p"))
    nxt = placed.withColumns({"v1": F.lead("v").over(w.orderBy("p")), "p1": F.lead("p").over(w.orderBy("p")), "first": F.row_number().over(w.orderBy("p")) == 1})
    out = nxt.withColumn("q", F.explode(F.array(*(F.lit(float(x)) for x in probabilities))))
    inside = (F.col("q") >= F.col("p")) & (F.col("p1").isNull() | (F.col("q") < F.col("p1")))
    under = F.col("first") & (F.col("q") < F.col("p"))
    value_at = F.when(inside & F.col("p1").isNotNull(), F.col("v") + (F.col("v1") - F.col("v")) * (F.col("q") - F.col("p")) / (F.col("p1") - F.col("p"))).otherwise(F.col("v"))
    return out.where(inside | under).select(*by, F.col("q").alias("probability"), value_at.alias("value"))

