"""Regular lattices: implicit rows from `spark.range`, point-to-cell keys, and aggregation onto cells."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.functions.core import nan_to_null
from lithic.functions.geometry import axes_from_moments, rotate

AXES = ("x", "y", "z", "w", "v", "u")


@dataclass(frozen=True)
class Grid:
    """A lattice of any dimension; only its parameters are kept. The first axis varies fastest in `cell`."""

    start: tuple[float, ...]
    n: tuple[int, ...]
    step: tuple[float, ...]
    labels: tuple[str, ...] = ()
    rotation: tuple[tuple[float, ...], ...] | None = None
    discretization: tuple[int, ...] = ()

    @classmethod
    def of(cls, start, n, step=None, end=None, labels=None, rotation=None, discretization=()) -> Grid:
        start, n = tuple(map(float, np.atleast_1d(start))), tuple(map(int, np.atleast_1d(n)))
        if (step is None) == (end is None):
            raise ValueError("give either step or end")
        step = tuple(map(float, np.atleast_1d(step))) if step is not None else tuple((float(e) - s) / max(k - 1, 1) for s, e, k in zip(start, np.atleast_1d(end), n))
        if any(s <= 0 for s in step):
            raise ValueError("steps must be positive")
        turned = None if rotation is None else tuple(map(tuple, np.asarray(rotation, float).tolist()))
        return cls(start, n, step, tuple(labels or AXES[: len(n)]), turned, tuple(discretization))

    @property
    def size(self) -> int:
        return math.prod(self.n)

    def index_of(self, cell: Column) -> list[Column]:
        """Integer position per axis of a cell number."""
        out, rest = [], cell
        for k in self.n:
            out.append(F.pmod(rest, F.lit(k)).cast("int"))
            rest = F.floor(rest / k)
        return out

    def rows(self, spark: SparkSession) -> DataFrame:
        """cell and the coordinates of its centre, made up by the executors."""
        at = self.index_of(F.col("cell"))
        df = spark.range(self.size).withColumnRenamed("id", "cell")
        df = df.select("cell", *((i * s + o).alias(c) for i, s, o, c in zip(at, self.step, self.start, self.labels)))
        return self.to_world(df)

    def to_world(self, df: DataFrame) -> DataFrame:
        return df if self.rotation is None else rotate(df, np.array(self.rotation), self.start[:3], self.labels[:3])

    def to_lattice(self, df: DataFrame) -> DataFrame:
        return df if self.rotation is None else rotate(df, np.array(self.rotation), self.start[:3], self.labels[:3], inverse=True)

    def keys(self) -> list[Column]:
        """Position per axis of the cell that a point lies in; a point on a face belongs to the lower cell. May lie outside."""
        return [F.ceil((F.col(c) - o - s / 2) / s).cast("long") for c, o, s in zip(self.labels, self.start, self.step)]

    def cell_of(self) -> Column:
        """Number of the cell that a point lies in, null outside."""
        keys = self.keys()
        inside, flat, scale = F.lit(True), F.lit(0).cast("long"), 1
        for k, n in zip(keys, self.n):
            inside &= (k >= 0) & (k < n)
            flat += k * scale
            scale *= n
        return F.when(inside, flat)

    def with_cell(self, points: DataFrame) -> DataFrame:
        """Points with their cell; coordinates stay as they are."""
        if self.rotation is None:
            return points.withColumn("cell", self.cell_of())
        turned = self.to_lattice(points.withColumns({f"__w_{c}": F.col(c) for c in self.labels}))
        return turned.withColumn("cell", self.cell_of()).drop(*self.labels).withColumnsRenamed({f"__w_{c}": c for c in self.labels})

    def sub_offsets(self) -> list[tuple[float, ...]]:
        """Centres of a cell's sub-cells, from its own centre, first axis fastest."""
        d = self.discretization or (1,) * len(self.n)
        return [tuple(((i + 0.5) / k - 0.5) * s for i, k, s in zip(p[::-1], d, self.step)) for p in product(*(range(k) for k in d[::-1]))]

    def sub_rows(self, spark: SparkSession) -> DataFrame:
        """cell, sub and the coordinates of every sub-cell's centre."""
        offsets = F.array(*(F.struct(F.lit(i).alias("sub"), *(F.lit(v).alias(f"d_{c}") for v, c in zip(o, self.labels))) for i, o in enumerate(self.sub_offsets())))
        plain = Grid(self.start, self.n, self.step, self.labels)
        df = plain.rows(spark).withColumn("__o", F.explode(offsets))
        return self.to_world(df.select("cell", "__o.sub", *((F.col(c) + F.col(f"__o.d_{c}")).alias(c) for c in self.labels)))

    @property
    def cell_volume(self) -> float:
        return math.prod(self.step)

    def subset(self, spark: SparkSession, low, high, include_low=None, include_high=None) -> DataFrame:
        """Points of the lattice in a box, cell numbers kept; on an unrotated lattice only those near the box are made up."""
        from lithic.functions.geometry import in_box

        test = in_box(list(self.labels), list(low), list(high), include_low, include_high)
        if self.rotation is not None:
            return self.rows(spark).where(test)
        first = [max(0, math.floor((a - o) / s)) for a, o, s in zip(low, self.start, self.step)]
        last = [min(n - 1, math.ceil((b - o) / s)) for b, o, s, n in zip(high, self.start, self.step, self.n)]
        count = [max(0, b - a + 1) for a, b in zip(first, last)]
        if not all(count):
            return self.rows(spark).where(F.lit(False))
        part = Grid(tuple(o + i * s for o, i, s in zip(self.start, first, self.step)), tuple(count), self.step, self.labels)
        number, scale = F.lit(0).cast("long"), 1
        for i, a, n in zip(part.index_of(F.col("cell")), first, self.n):
            number, scale = number + (i + a) * scale, scale * n
        return part.rows(spark).withColumn("cell", number).where(test)


def cover(df: DataFrame, columns: list[str], step, margin: float = 0.1, decimals: int = 0) -> Grid:
    """The lattice that covers points with a margin (a share of the extent), its start rounded down to `decimals`."""
    step = np.broadcast_to(np.asarray(step, float), len(columns))
    if (step <= 0).any():
        raise ValueError("steps must be positive")
    row = df.agg(*(F.min(c) for c in columns), *(F.max(c) for c in columns)).first()
    low, high = np.array(row[: len(columns)], float), np.array(row[len(columns) :], float)
    pad = (high - low) * margin
    start = np.floor((low - pad) * 10**decimals) / 10**decimals
    n = np.ceil((high + pad - start) / step - 1e-9).astype(int) + 1
    return Grid.of(start, n, step, labels=tuple(columns))


def rotated_cover(df: DataFrame, step, margin: float = 0.1, decimals: int = 0) -> Grid:
    """A rotated lattice along the principal axes of 3-D points; only their moments reach the driver."""
    c = ("x", "y", "z")
    pairs = [(a, b) for a in c for b in c]
    row = df.agg(*(F.covar_pop(a, b) for a, b in pairs), *(F.avg(a) for a in c)).first()
    axes, centre = axes_from_moments(np.array(row[:9]).reshape(3, 3)), tuple(row[9:])
    flat = cover(rotate(df, axes, centre, inverse=True), list(c), step, margin, decimals)
    corner = axes @ (np.array(flat.start) - centre) + centre
    return Grid.of(corner, flat.n, flat.step, labels=c, rotation=axes)


def dominant(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Per key the label seen most often; null on a tie and where none was seen. Empty labels don't count."""
    counts = df.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    ranked = counts.withColumn("__top", F.max("__n").over(Window.partitionBy(*keys))).where("__n = __top")
    winners = ranked.groupBy(*keys).agg(F.count("*").alias("__w"), F.first(column).alias("__l"))
    return winners.select(*keys, F.when(F.col("__w") == 1, F.col("__l")).alias(column))


def aggregate(grid: Grid, points: DataFrame, means: list[str] = (), labels: list[str] = (), compositions: list[list[str]] = (), pairs: list[tuple[str, str]] = ()) -> DataFrame:
    """Points onto cells: means of numbers, dominant labels, means of compositions closed again, and of
    pairs of labels (two sides of a contact) the dominant of both. Cells without points are absent."""
    placed = grid.with_cell(nan_to_null(points)).where("cell is not null")
    out = placed.groupBy("cell").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in means), *(F.avg(F.when(_complete(parts), F.col(c))).alias(c) for parts in compositions for c in parts))
    for parts in compositions:
        whole = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
        out = out.withColumn("__s", whole).withColumns({c: F.col(c) / F.col("__s") for c in parts}).drop("__s")
    for c in labels:
        out = out.join(dominant(placed, ["cell"], c), "cell", "left")
    for a, b in pairs:
        both = placed.select("cell", F.explode(F.array(a, b)).alias(a))
        out = out.join(dominant(both, ["cell"], a), "cell", "left")
    return out


def _complete(parts: list[str]) -> Column:
    out = F.lit(True)
    for c in parts:
        out &= F.col(c).isNotNull()
    return out


def smooth(grid: Grid, values: DataFrame, column: str, sigma: float) -> DataFrame:
    """Gaussian filter of a lattice column, axis by axis: each is a join with a short list of offsets. Edges are mirrored."""
    reach = max(1, int(4 * sigma + 0.5))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight /= weight.sum()
    scale, df = 1, values.select("cell", column)
    for n in grid.n:
        if n > 1:
            moves = F.array(*(F.struct(F.lit(int(o)).alias("o"), F.lit(float(w)).alias("w")) for o, w in zip(range(-reach, reach + 1), weight)))
            i = F.pmod(F.floor(F.col("cell") / scale), F.lit(n))
            spread = df.withColumn("__i", i).withColumn("__m", F.explode(moves))
            # Where a mirrored neighbour falls: reflect about the outer faces.
            to = F.pmod(F.col("__i") + F.col("__m.o"), F.lit(2 * n))
            to = F.when(to >= n, 2 * n - 1 - to).otherwise(to)
            df = spread.withColumn("cell", F.col("cell") + (to - F.col("__i")) * scale).groupBy("cell").agg(F.sum(F.col(column) * F.col("__m.w")).alias(column))
        scale *= n
    return df


def laplacian(grid: Grid, values: DataFrame, column: str, axis: int) -> DataFrame:
    """Second differences along one axis, zero where a neighbour is missing."""
    scale = math.prod(grid.n[:axis])
    n = grid.n[axis]
    i = F.pmod(F.floor(F.col("cell") / scale), F.lit(n))
    line = F.col("cell") - i * scale
    w = Window.partitionBy("__line").orderBy("__i")
    df = values.select("cell", column, i.alias("__i"), line.alias("__line"))
    before, after = F.lag(column).over(w), F.lead(column).over(w)
    steady = (F.col("__i") - F.lag("__i").over(w) == 1) & (F.lead("__i").over(w) - F.col("__i") == 1)
    return df.select("cell", F.when(steady, before - 2 * F.col(column) + after).otherwise(0.0).alias(column))
