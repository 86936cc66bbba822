"""Kernels, warpings and coordinate transforms as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Correlation profiles over a scaled distance (fixed formulas).
KERNELS = {
    "gaussian": lambda d: F.exp(-3 * d * d),
    "spherical": lambda d: F.when(d < 1, 1 - 1.5 * d + 0.5 * d * d * d).otherwise(0.0),
    "exponential": lambda d: F.exp(-3 * d),
    "cubic": lambda d: F.when(d < 1, 1 - 7 * d**2 + 8.75 * d**3 - 3.5 * d**5 + 0.75 * d**7).otherwise(0.0),
    "constant": lambda d: F.lit(1.0) + 0 * d,
    "cosine": lambda d: F.cos(2 * math.pi * d),
    "matern32": lambda d: (1 + 5 * d) * F.exp(-5 * d),
    "matern52": lambda d: (1 + 6 * d + 12 * d * d) * F.exp(-6 * d),
}


def rational_quadratic(d: Column, scale: float = 1.0) -> Column:
    return F.pow(1 + 3 * d * d / scale, F.lit(-scale))


def kernel(name: str, d: Column) -> Column:
    if name not in KERNELS:
        raise ValueError(f"unknown kernel {name!r}; known are {sorted(KERNELS)}")
    return KERNELS[name](d)


def distance(a: list[Column], b: list[Column], ranges: list[float] | None = None) -> Column:
    """Euclidean distance, each axis divided by its range."""
    scale = ranges or [1.0] * len(a)
    return F.sqrt(sum((((x - y) / r) ** 2 for x, y, r in zip(a, b, scale)), F.lit(0.0)))


def anisotropy_2d(x: Column, y: Column, max_range: float = 1.0, min_factor: float = 1.0, azimuth: float = 0.0) -> tuple[Column, Column]:
    """Coordinates along and across `azimuth`, divided by their ranges."""
    a = math.radians(azimuth)
    along, across = x * math.sin(a) + y * math.cos(a), x * math.cos(a) - y * math.sin(a)
    return along / max_range, across / (max_range * min_factor)


def isotropic(columns: list[Column], r: float = 1.0) -> list[Column]:
    return [c / r for c in columns]


def ard(columns: list[Column], ranges: list[float]) -> list[Column]:
    return [c / r for c, r in zip(columns, ranges)]


def normalize_box(columns: list[Column], low: list[float], high: list[float]) -> list[Column]:
    return [(c - a) / (b - a) for c, a, b in zip(columns, low, high)]


def periodic(columns: list[Column]) -> list[Column]:
    """Sines, then cosines, of the turns."""
    return [F.sin(2 * math.pi * c) for c in columns] + [F.cos(2 * math.pi * c) for c in columns]


def projection_1d(columns: list[Column], direction: list[float]) -> Column:
    size = math.sqrt(sum(d * d for d in direction))
    return sum((c * (d / size) for c, d in zip(columns, direction)), F.lit(0.0))


def fault_2d(x: Column, y: Column, start: tuple[float, float], end: tuple[float, float]) -> Column:
    """A bell-shaped jump across a segment: positive to its left, negative to its right, fading towards its ends."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    size = math.hypot(dx, dy)
    along = ((x - start[0]) * dx + (y - start[1]) * dy) / size**2
    side = F.signum((y - start[1]) * dx - (x - start[0]) * dy)
    u = 2 * along - 1
    return F.when(F.abs(u) < 1, side * (1 - u * u) * (1 - u * u)).otherwise(0.0)


def softplus_forward(x: Column, shift: float = 1e-6) -> Column:
    return F.when(x > 50, x).otherwise(F.log(F.expm1(F.least(x, F.lit(50.0)) + shift)))


def softplus_backward(z: Column, shift: float = 1e-6) -> Column:
    return F.when(z > 50, z).otherwise(F.log1p(F.exp(F.least(z, F.lit(50.0)))) - shift)


def log_forward(x: Column, shift: float = 1e-6) -> Column:
    return F.log(x + shift)


def log_backward(z: Column, shift: float = 1e-6) -> Column:
    """The exact inverse: the shift is taken off again."""
    return F.exp(z) - shift


def sigmoid_forward(x: Column, shift: float = 1e-6) -> Column:
    """Logit of a share drawn slightly towards one half."""
    p = x * (1 - 2 * shift) + shift
    return F.log(p / (1 - p))


def sigmoid_backward(z: Column, shift: float = 1e-6) -> Column:
    return (1 / (1 + F.exp(-z)) - shift) / (1 - 2 * shift)


def zscore(x: Column, mean: Column | float, std: Column | float) -> Column:
    return (x - mean) / std


def normal_cdf(x: Column) -> Column:
    """Normal distribution function by a rational approximation, to about 1e-7 (there is no erf in Spark SQL)."""
    z = F.abs(x)
    t = 1 / (1 + 0.2316419 * z)
    # Fixed coefficients of the approximation.
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)
