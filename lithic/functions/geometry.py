"""Directions, rotations and vectors as columns, with numpy twins for the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def azimuth_from_xy(x: Column, y: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(x, y)), F.lit(360.0))


def dip_from_vector(x: Column, y: Column, z: Column) -> Column:
    """Degrees below the horizontal, down positive."""
    return -F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))


def line_vector(azimuth: Column, dip: Column) -> Column:
    """Unit vector of a line that plunges by `dip` towards `azimuth`."""
    a, d = F.radians(azimuth), F.radians(dip)
    return F.array(F.sin(a) * F.cos(d), F.cos(a) * F.cos(d), -F.sin(d))


def plane_vectors(azimuth: Column, dip: Column) -> tuple[Column, Column]:
    """Dip vector and strike vector of a plane whose dip direction is `azimuth`."""
    a = F.radians(azimuth - 90)
    return line_vector(azimuth, dip), F.array(F.sin(a), F.cos(a), F.lit(0.0))


def cross(u: Column, v: Column) -> Column:
    return F.array(u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


def plane_normal(azimuth: Column, dip: Column) -> Column:
    """Minus the unit cross product of dip vector and strike vector."""
    n = cross(*plane_vectors(azimuth, dip))
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return F.transform(n, lambda x: -x / size)


def planes_to_directions(df: DataFrame, azimuth: str = "azimuth", dip: str = "dip") -> DataFrame:
    """Two rows per plane: its dip vector, then its strike vector, as `dir`."""
    return df.withColumn("dir", F.explode(F.array(*plane_vectors(F.col(azimuth), F.col(dip)))))


def rotation_matrix(azimuth: float = 0.0, dip: float = 0.0, rake: float = 0.0) -> np.ndarray:
    """Rotation by azimuth about z, dip (down positive) about x and rake about y, in degrees."""
    a, d, r = np.radians([azimuth, -dip, rake])
    rz = np.array([[np.cos(a), np.sin(a), 0], [-np.sin(a), np.cos(a), 0], [0, 0, 1]])
    rx = np.array([[1, 0, 0], [0, np.cos(d), -np.sin(d)], [0, np.sin(d), np.cos(d)]])
    ry = np.array([[np.cos(r), 0, np.sin(r)], [0, 1, 0], [-np.sin(r), 0, np.cos(r)]])
    return rz @ rx @ ry


def rotate(df: DataFrame, matrix: np.ndarray, origin: tuple[float, float, float] = (0.0, 0.0, 0.0), columns: tuple[str, str, str] = ("x", "y", "z"), inverse: bool = False) -> DataFrame:
    """Coordinates turned about `origin`: nine literal products in the projection."""
    m = np.asarray(matrix).T if inverse else np.asarray(matrix)
    shifted = [F.col(c) - o for c, o in zip(columns, origin)]
    turned = [sum((float(m[i, j]) * shifted[j] for j in range(1, 3)), float(m[i, 0]) * shifted[0]) + origin[i] for i in range(3)]
    return df.withColumns({f"__{c}": t for c, t in zip(columns, turned)}).drop(*columns).withColumnsRenamed({f"__{c}": c for c in columns})


def angles_from_matrix(matrix: np.ndarray) -> tuple[float, float, float]:
    """Azimuth, dip and rake of a rotation, dip not negative."""
    m = np.asarray(matrix)
    dip = -np.degrees(np.arcsin(np.clip(m[2, 1], -1, 1)))
    azimuth = np.degrees(np.arctan2(m[0, 1], m[1, 1]))
    rake = np.degrees(np.arctan2(-m[2, 0], m[2, 2]))
    if dip < 0:
        azimuth, dip, rake = azimuth + 180, -dip, -rake
    return float(azimuth % 360), float(dip), float(rake)


def axes_from_moments(covariance: np.ndarray) -> np.ndarray:
    """Right-handed axes of a 3 x 3 covariance, the longest as y, the second as x."""
    _, v = np.linalg.eigh(covariance)
    axes = v[:, ::-1][:, [1, 0, 2]]
    if np.linalg.det(axes) < 0:
        axes[:, 2] *= -1
    return axes


def bounding_box(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: lo_*, hi_*, mid_* of each coordinate and the box's diagonal."""
    lo, hi = {c: F.min(c) for c in columns}, {c: F.max(c) for c in columns}
    diagonal = F.sqrt(sum(((hi[c] - lo[c]) * (hi[c] - lo[c]) for c in columns), F.lit(0.0)))
    return df.agg(*(lo[c].alias(f"lo_{c}") for c in columns), *(hi[c].alias(f"hi_{c}") for c in columns), *(((lo[c] + hi[c]) / 2).alias(f"mid_{c}") for c in columns), diagonal.alias("diagonal"))


def in_box(columns: list[str], low: list[float], high: list[float], include_low: list[bool] | None = None, include_high: list[bool] | None = None) -> Column:
    """Box test per axis; by default the lower face belongs to the box and the upper one does not."""
    out = F.lit(True)
    for k, (c, a, b) in enumerate(zip(columns, low, high)):
        out &= (F.col(c) >= a) if include_low is None or include_low[k] else (F.col(c) > a)
        out &= (F.col(c) <= b) if include_high is not None and include_high[k] else (F.col(c) < b)
    return out


def boxes_overlap(low_a: list, high_a: list, low_b: list, high_b: list) -> bool:
    return all(a <= d and c <= b for a, b, c, d in zip(low_a, high_a, low_b, high_b))


def section(spark, center: tuple[float, float, float], azimuth: float, dip: float, width: float, height: float, n_x: int, n_y: int) -> DataFrame:
    """A regular plane of points about a centre: `azimuth` is its strike, `dip` how far it leans; first axis fastest."""
    a, d = np.radians(azimuth), np.radians(dip)
    along = np.array([np.sin(a), np.cos(a), 0.0])
    down = np.array([np.cos(a) * np.cos(d), -np.sin(a) * np.cos(d), -np.sin(d)])
    i, j = F.pmod(F.col("id"), F.lit(n_x)), F.floor(F.col("id") / n_x)
    u = (i / max(n_x - 1, 1) - 0.5) * width
    v = (0.5 - j / max(n_y - 1, 1)) * height
    points = spark.range(n_x * n_y)
    return points.select("id", *((F.lit(float(c)) + u * float(p) - v * float(q)).alias(k) for c, p, q, k in zip(center, along, down, "xyz")))


def disc_faces(df: DataFrame, azimuth: str = "azimuth", dip: str = "dip", size: float = 1.0, corners: int = 12) -> DataFrame:
    """Planes (loc_id, x, y, z, azimuth, dip) as discs: fans of triangles loc_id, k, ax .. cz about each centre."""
    u, v = plane_vectors(F.col(azimuth), F.col(dip))
    k = F.explode(F.sequence(F.lit(0), F.lit(corners - 1)))
    fan = df.withColumns({"__u": u, "__v": v, "k": k})

    def rim(step: int):
        t = (F.col("k") + step) * (2 * np.pi / corners)
        return [F.col(c) + size * (F.cos(t) * F.col("__u")[i] + F.sin(t) * F.col("__v")[i]) for i, c in enumerate("xyz")]

    ends = {"a": [F.col(c) for c in "xyz"], "b": rim(0), "c": rim(1)}
    return fan.select("loc_id", "k", *(e.alias(f"{n}{c}") for n, es in ends.items() for e, c in zip(es, "xyz")))
