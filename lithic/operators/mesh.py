"""Triangulated surfaces as two tables, vertex (v, x, y, z) and face (f, a, b, c), and tests of points against them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithic.functions.core import BROADCAST_ROWS
from lithic.operators.connect import connected

XYZ = ("x", "y", "z")
#: Faces up to which a mesh is joined by broadcast.
BROADCAST_FACES = 500_000


def _corner(v: DataFrame, name: str) -> DataFrame:
    return v.select(F.col("v").alias(name), *(F.col(c).alias(f"{name}{c}") for c in XYZ))


def corners(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners: f, a, b, c, ax .. cz. Vertices are broadcast only if they are few (checked)."""
    few = vertex.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out, vertex = face, vertex if few else vertex.hint("merge")
    for k in "abc":
        out = out.join(_corner(vertex, k), k)
    return out


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def face_normals(full: DataFrame) -> list[Column]:
    """Components of (b - a) x (c - a): twice the face's area long."""
    u, v = ([F.col(f"{k}{c}") - F.col(f"a{c}") for c in XYZ] for k in "bc")
    return _cross(u, v)


def _length(n: list[Column]) -> Column:
    return F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])


def area(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """One row: the area of all faces."""
    full = corners(vertex, face)
    return full.agg(F.sum(_length(face_normals(full)) / 2).alias("area"))


def signed_volume(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """One row: the sum of signed tetrahedra from the origin; positive if faces turn outwards."""
    full = corners(vertex, face)
    b, c = ([F.col(f"{k}{x}") for x in XYZ] for k in "bc")
    n = _cross(b, c)
    return full.agg(F.sum((F.col("ax") * n[0] + F.col("ay") * n[1] + F.col("az") * n[2]) / 6).alias("volume"))


def vertex_normals(vertex: DataFrame, face: DataFrame) -> DataFrame:
    """v, nx, ny, nz: unit sum of the normals of a vertex's faces."""
    full = corners(vertex, face)
    n = face_normals(full)
    spread = full.select(F.explode(F.array("a", "b", "c")).alias("v"), *(k.alias(f"n{c}") for k, c in zip(n, XYZ)))
    total = spread.groupBy("v").agg(*(F.sum(f"n{c}").alias(f"n{c}") for c in XYZ))
    size = _length([F.col(f"n{c}") for c in XYZ])
    return total.withColumn("__s", size).select("v", *((F.col(f"n{c}") / F.col("__s")).alias(f"n{c}") for c in XYZ))


def weld(vertex: DataFrame, face: DataFrame, precision: int = 6) -> tuple[DataFrame, DataFrame]:
    """Vertices that round to the same place become the first of them."""
    place = [F.round(c, precision) + 0.0 for c in XYZ]
    keyed = vertex.select("v", *XYZ, *(p.alias(f"p{c}") for p, c in zip(place, XYZ)))
    first = keyed.groupBy(*(f"p{c}" for c in XYZ)).agg(F.min(F.struct("v", *XYZ)).alias("w"))
    to = keyed.join(first, [f"p{c}" for c in XYZ]).select(F.col("v").alias("old"), F.col("w.v").alias("new"))
    out = face
    for k in "abc":
        out = out.join(to.select(F.col("old").alias(k), F.col("new").alias(f"__{k}")), k).drop(k).withColumnRenamed(f"__{k}", k)
    return first.select("w.v", *(f"w.{c}" for c in XYZ)), out.select("f", "a", "b", "c")


def drop_degenerate(vertex: DataFrame, face: DataFrame, tiny: float = 1e-12) -> DataFrame:
    """Faces without repeated corners, without zero area, and each set of corners once (its lowest face)."""
    full = corners(vertex, face).where("a <> b AND b <> c AND a <> c")
    full = full.where(_length(face_normals(full)) > tiny)
    key = F.array_sort(F.array("a", "b", "c"))
    return full.groupBy(key.alias("k")).agg(F.min(F.struct("f", "a", "b", "c")).alias("s")).select("s.f", "s.a", "s.b", "s.c")


def fan_triangulation(polygons: DataFrame) -> DataFrame:
    """Polygons (p, corners array) as triangles (p, a, b, c) about their first corner."""
    i = F.explode(F.sequence(F.lit(2), F.size("corners") - 1))
    tri = polygons.where(F.size("corners") >= 3).select("p", "corners", i.alias("i"))
    return tri.select("p", F.col("corners")[0].alias("a"), F.element_at("corners", F.col("i")).alias("b"), F.element_at("corners", F.col("i") + 1).alias("c"))


def edges(face: DataFrame, directed: bool = False) -> DataFrame:
    """u, w, n: edges and how many faces have them."""
    pairs = face.select(F.explode(F.array(*(F.struct(F.col(p).alias("u"), F.col(q).alias("w")) for p, q in ("ab", "bc", "ca")))).alias("e")).select("e.u", "e.w")
    if not directed:
        pairs = pairs.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w"))
    return pairs.groupBy("u", "w").agg(F.count("*").alias("n"))


def open_edges(face: DataFrame) -> DataFrame:
    """Edges of one face only."""
    return edges(face).where("n = 1")


def reversed_edges(face: DataFrame) -> DataFrame:
    """Directed edges that occur more than once: two faces turn the same way about them."""
    return edges(face, True).where("n > 1")


def kind(vertex: DataFrame, face: DataFrame) -> str:
    """'solid' if closed and consistent, 'dtm' if open and single-valued, 'surface' if open, else 'mesh'."""
    row = edges(face).agg(F.min("n"), F.max("n")).first()
    turned = reversed_edges(face).isEmpty()
    if row[0] == row[1] == 2 and turned:
        return "solid"
    if row[1] is None or row[1] > 2 or not turned:
        return "mesh"
    return "dtm" if single_valued(vertex, face) else "surface"


def single_valued(vertex: DataFrame, face: DataFrame, tolerance: float = 1e-9) -> bool:
    """Whether plan projections of all faces turn the same way, up to a relative tolerance."""
    full = corners(vertex, face)
    z = face_normals(full)[2]
    low, high = full.agg(F.min(z), F.max(z)).first()
    if low is None:
        return True
    bound = tolerance * max(abs(low), abs(high))
    return low >= -bound or high <= bound


def pieces(face: DataFrame) -> DataFrame:
    """Faces with `piece`, the least vertex that their connected piece contains."""
    sides = face.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("w")), F.struct(F.col("b").alias("u"), F.col("c").alias("w")))).alias("e")).select("e.u", "e.w")
    roots = connected(sides).withColumnRenamed("node", "a").withColumnRenamed("root", "piece")
    return face.join(roots, "a", "left").select(*face.columns, F.coalesce("piece", "a").alias("piece"))


@dataclass(frozen=True)
class PlanIndex:
    """Faces dealt over plan cells of side `cell`, so that a point meets the faces above its own cell only."""

    faces: DataFrame
    cell: float

    @classmethod
    def of(cls, vertex: DataFrame, face: DataFrame, cell: float | None = None) -> PlanIndex:
        full = corners(vertex, face)
        low = {c: F.least(*(F.col(f"{k}{c}") for k in "abc")) for c in "xy"}
        high = {c: F.greatest(*(F.col(f"{k}{c}") for k in "abc")) for c in "xy"}
        if cell is None:
            cell = full.agg(F.avg(F.greatest(high["x"] - low["x"], high["y"] - low["y"]))).first()[0] or 1.0
        span = {c: F.sequence(F.floor(low[c] / cell), F.floor(high[c] / cell)) for c in "xy"}
        placed = full.withColumn("__i", F.explode(span["x"])).withColumn("__j", F.explode(span["y"]))
        n = placed.limit(BROADCAST_FACES + 1).count()
        return cls(F.broadcast(placed) if n <= BROADCAST_FACES else placed, float(cell))

    def hits(self, points: DataFrame, id_col: str) -> DataFrame:
        """Points with every face whose plan holds them: id, z, elevation on the face. Shared edges count for one side only."""
        keyed = points.select(id_col, *XYZ, F.floor(F.col("x") / self.cell).alias("__i"), F.floor(F.col("y") / self.cell).alias("__j"))
        joined = keyed.join(self.faces, ["__i", "__j"])
        px, py = F.col("x"), F.col("y")

        def inside(p: str, q: str) -> Column:
            """Whether a ray along +x from the point crosses the edge; half-open in y."""
            x0, y0, x1, y1 = F.col(f"{p}x"), F.col(f"{p}y"), F.col(f"{q}x"), F.col(f"{q}y")
            return F.when((y0 > py) != (y1 > py), (px < (x1 - x0) * (py - y0) / (y1 - y0) + x0).cast("int")).otherwise(0)

        crossed = inside("a", "b") + inside("b", "c") + inside("c", "a")
        n = face_normals(joined)
        z = F.col("az") - (n[0] * (px - F.col("ax")) + n[1] * (py - F.col("ay"))) / n[2]
        return joined.where((crossed % 2 == 1) & (n[2] != 0)).select(id_col, "z", z.alias("elevation"))


def sheet_elevation(points: DataFrame, vertex: DataFrame, face: DataFrame, id_col: str = "loc_id", cell: float | None = None) -> DataFrame:
    """id and the sheet's elevation at each point's x, y; null where it isn't covered."""
    found = PlanIndex.of(vertex, face, cell).hits(points, id_col).groupBy(id_col).agg(F.max("elevation").alias("elevation"))
    return points.select(id_col).join(found, id_col, "left")


def assign_from_surface(points: DataFrame, vertex: DataFrame, face: DataFrame, name: str, labels: tuple[str, str] = ("above", "below"), uncovered: str | None = None, id_col: str = "loc_id", cell: float | None = None) -> DataFrame:
    """Points with a label by the side of a single-valued sheet; a point on it is below. Uncovered: null, a label, or 'raise'."""
    joined = points.join(sheet_elevation(points, vertex, face, id_col, cell), id_col)
    missing = F.raise_error(F.lit("points outside the surface")).cast("string") if uncovered == "raise" else F.lit(uncovered)
    side = F.when(F.col("elevation").isNull(), missing).when(F.col("z") > F.col("elevation"), labels[0]).otherwise(labels[1])
    return joined.withColumn(name, side).drop("elevation")


def assign_from_solid(points: DataFrame, vertex: DataFrame, face: DataFrame, name: str, labels: tuple[str, str] = ("outside", "inside"), id_col: str = "loc_id", cell: float | None = None) -> DataFrame:
    """Points with a label by the parity of faces straight above them."""
    above = PlanIndex.of(vertex, face, cell).hits(points, id_col).where("elevation > z").groupBy(id_col).agg(F.count("*").alias("__n"))
    joined = points.join(above, id_col, "left")
    return joined.withColumn(name, F.when(F.coalesce("__n", F.lit(0)) % 2 == 1, labels[1]).otherwise(labels[0])).drop("__n")


def shares(sub_points: DataFrame, block: str, flag: Column) -> DataFrame:
    """Share of a block's sub-blocks with a flag, and whether the mesh crosses the block."""
    f = flag.cast("int")
    return sub_points.groupBy(block).agg(F.avg(f).alias("share"), (F.min(f) != F.max(f)).alias("crossed"))


def smooth(vertex: DataFrame, face: DataFrame, iterations: int = 20, shrink: float = 0.5, grow: float = -0.53) -> DataFrame:
    """Taubin smoothing: vertices move towards the mean of their neighbours, then away again."""
    ring = edges(face).select("u", "w")
    ring = ring.union(ring.select(F.col("w").alias("u"), F.col("u").alias("w")))
    v = vertex
    for _ in range(iterations):
        for factor in (shrink, grow):
            mean = ring.join(v, ring["w"] == v["v"]).groupBy("u").agg(*(F.avg(c).alias(f"m{c}") for c in XYZ)).withColumnRenamed("u", "v")
            v = v.join(mean, "v", "left").select("v", *((F.col(c) + factor * (F.coalesce(f"m{c}", F.col(c)) - F.col(c))).alias(c) for c in XYZ))
    return v


def terrain(points: DataFrame, nx: int, ny: int) -> DataFrame:
    """Faces of a lattice of nx by ny vertices numbered with x fastest: two per cell."""
    spark = points.sparkSession
    cell = spark.range((nx - 1) * (ny - 1)).select((F.col("id") % (nx - 1) + F.floor(F.col("id") / (nx - 1)) * nx).cast("long").alias("o"), "id")
    two = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("o").alias("a"), (F.col("o") + 1).alias("b"), (F.col("o") + nx + 1).alias("c")), F.struct(F.lit(1).alias("k"), F.col("o").alias("a"), (F.col("o") + nx + 1).alias("b"), (F.col("o") + nx).alias("c"))))
    return cell.select("id", two.alias("t")).select((F.col("id") * 2 + F.col("t.k")).alias("f"), "t.a", "t.b", "t.c")
