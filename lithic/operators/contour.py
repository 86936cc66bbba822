"""Level surfaces of lattice values, distances to meshes, and solids combined through fields."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithic.functions.core import cut, small_side
from lithic.operators.lattice import Grid
from lithic.operators.mesh import assign_from_solid, corners, drop_degenerate, weld

#: Tetrahedra about a cube's main diagonal; corner k lies at bits x = 1, y = 2, z = 4 of k.
TETRAHEDRA = np.array([[0, 1, 3, 7], [0, 3, 2, 7], [0, 2, 6, 7], [0, 6, 4, 7], [0, 4, 5, 7], [0, 5, 1, 7]])
#: Faces up to which a mesh is sent to every task for distances.
DISTANCE_FACES = 100_000


def triangles_of(values: np.ndarray, origin: np.ndarray, step: np.ndarray, level: float) -> np.ndarray:
    """Triangles (n, 3, 3) where cubes (values (n, 8), low corners) cross a level, turned towards lower values."""
    bits = np.array([[k & 1, k >> 1 & 1, k >> 2 & 1] for k in range(8)], float)
    out = []
    for tet in TETRAHEDRA:
        v = values[:, tet]
        above = v >= level
        n = above.sum(1)
        points = origin[:, None] + bits[tet][None] * step
        # Corners above first: then every case is a matter of how many there are.
        order = np.argsort(~above, axis=1, kind="stable")
        v, p = np.take_along_axis(v, order, 1), np.take_along_axis(points, order[..., None], 1)

        def cut(rows, i, j, v=v, p=p):
            t = ((level - v[rows, i]) / (v[rows, j] - v[rows, i]))[:, None]
            return p[rows, i] + t * (p[rows, j] - p[rows, i])

        found = []
        for count, fans in ((1, [((0, 1), (0, 2), (0, 3))]), (3, [((0, 3), (1, 3), (2, 3))]), (2, [((0, 2), (0, 3), (1, 3)), ((0, 2), (1, 3), (1, 2))])):
            rows = np.flatnonzero(n == count)
            for fan in fans:
                if len(rows):
                    found.append((rows, count, np.stack([cut(rows, i, j) for i, j in fan], 1)))
        for rows, count, tri in found:
            down = p[rows, count:].mean(1) - p[rows, :count].mean(1)
            normal = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
            flip = (normal * down).sum(1) < 0
            tri[flip] = tri[flip][:, ::-1]
            out.append(tri)
    return np.concatenate(out) if out else np.zeros((0, 3, 3))


def contour(grid: Grid, values: DataFrame, column: str, level: float, close: float | None = None) -> tuple[DataFrame, DataFrame]:
    """vertex and face of a level surface of a 3-D lattice column (cell, column).

    Every node goes to the eight cubes it is a corner of; cubes are gathered by key and cut by
    marching tetrahedra, in parallel. With `close` the lattice is framed by that value, which closes
    surfaces that would leave it.
    """
    nx, ny, nz = grid.n
    i, j, k = (c.cast("long") for c in grid.index_of(F.col("cell")))
    nodes = values.select(i.alias("i"), j.alias("j"), k.alias("k"), F.col(column).cast("double").alias("v"))
    low = 0
    if close is not None:
        spark, low = values.sparkSession, -1
        frame = spark.range((nx + 2) * (ny + 2) * (nz + 2)).select((F.col("id") % (nx + 2) - 1).alias("i"), (F.floor(F.col("id") / (nx + 2)) % (ny + 2) - 1).alias("j"), (F.floor(F.col("id") / ((nx + 2) * (ny + 2))) - 1).alias("k"))
        outside = frame.where(f"i = -1 OR i = {nx} OR j = -1 OR j = {ny} OR k = -1 OR k = {nz}")
        nodes = nodes.union(outside.select("i", "j", "k", F.lit(float(close))))
    moves = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(c & 1).alias("x"), F.lit(c >> 1 & 1).alias("y"), F.lit(c >> 2 & 1).alias("z")) for c in range(8)))
    spread = nodes.withColumn("m", F.explode(moves)).select((F.col("i") - F.col("m.x")).alias("i"), (F.col("j") - F.col("m.y")).alias("j"), (F.col("k") - F.col("m.z")).alias("k"), "m.c", "v")
    cubes = spread.groupBy("i", "j", "k").agg(F.count("v").alias("n"), *(F.max(F.when(F.col("c") == c, F.col("v"))).alias(f"v{c}") for c in range(8)), F.min("v").alias("lo"), F.max("v").alias("hi"))
    crossed = cubes.where((F.col("n") == 8) & (F.col("lo") < level) & (F.col("hi") >= level) & (F.col("i") >= low))
    start, step = np.array(grid.start), np.array(grid.step)

    def run(batches):
        for b in batches:
            at = np.stack([b.column(c).to_numpy() for c in "ijk"], 1)
            v = np.stack([b.column(f"v{c}").to_numpy(zero_copy_only=False) for c in range(8)], 1)
            t = triangles_of(v, start + at * step, step, level).reshape(-1, 9)
            yield pa.RecordBatch.from_arrays([pa.array(t[:, c]) for c in range(9)], [f"{k}{c}" for k in "abc" for c in "xyz"])

    tri = crossed.select("i", "j", "k", *(f"v{c}" for c in range(8))).mapInArrow(run, ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    # Numbers must not change when a lost task is repeated: rank triangles by what they are.
    tri = tri.withColumn("f", F.xxhash64(*tri.columns))
    vertex = tri.select("f", F.explode(F.array(*(F.struct(*(F.round(f"{k}{c}", 9).alias(c) for c in "xyz"), F.lit(n).alias("n")) for n, k in enumerate("abc")))).alias("p")).select("f", "p.n", F.xxhash64("p.x", "p.y", "p.z").alias("v"), "p.x", "p.y", "p.z")
    face = vertex.groupBy("f").agg(*(F.max(F.when(F.col("n") == n, F.col("v"))).alias(k) for n, k in enumerate("abc")))
    points = vertex.select("v", "x", "y", "z").distinct()
    if grid.rotation is not None:
        points = grid.to_world(points.withColumnsRenamed(dict(zip("xyz", grid.labels)))).withColumnsRenamed(dict(zip(grid.labels, "xyz")))
    points, face = weld(points, face)
    return points, drop_degenerate(points, face)


def triangle_distances_each(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of points to triangles, by broadcasting over all but the last axis."""
    ab, ac = b - a, c - a
    d00, d01, d11 = (ab * ab).sum(-1), (ab * ac).sum(-1), (ac * ac).sum(-1)
    det = np.maximum(d00 * d11 - d01 * d01, 1e-300)

    def to_edge(s, e):
        t = np.clip(((p - s) * e).sum(-1) / np.maximum((e * e).sum(-1), 1e-300), 0, 1)
        return ((p - s - t[..., None] * e) ** 2).sum(-1)

    ap = p - a
    d20, d21 = (ap * ab).sum(-1), (ap * ac).sum(-1)
    v, w = (d11 * d20 - d01 * d21) / det, (d00 * d21 - d01 * d20) / det
    inside = (v >= 0) & (w >= 0) & (v + w <= 1)
    plane = ((ap - v[..., None] * ab - w[..., None] * ac) ** 2).sum(-1)
    edge = np.minimum(np.minimum(to_edge(a, ab), to_edge(a, ac)), to_edge(b, c - b))
    return np.sqrt(np.where(inside, plane, edge))


def triangle_distances(points: np.ndarray, tri: np.ndarray) -> np.ndarray:
    """Each point's distance to the nearest of the triangles (n, 3, 3)."""
    out, step = np.full(len(points), np.inf), max(1, 400_000 // max(len(tri), 1))
    for at in range(0, len(points) if len(tri) else 0, step):
        out[at : at + step] = triangle_distances_each(points[at : at + step, None], *(tri[None, :, k] for k in range(3))).min(1)
    return out


def face_distances(points: DataFrame, full: DataFrame, id_col: str = "loc_id") -> DataFrame:
    """Each point's distance to the nearest of any number of faces (corners ax .. cz): id and distance.

    Faces are dealt over cubes that their boxes meet; a point meets the faces of its own and the
    adjoining cubes, and those whose answer may lie beyond are searched again with larger cubes.
    Whichever are fewer, faces or points, are copied to the adjoining cubes. Only faces are ever
    broadcast, after a check of the copies' number: Spark takes a copied table for as small as it was.
    """
    low, high = ({c: f(*(F.col(f"{k}{c}") for k in "abc")) for c in "xyz"} for f in (F.least, F.greatest))
    reach = F.greatest(*(high[c] - low[c] for c in "xyz"))
    mean, most, n = full.agg(F.avg(reach), F.max(reach), F.count("*")).first()
    todo, done = points.where("abs(x) + abs(y) + abs(z) < double('infinity')").select(id_col, *"xyz"), None
    if most is None:
        return todo.select(id_col, F.lit(None).cast("double").alias("distance"))
    side = max(mean, most / 16) or 1.0  # no face meets more than some thousands of cubes

    def measured(batches):
        for b in batches:
            x = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names if c != id_col}
            corner = {k: np.stack([x[f"{k}{c}"] for c in "xyz"], 1) for k in "abc"}
            d = triangle_distances_each(np.stack([x[c] for c in "xyz"], 1), corner["a"], corner["b"], corner["c"])
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(d)], [id_col, "distance"])

    schema = T.StructType([points.schema[id_col], T.StructField("distance", T.DoubleType())])
    far = 1 if n <= todo.count() else 0
    while True:
        a, b = todo.hint("merge"), full.select(*(f"{k}{c}" for k in "abc" for c in "xyz"))
        for c in "xyz":
            here = F.floor(F.col(c) / side)
            a = a.withColumn(f"__{c}", here if far else F.explode(F.array(here - 1, here, here + 1)))
            b = b.withColumn(f"__{c}", F.explode(F.sequence(F.floor(low[c] / side) - far, F.floor(high[c] / side) + far)))
        pairs = a.join(small_side(b), [f"__{c}" for c in "xyz"]).drop(*(f"__{c}" for c in "xyz")).mapInArrow(measured, schema)
        sure = cut(pairs.groupBy(id_col).agg(F.min("distance").alias("distance")).where(F.col("distance") <= side))
        done = sure if done is None else done.union(sure)
        todo = cut(todo.join(sure.select(id_col).hint("merge"), id_col, "left_anti"))
        if todo.isEmpty():
            return done
        side *= 2


def signed_distance(points: DataFrame, vertex: DataFrame, face: DataFrame, id_col: str = "loc_id", broadcast_faces: int = DISTANCE_FACES) -> DataFrame:
    """Points with `distance` to a solid's surface, negative inside. Every task gets the faces if they are few (checked); otherwise see `face_distances`."""
    full = corners(vertex, face)
    rows = full.select(*(f"{k}{c}" for k in "abc" for c in "xyz"))
    sided = assign_from_solid(points, vertex, face, "__side", id_col=id_col)
    if rows.limit(broadcast_faces + 1).count() > broadcast_faces:
        sign = F.when(F.col("__side") == "inside", -1.0).otherwise(1.0)
        return sided.join(face_distances(points, full, id_col).hint("merge"), id_col, "left").withColumn("distance", sign * F.col("distance")).drop("__side")
    sent = points.sparkSession.sparkContext.broadcast(rows.toPandas().to_numpy(float).reshape(-1, 3, 3))

    def run(batches):
        for b in batches:
            p = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xyz"], 1)
            d = triangle_distances(p, sent.value)
            inside = np.array([s == "inside" for s in b.column("__side").to_pylist()], bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.where(inside, -d, d))], [*b.schema.names, "distance"])

    schema = T.StructType([*sided.schema.fields, T.StructField("distance", T.DoubleType())])
    return sided.mapInArrow(run, schema).drop("__side")


#: How two distance fields become one.
OPERATIONS = {"union": lambda a, b: F.least(a, b), "intersection": lambda a, b: F.greatest(a, b), "difference": lambda a, b: F.greatest(a, -b)}


def combine_solids(here: tuple[DataFrame, DataFrame], there: tuple[DataFrame, DataFrame], operation: str, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """Union, intersection or difference of two solids: distance fields combined on a lattice and contoured back."""
    if operation not in OPERATIONS:
        raise ValueError(f"operations are {sorted(OPERATIONS)}")
    nodes = grid.rows(here[0].sparkSession).withColumnRenamed("cell", "loc_id")
    a = signed_distance(nodes, *here).withColumnRenamed("distance", "a")
    b = signed_distance(nodes, *there).select("loc_id", F.col("distance").alias("b"))
    field = a.join(b, "loc_id").select(F.col("loc_id").alias("cell"), (-OPERATIONS[operation](F.col("a"), F.col("b"))).alias("v"))
    return contour(grid, field, "v", 0.0, close=-float(max(grid.step)))
