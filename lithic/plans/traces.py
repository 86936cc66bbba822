"""Queries over hole traces and meshes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.operators import desurvey, mesh
from lithic.plans.drillholes import _rounded, read


def _collar(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hole"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"), F.lit(100.0).alias("z"))


def _survey(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("hole"), F.col("l_linenumber").alias("k")).agg(F.sum("l_quantity").alias("q"))
    return rows.select("hole", ((F.col("k") - 1) * 30.0).alias("depth"), (90 - F.col("q") % 40).alias("dip"), ((F.col("q") * 7) % 360).alias("azimuth"))


def desurvey_stations(spark, sf_dir):
    s = desurvey.stations(_collar(spark, sf_dir), _survey(spark, sf_dir)).select("hole", "depth", "x", "y", "z")
    return _rounded(s, "depth", "x", "y", "z")


def desurvey_points(spark, sf_dir):
    t = desurvey.stations(_collar(spark, sf_dir), _survey(spark, sf_dir))
    pts = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hole"), (F.col("o_orderkey") % 200).cast("double").alias("depth"))
    return _rounded(desurvey.coordinates_at(pts, t).select("hole", "x", "y", "z"), "x", "y", "z")


NX, NY = 20, 15


def _terrain(spark, sf_dir):
    """A lattice of vertices, raised by the mean size of the parts whose keys fall on each."""
    i, j = F.col("v") % NX, F.floor(F.col("v") / NX)
    size = read(spark, sf_dir, "part").groupBy((F.col("p_partkey") % (NX * NY)).alias("v")).agg(F.avg("p_size").alias("s"))
    v = spark.range(NX * NY).withColumnRenamed("id", "v").join(size, "v", "left")
    v = v.select("v", (i * 3.0).alias("x"), (j * 4.0).alias("y"), ((i * 7 + j * 5) % 11 + F.coalesce("s", F.lit(0.0)) / 50).alias("z"))
    return v, mesh.terrain(v, NX, NY)


def mesh_area(spark, sf_dir):
    return _rounded(mesh.area(*_terrain(spark, sf_dir)), "area")


def mesh_volume(spark, sf_dir):
    return _rounded(mesh.signed_volume(*_terrain(spark, sf_dir)), "volume")


def mesh_normals(spark, sf_dir):
    return _rounded(mesh.vertex_normals(*_terrain(spark, sf_dir)), "nx", "ny", "nz")


def mesh_open_edges(spark, sf_dir):
    return mesh.open_edges(_terrain(spark, sf_dir)[1])


def mesh_weld(spark, sf_dir):
    v, f = _terrain(spark, sf_dir)
    v = v.withColumn("z", F.lit(0.0)).withColumn("x", F.floor(F.col("x") / 6) * 6.0)
    v, f = mesh.weld(v, f)
    return mesh.drop_degenerate(v, f)


def mesh_elevation(spark, sf_dir):
    pts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("loc_id"), ((F.col("p_partkey") * 13) % 601 / 10).alias("x"), ((F.col("p_partkey") * 29) % 577 / 10).alias("y"), F.lit(5.0).alias("z"))
    out = mesh.assign_from_surface(pts, *_terrain(spark, sf_dir), "side", uncovered="none")
    return out.select("loc_id", "side")


_V = f"v AS (SELECT i AS v, (i % {NX}) * 3.0::DOUBLE AS x, (i // {NX}) * 4.0::DOUBLE AS y, (((i % {NX}) * 7 + (i // {NX}) * 5) % 11)::DOUBLE + coalesce(s, 0) / 50 AS z FROM range(0, {NX * NY}) t(i) LEFT JOIN (SELECT p_partkey % {NX * NY} AS k, avg(p_size) AS s FROM part GROUP BY 1) ON k = i)"
_F = f"""c AS (SELECT i, i % {NX - 1} + (i // {NX - 1}) * {NX} AS o FROM range(0, {(NX - 1) * (NY - 1)}) t(i)),
f AS (SELECT i * 2 AS f, o AS a, o + 1 AS b, o + {NX} + 1 AS c FROM c UNION ALL SELECT i * 2 + 1, o, o + {NX} + 1, o + {NX} FROM c)"""
_T = f"""{_V}, {_F},
t AS (SELECT f, a, b, c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM f JOIN v p ON p.v = a JOIN v q ON q.v = b JOIN v r ON r.v = c),
n AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS nx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS ny, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS nz FROM t)"""
_E = "e AS (SELECT least(u, w) AS u, greatest(u, w) AS w FROM (SELECT a AS u, b AS w FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, a FROM f))"
_STATIONS = """col AS (SELECT o_orderkey AS hole, o_custkey::DOUBLE AS x, o_totalprice AS y, 100.0::DOUBLE AS z FROM orders),
sv AS (SELECT l_orderkey AS hole, (l_linenumber - 1) * 30.0::DOUBLE AS depth, 90 - sum(l_quantity) % 40 AS dip, (sum(l_quantity) * 7) % 360 AS azimuth FROM lineitem GROUP BY l_orderkey, l_linenumber),
j AS (SELECT col.hole, x, y, z, coalesce(depth, 0) AS depth, coalesce(dip, 90) AS dip, coalesce(azimuth, 0) AS azimuth, row_number() OVER (PARTITION BY col.hole ORDER BY depth) AS k FROM col LEFT JOIN sv USING (hole)),
s AS (SELECT hole, x, y, z, depth, radians(90 - dip) AS inc, radians(azimuth) AS azm FROM j UNION ALL SELECT hole, x, y, z, 0.0, radians(90 - dip), radians(azimuth) FROM j WHERE k = 1 AND depth > 0),
l AS (SELECT *, lag(depth) OVER w AS d0, lag(inc) OVER w AS i0, lag(azm) OVER w AS a0 FROM s WINDOW w AS (PARTITION BY hole ORDER BY depth)),
b AS (SELECT *, acos(greatest(-1, least(1, cos(inc - i0) - sin(i0) * sin(inc) * (1 - cos(azm - a0))))) AS bend FROM l),
h AS (SELECT *, 0.5 * (depth - d0) * CASE WHEN bend < 1e-9 THEN 1 ELSE 2 / bend * tan(bend / 2) END AS h FROM b),
st AS (SELECT hole, depth, inc, azm, x + sum(coalesce(h * (sin(i0) * sin(a0) + sin(inc) * sin(azm)), 0)) OVER w AS x, y + sum(coalesce(h * (sin(i0) * cos(a0) + sin(inc) * cos(azm)), 0)) OVER w AS y, z - sum(coalesce(h * (cos(i0) + cos(inc)), 0)) OVER w AS z
  FROM h WINDOW w AS (PARTITION BY hole ORDER BY depth ROWS UNBOUNDED PRECEDING))"""

SQL = {
    "desurvey_stations": f"WITH {_STATIONS} SELECT hole, round(depth, 6) AS depth, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM st",
    "desurvey_points": f"""WITH {_STATIONS}, nx AS (SELECT *, lead(depth) OVER w AS dn, lead(inc) OVER w AS i1, lead(azm) OVER w AS a1 FROM st WINDOW w AS (PARTITION BY hole ORDER BY depth)),
        p AS (SELECT o_orderkey AS hole, (o_orderkey % 200)::DOUBLE AS d FROM orders), m AS (SELECT p.hole, p.d, nx.*, row_number() OVER (PARTITION BY p.hole ORDER BY nx.depth DESC) AS k FROM p JOIN nx ON p.hole = nx.hole AND nx.depth <= p.d),
        u AS (SELECT *, coalesce(least(1, greatest(0, (d - depth) / (dn - depth))), 0) AS sh FROM m WHERE k = 1),
        z AS (SELECT *, inc + sh * coalesce(i1 - inc, 0) AS ie, azm + sh * coalesce(((a1 - azm + pi()) - 2 * pi() * floor((a1 - azm + pi()) / (2 * pi()))) - pi(), 0) AS ae FROM u),
        y AS (SELECT *, acos(greatest(-1, least(1, cos(ie - inc) - sin(inc) * sin(ie) * (1 - cos(ae - azm))))) AS bend2 FROM z),
        g AS (SELECT *, 0.5 * (d - depth) * CASE WHEN bend2 < 1e-9 THEN 1 ELSE 2 / bend2 * tan(bend2 / 2) END AS hh FROM y)
        SELECT hole, round(x + hh * (sin(inc) * sin(azm) + sin(ie) * sin(ae)), 6) AS x, round(y + hh * (sin(inc) * cos(azm) + sin(ie) * cos(ae)), 6) AS y, round(z - hh * (cos(inc) + cos(ie)), 6) AS z FROM g""",
    "mesh_area": f"WITH {_T} SELECT round(sum(sqrt(nx * nx + ny * ny + nz * nz) / 2), 6) AS area FROM n",
    "mesh_volume": f"WITH {_T} SELECT round(sum((ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6), 6) AS volume FROM n",
    "mesh_normals": f"""WITH {_T}, k AS (SELECT unnest([a, b, c]) AS v, nx, ny, nz FROM n), g AS (SELECT v, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM k GROUP BY v)
        SELECT v, round(nx / sqrt(nx * nx + ny * ny + nz * nz), 6) AS nx, round(ny / sqrt(nx * nx + ny * ny + nz * nz), 6) AS ny, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) AS nz FROM g""",
    "mesh_open_edges": f"WITH {_V}, {_F}, {_E} SELECT u, w, count(*) AS n FROM e GROUP BY u, w HAVING count(*) = 1",
    "mesh_weld": f"""WITH {_V}, {_F}, w AS (SELECT v, min(v) OVER (PARTITION BY floor(x / 6), y) AS m, floor(x / 6) * 6 AS wx, y AS wy FROM v),
        g AS (SELECT f, p.m AS a, q.m AS b, r.m AS c, (q.wx - p.wx) * (r.wy - p.wy) - (q.wy - p.wy) * (r.wx - p.wx) AS nz FROM f JOIN w p ON p.v = a JOIN w q ON q.v = b JOIN w r ON r.v = c),
        k AS (SELECT *, row_number() OVER (PARTITION BY list_sort([a, b, c]) ORDER BY f) AS i FROM g WHERE a <> b AND b <> c AND a <> c AND abs(nz) > 1e-12) SELECT f, a, b, c FROM k WHERE i = 1""",
    "mesh_elevation": f"""WITH {_T}, p AS (SELECT p_partkey AS loc_id, ((p_partkey * 13) % 601 / 10)::DOUBLE AS px, ((p_partkey * 29) % 577 / 10)::DOUBLE AS py FROM part),
        h AS (SELECT loc_id, max(az - (nx * (px - ax) + ny * (py - ay)) / nz) AS el FROM p JOIN n ON px >= least(ax, bx, cx) AND px <= greatest(ax, bx, cx) AND py >= least(ay, by_, cy) AND py <= greatest(ay, by_, cy)
          AND ((CASE WHEN (ay > py) <> (by_ > py) THEN (px < (bx - ax) * (py - ay) / (by_ - ay) + ax)::INT ELSE 0 END) + (CASE WHEN (by_ > py) <> (cy > py) THEN (px < (cx - bx) * (py - by_) / (cy - by_) + bx)::INT ELSE 0 END) + (CASE WHEN (cy > py) <> (ay > py) THEN (px < (ax - cx) * (py - cy) / (ay - cy) + cx)::INT ELSE 0 END)) % 2 = 1 GROUP BY loc_id)
        SELECT p.loc_id, CASE WHEN el IS NULL THEN 'none' WHEN 5.0 > el THEN 'above' ELSE 'below' END AS side FROM p LEFT JOIN h USING (loc_id)""",
}
SQL = {k: v.replace("round(", "round(3e-10 + ") for k, v in SQL.items()}

QUERIES = {f.__name__: f for f in (desurvey_stations, desurvey_points, mesh_area, mesh_volume, mesh_normals, mesh_open_edges, mesh_weld, mesh_elevation)}
