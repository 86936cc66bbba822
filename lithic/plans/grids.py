"""Queries over lattices, block sets, points and spatial pairs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithic.functions import composition as C
from lithic.functions import geometry as G
from lithic.functions import scalars as S
from lithic.operators import lattice, spatial
from lithic.operators.blocks import BlockSet
from lithic.operators.lattice import Grid
from lithic.plans.drillholes import _rounded, read

CELLS = Grid.of((0.0, 0.0), (12, 24), (5.0, 5000.0), labels=("x", "y"))


def _points(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("grade"), F.col("l_returnflag").alias("lith"), F.col("l_linestatus").alias("status"),
        F.col("l_tax").alias("a"), F.col("l_discount").alias("b"), (1 - F.col("l_tax") - F.col("l_discount")).alias("c"),
    )


_PTS = """p AS (SELECT l_quantity AS x, l_extendedprice AS y, l_discount AS grade, l_returnflag AS lith, l_linestatus AS status, l_tax AS a, l_discount AS b, 1 - l_tax - l_discount AS c FROM lineitem),
k AS (SELECT *, ceil((x - 0.0 - 2.5) / 5.0)::BIGINT AS i, ceil((y - 0.0 - 2500.0) / 5000.0)::BIGINT AS j FROM p),
q AS (SELECT *, i + 12 * j AS cell FROM k WHERE i >= 0 AND i < 12 AND j >= 0 AND j < 24)"""


def grid_rows(spark, sf_dir):
    return CELLS.rows(spark)


def grid_subset(spark, sf_dir):
    return CELLS.subset(spark, [12.0, 10000.0], [40.0, 80000.0])


def grid_means(spark, sf_dir):
    return _rounded(lattice.aggregate(CELLS, _points(spark, sf_dir), means=["grade"]), "grade")


def grid_dominant(spark, sf_dir):
    out = lattice.aggregate(CELLS, _points(spark, sf_dir), labels=["lith"])
    return out.select("cell", "n", F.coalesce("lith", F.lit("")).alias("lith"))


def grid_contacts(spark, sf_dir):
    out = lattice.aggregate(CELLS, _points(spark, sf_dir), pairs=[("lith", "status")])
    return out.select("cell", F.coalesce("lith", F.lit("")).alias("lith"))


def grid_composition(spark, sf_dir):
    return _rounded(lattice.aggregate(CELLS, _points(spark, sf_dir), compositions=[["a", "b", "c"]]), "a", "b", "c")


def grid_smooth(spark, sf_dir):
    means = lattice.aggregate(CELLS, _points(spark, sf_dir), means=["grade"])
    full = CELLS.rows(spark).select("cell").join(means, "cell", "left").select("cell", F.coalesce("grade", F.lit(0.0)).alias("grade"))
    return _rounded(lattice.smooth(Grid.of((0.0,), (12 * 24,), (1.0,)), full, "grade", 1.0), "grade")


def subset_region(spark, sf_dir):
    box = G.in_box(["x", "y"], [10.0, 20000.0], [30.0, 60000.0])
    return _points(spark, sf_dir).where(box).groupBy("x").agg(F.count("*").alias("n"))


def bounding_box(spark, sf_dir):
    return _rounded(G.bounding_box(_points(spark, sf_dir), ["x", "y"]), "mid_x", "mid_y", "diagonal")


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("loc_id"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))


def declustering(spark, sf_dir):
    return _rounded(spatial.decluster(_orders(spark, sf_dir), ["x", "y"], cell=[50.0, 20000.0]), "weight")


def variogram(spark, sf_dir):
    points = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("loc_id"), F.col("c_custkey").cast("double").alias("x"), F.col("c_acctbal").alias("v"))
    return _rounded(spatial.variogram(points, ["x"], "v", n_lags=10, max_lag=100.0), "distance", "gamma")


def variogram_2d(spark, sf_dir):
    points = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("loc_id"), F.pmod("p_partkey", F.lit(40)).cast("double").alias("x"), F.floor(F.col("p_partkey") / 40).cast("double").alias("y"), F.col("p_retailprice").alias("v"))
    return _rounded(spatial.variogram(points, ["x", "y"], "v", n_lags=6, max_lag=6.0, direction=[1.0, 0.0], tolerance=30.0), "distance", "gamma")


def nearest(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("loc_id"), F.col("c_acctbal").alias("x"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("loc_id"), F.col("s_acctbal").alias("x"))
    return _rounded(spatial.nearest(c, s, ["x"], 50.0), "distance")


def balanced_folds(spark, sf_dir):
    return spatial.balanced_folds(read(spark, sf_dir, "customer"), "c_nationkey", 5)


def composition_clr(spark, sf_dir):
    p = _points(spark, sf_dir).where("a > 0 and b > 0 and c > 0")
    z = C.clr(C.close(C.parts("a", "b", "c")))
    return p.select(F.round(z[0] + 3e-10, 6).alias("z0"), F.round(z[1] + 3e-10, 6).alias("z1"), F.round(z[2] + 3e-10, 6).alias("z2"))


def aitchison(spark, sf_dir):
    p = _points(spark, sf_dir).where("a > 0 and b > 0 and c > 0")
    d = C.aitchison(C.parts("a", "b", "c"), C.parts("c", "b", "a"))
    return p.groupBy("lith").agg(F.round(F.avg(d) + 3e-10, 6).alias("distance"))


def kernels(spark, sf_dir):
    d = F.col("x") / 25
    return _points(spark, sf_dir).groupBy("x").agg(F.count("*").alias("n")).select("x", *(F.round(S.kernel(k, d) + 3e-10, 6).alias(k) for k in S.KERNELS))


def transforms(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    u, v = S.anisotropy_2d(F.col("x"), F.col("y"), 10.0, 0.5, 30.0)
    s, c = S.periodic([F.col("x") / 7])
    return p.select("p_partkey", *(F.round(k + 3e-10, 6).alias(n) for k, n in ((u, "u"), (v, "v"), (s, "s"), (c, "c"), (S.softplus_forward(F.col("x")), "softplus"), (S.log_forward(F.col("y")), "logged"), (S.projection_1d([F.col("x"), F.col("y")], [3.0, 4.0]), "projected"))))


def planes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.pmod(F.col("p_partkey") * 37, F.lit(360)).cast("double").alias("azimuth"), F.pmod(F.col("p_size"), F.lit(90)).cast("double").alias("dip"))
    d = G.planes_to_directions(p).select("p_partkey", *(F.round(F.col("dir")[i] + 3e-10, 6).alias(c) for i, c in enumerate(("x", "y", "z"))))
    return d


BLOCKS = BlockSet((5.0, 5.0, 5.0), (4, 4, 2), (10.0, 10.0, 10.0), (2, 2, 2), 2)


def block_rows(spark, sf_dir):
    return BLOCKS.with_size(BLOCKS.split(BLOCKS.rows(spark), F.col("block_id") % 3 == 0)).select("ox", "oy", "oz", "level", "x", "y", "z", "volume")


def block_group(spark, sf_dir):
    split = BLOCKS.split(BLOCKS.rows(spark), F.col("block_id") % 3 == 0).select("ox", "oy", "oz", "level")
    return BLOCKS.group(split, F.col("level") == 1).select("ox", "oy", "oz", "level")


def block_locate(spark, sf_dir):
    blocks = BLOCKS.split(BLOCKS.rows(spark), F.col("block_id") % 3 == 0).drop("block_id").withColumn("block_id", F.col("ox") * 10000 + F.col("oy") * 100 + F.col("oz") + F.col("level") * 1000000)
    pts = read(spark, sf_dir, "part").select("p_partkey", (F.pmod("p_partkey", F.lit(40)) + 0.0).alias("x"), F.pmod(F.floor(F.col("p_partkey") / 40), F.lit(45)).cast("double").alias("y"), F.pmod("p_size", F.lit(20)).cast("double").alias("z"))
    return BLOCKS.locate(pts, blocks).select("p_partkey", F.coalesce("block_id", F.lit(-1)).alias("block_id"))


_BLK = """b0 AS (SELECT i AS block_id, (i % 4) * 4 AS ox, ((i // 4) % 4) * 4 AS oy, (i // 16) * 4 AS oz FROM range(0, 32) t(i)),
sub AS (SELECT a.i AS sx, b.i AS sy, c.i AS sz FROM range(0, 2) a(i), range(0, 2) b(i), range(0, 2) c(i)),
bl AS (SELECT ox, oy, oz, 0 AS level FROM b0 WHERE block_id % 3 <> 0 UNION ALL SELECT ox + 2 * sx, oy + 2 * sy, oz + 2 * sz, 1 FROM b0, sub WHERE block_id % 3 = 0)"""

SQL = {
    "grid_rows": "SELECT i AS cell, (i % 12) * 5.0::DOUBLE AS x, (i // 12) * 5000.0::DOUBLE AS y FROM range(0, 288) t(i)",
    "grid_subset": "SELECT * FROM (SELECT i AS cell, (i % 12) * 5.0::DOUBLE AS x, (i // 12) * 5000.0::DOUBLE AS y FROM range(0, 288) t(i)) WHERE x >= 12 AND x < 40 AND y >= 10000 AND y < 80000",
    "grid_means": f"WITH {_PTS} SELECT cell, count(*) AS n, round(avg(grade), 6) AS grade FROM q GROUP BY cell",
    "grid_dominant": f"""WITH {_PTS}, v AS (SELECT cell, lith, count(*) AS m FROM q GROUP BY cell, lith), w AS (SELECT *, max(m) OVER (PARTITION BY cell) AS top FROM v)
        SELECT q.cell, count(*) AS n, any_value(d.lith) AS lith FROM q JOIN (SELECT cell, CASE WHEN count(*) = 1 THEN min(lith) ELSE '' END AS lith FROM w WHERE m = top GROUP BY cell) d ON q.cell = d.cell GROUP BY q.cell""",
    "grid_contacts": f"""WITH {_PTS}, sides AS (SELECT cell, lith AS l FROM q UNION ALL SELECT cell, status FROM q), v AS (SELECT cell, l, count(*) AS m FROM sides GROUP BY cell, l), w AS (SELECT *, max(m) OVER (PARTITION BY cell) AS top FROM v)
        SELECT cell, CASE WHEN count(*) = 1 THEN min(l) ELSE '' END AS lith FROM w WHERE m = top GROUP BY cell""",
    "grid_composition": f"WITH {_PTS}, m AS (SELECT cell, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM q GROUP BY cell) SELECT cell, n, round(a / (a + b + c), 6) AS a, round(b / (a + b + c), 6) AS b, round(c / (a + b + c), 6) AS c FROM m",
    "grid_smooth": f"""WITH {_PTS}, m AS (SELECT cell, avg(grade) AS g FROM q GROUP BY cell), full_ AS (SELECT i AS cell, coalesce(g, 0) AS g FROM range(0, 288) t(i) LEFT JOIN m ON m.cell = i),
        o AS (SELECT o, exp(-0.5 * o * o) AS w FROM range(-4, 5) t(o)), mv AS (SELECT ((cell + o) % 576 + 576) % 576 AS r, g * w / (SELECT sum(w) FROM o) AS gw FROM full_, o)
        SELECT CASE WHEN r >= 288 THEN 575 - r ELSE r END AS cell, round(sum(gw), 6) AS grade FROM mv GROUP BY 1""",
    "subset_region": f"WITH {_PTS} SELECT x, count(*) AS n FROM p WHERE x >= 10 AND x < 30 AND y >= 20000 AND y < 60000 GROUP BY x",
    "bounding_box": f"WITH {_PTS} SELECT min(x) AS lo_x, min(y) AS lo_y, max(x) AS hi_x, max(y) AS hi_y, round((min(x) + max(x)) / 2, 6) AS mid_x, round((min(y) + max(y)) / 2, 6) AS mid_y, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2), 6) AS diagonal FROM p",
    "declustering": """WITH p AS (SELECT o_orderkey AS loc_id, o_custkey::DOUBLE AS x, o_totalprice AS y FROM orders), s AS (SELECT *, k FROM p, range(0, 4) t(k)),
        c AS (SELECT loc_id, 1.0 / count(*) OVER (PARTITION BY k, floor((x + k * 50.0 / 4) / 50.0), floor((y + k * 20000.0 / 4) / 20000.0)) AS w FROM s), g AS (SELECT loc_id, sum(w) / 4 AS w FROM c GROUP BY loc_id)
        SELECT loc_id, round(w * (SELECT count(*) / sum(w) FROM g), 6) AS weight FROM g""",
    "variogram": """WITH p AS (SELECT c_custkey AS id, c_custkey::DOUBLE AS x, c_acctbal AS v FROM customer), q AS (SELECT abs(a.x - b.x) AS h, a.v - b.v AS d FROM p a JOIN p b ON a.id < b.id AND b.x - a.x <= 100 AND a.x - b.x <= 100)
        SELECT least(floor(h / 10.0), 9)::INT AS lag, count(*) AS pairs, round(avg(h), 6) AS distance, round(avg(d * d) / 2, 6) AS gamma FROM q WHERE h > 0 GROUP BY 1""",
    "variogram_2d": """WITH p AS (SELECT p_partkey AS id, (p_partkey % 40)::DOUBLE AS x, floor(p_partkey / 40.0) AS y, p_retailprice AS v FROM part),
        q AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS h, a.v - b.v AS d, abs(a.x - b.x) AS dx FROM p a JOIN p b ON a.id < b.id AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6)
        SELECT least(floor(h / 1.0), 5)::INT AS lag, count(*) AS pairs, round(avg(h), 6) AS distance, round(avg(d * d) / 2, 6) AS gamma FROM q WHERE h > 0 AND h <= 6 AND dx >= h * cos(radians(30)) - 1e-12 GROUP BY 1""",
    "nearest": "SELECT c_custkey AS l_id, min({d: sqrt(pow(c_acctbal - s_acctbal, 2)), k: s_suppkey}).k AS r_id, round(min(abs(c_acctbal - s_acctbal)), 6) AS distance FROM customer, supplier GROUP BY 1",
    "balanced_folds": """WITH RECURSIVE g AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) AS k FROM customer GROUP BY 1),
        s AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS filled, -1 AS fold
          UNION ALL SELECT g.k, list_transform(filled, lambda v, i: CASE WHEN i = list_position(filled, list_min(filled)) THEN v + g.n ELSE v END), list_position(filled, list_min(filled)) - 1 FROM s JOIN g ON g.k = s.k + 1)
        SELECT c_nationkey, n, fold::INT AS fold FROM g JOIN s USING (k)""",
    "composition_clr": f"WITH {_PTS}, z AS (SELECT ln(a / (a + b + c)) AS a, ln(b / (a + b + c)) AS b, ln(c / (a + b + c)) AS c FROM p WHERE a > 0 AND b > 0 AND c > 0) SELECT round(a - (a + b + c) / 3, 6) AS z0, round(b - (a + b + c) / 3, 6) AS z1, round(c - (a + b + c) / 3, 6) AS z2 FROM z",
    "aitchison": f"WITH {_PTS} SELECT lith, round(avg(sqrt(2 * (ln(a) - ln(c)) ** 2)), 6) AS distance FROM p WHERE a > 0 AND b > 0 AND c > 0 GROUP BY lith",
    "kernels": f"""WITH {_PTS}, g AS (SELECT DISTINCT x, x / 25 AS d FROM p)
        SELECT x, round(exp(-3 * d * d), 6) AS gaussian, round(CASE WHEN d < 1 THEN 1 - 1.5 * d + 0.5 * d ** 3 ELSE 0 END, 6) AS spherical, round(exp(-3 * d), 6) AS exponential,
          round(CASE WHEN d < 1 THEN 1 - 7 * d ** 2 + 8.75 * d ** 3 - 3.5 * d ** 5 + 0.75 * d ** 7 ELSE 0 END, 6) AS cubic, round(1.0, 6)::DOUBLE AS constant, round(cos(2 * pi() * d), 6) AS cosine,
          round((1 + 5 * d) * exp(-5 * d), 6) AS matern32, round((1 + 6 * d + 12 * d * d) * exp(-6 * d), 6) AS matern52 FROM g""",
    "transforms": """WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y FROM part)
        SELECT p_partkey, round((x * sin(radians(30)) + y * cos(radians(30))) / 10, 6) AS u, round((x * cos(radians(30)) - y * sin(radians(30))) / 5, 6) AS v, round(sin(2 * pi() * x / 7), 6) AS s, round(cos(2 * pi() * x / 7), 6) AS c,
          round(CASE WHEN x > 50 THEN x ELSE ln(exp(least(x, 50) + 1e-6) - 1) END, 6) AS softplus, round(ln(y + 1e-6), 6) AS logged, round(x * 0.6 + y * 0.8, 6) AS projected FROM p""",
    "planes": """WITH p AS (SELECT p_partkey, radians((p_partkey * 37) % 360) AS a, radians(p_size % 90) AS d, radians((p_partkey * 37) % 360 - 90) AS s FROM part)
        SELECT p_partkey, round(sin(a) * cos(d), 6) AS x, round(cos(a) * cos(d), 6) AS y, round(-sin(d), 6) AS z FROM p UNION ALL SELECT p_partkey, round(sin(s), 6), round(cos(s), 6), round(0.0, 6)::DOUBLE FROM p""",
    "block_rows": f"""WITH {_BLK}, z AS (SELECT *, CASE level WHEN 0 THEN 10.0 ELSE 5.0 END::DOUBLE AS d FROM bl)
        SELECT ox::BIGINT AS ox, oy::BIGINT AS oy, oz::BIGINT AS oz, level, ox * 2.5 + d / 2 AS x, oy * 2.5 + d / 2 AS y, oz * 2.5 + d / 2 AS z, d * d * d AS volume FROM z""",
    "block_group": f"WITH {_BLK} SELECT ox::BIGINT AS ox, oy::BIGINT AS oy, oz::BIGINT AS oz, 0 AS level FROM b0",
    "block_locate": f"""WITH {_BLK}, p AS (SELECT p_partkey, (p_partkey % 40)::DOUBLE AS x, (p_partkey // 40 % 45)::DOUBLE AS y, (p_size % 20)::DOUBLE AS z FROM part),
        z AS (SELECT *, CASE level WHEN 0 THEN 10.0 ELSE 5.0 END AS d, ox * 10000 + oy * 100 + oz + level * 1000000 AS block_id FROM bl)
        SELECT p_partkey, coalesce(max(block_id), -1)::BIGINT AS block_id FROM p LEFT JOIN z ON x >= ox * 2.5 AND x < ox * 2.5 + d AND y >= oy * 2.5 AND y < oy * 2.5 + d AND z.oz * 2.5 <= p.z AND p.z < z.oz * 2.5 + d GROUP BY p_partkey""",
}
SQL = {k: v.replace("round(", "round(3e-10 + ") for k, v in SQL.items()}

QUERIES = {
    f.__name__: f
    for f in (
        grid_rows, grid_subset, grid_means, grid_dominant, grid_contacts, grid_composition, grid_smooth, subset_region, bounding_box, declustering, variogram, variogram_2d, nearest, balanced_folds,
        composition_clr, aitchison, kernels, transforms, planes, block_rows, block_group, block_locate,
    )
}
