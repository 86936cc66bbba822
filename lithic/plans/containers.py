"""Queries over catalogs of variables and interval tables, stored containers, solids and multivariate scores, each with its SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from lithic.models import likelihoods as L
from lithic.models import warpings as W
from lithic.models.rows import with_values
from lithic.models.variational import Convergence
from lithic.operators import contour, mesh
from lithic.operators import metrics as M
from lithic.operators.blocks import BlockSet, RotatedBlockSet
from lithic.operators.drillholes import Drillholes
from lithic.operators.lattice import Grid
from lithic.operators.variables import Located
from lithic.plans.drillholes import SQL_INTERVALS, _rounded, lineitem_intervals, read
from lithic.plans.ensembles import _sims
from lithic.plans.traces import _E, _F, _V, _terrain
from lithic.sources import tables as T


def _place(spark) -> str:
    """A new folder under the one that executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(found or '/tmp/checkpoints').rstrip('/')}/stored-{uuid.uuid4().hex}"


def _located(spark, sf_dir) -> Located:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    return Located(rows).add_continuous("grade", "size").add_categorical("brand", "p_brand").add_anomaly("first", "Brand#11", "p_brand").add_rock_type("rock", "p_brand", "p_type").add_vector("both", ["size", "p_retailprice"])


def variable_codes(spark, sf_dir):
    """Labels as codes, an anomaly as 0 and 1, and whether the labels on either side differ."""
    at = _located(spark, sf_dir)
    return at.rows.select("p_partkey", *at.codes("brand"), *at.codes("first"), *at.codes("rock"), at.on_contact("rock").alias("contact"))


def variable_metadata(spark, sf_dir):
    """Texts kept as codes and read back; those that are no label come back as none."""
    rows = Located(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")).add_metadata("status", "o_orderstatus", ["O", "F"])
    return rows.rows.select("o_orderkey", "status", F.coalesce(rows.metadata("status"), F.lit("-")).alias("text"))


def carried_variables(spark, sf_dir):
    """Parts of size over 10 carried onto a longer set with the suppliers' places, and a definition copied to it."""
    at = _located(spark, sf_dir).drop("brand").drop("rock").drop("first").set_cutoffs("grade", [20, 5])
    longer = at.carry_to(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")), F.col("size") > 10)
    empty = at.copy_to("grade", Located(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("p_partkey"))))
    cut = list(empty.variables["grade"].cutoffs)
    out = longer.rows.select("p_partkey", F.coalesce("size", F.lit(-1.0)).alias("size"), F.lit(longer.containing("p_retailprice")).alias("variable"))
    return out.union(empty.rows.select("p_partkey", F.coalesce("size", F.lit(-2.0)), F.lit(f"{cut}")))


def interval_tables(spark, sf_dir):
    """A table added, given roles, renamed with its columns, and read back by role; another one dropped."""
    iv = lineitem_intervals(spark, sf_dir).select("hole", "f", "t", "grade", "lith")
    holes = Drillholes(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("hole"), F.lit(1e9).alias("length")))
    holes, found = holes.add_intervals("assay", iv, {"grade": "grade"}, "raise")
    holes, _ = holes.add_intervals("extra", iv, on_error="ignore")
    holes = holes.drop_table("extra").rename_table("assay", "zinc").rename("zinc", {"grade": "zn", "lith": "rock"})
    table = holes["zinc"].set_role("rock", "categorical")
    kept = table.rows.select("hole", "f", "t", *(F.col(c).alias("value") for c in table.with_role("grade")), *(F.col(c).alias("label") for c in table.with_role("categorical")))
    return kept.withColumn("problems", F.lit(found.count()))


def vector_metrics(spark, sf_dir):
    e = _sims(spark, sf_dir).withColumn("other", F.col("sims")[1])
    out = M.vector_metrics(e, {"first": ("truth", "prediction", "sims"), "second": ("other", "truth", "sims")})
    return _rounded(out.select("component", "n", "rmse", "mae", "bias"), "rmse", "mae", "bias")


def composition_metrics(spark, sf_dir):
    p = read(spark, sf_dir, "part").select((F.col("p_size") / 50.0).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), F.lit(0.5).alias("p"), F.lit(0.4).alias("q"), F.array(F.lit(0.4), F.lit(0.6)).alias("s"))
    out = M.composition_metrics(p, {"a": ("a", "p", "s"), "b": ("b", "q", "s")})
    return _rounded(out.select("component", "n", "rmse", "mae", "bias", "aitchison"), "rmse", "mae", "bias", "aitchison")


def multivariate_densities(spark, sf_dir):
    """Log densities of two variables on the scale of their standard scores, and of a maximum-margin class."""
    names = ["gaussian", "laplace", "flat", "huber", "margin"]

    def run(x):
        kinds = [L.Gaussian(0.2), L.Laplace(0.3), L.EpsilonInsensitive(0.3, 0.5), L.Huber(0.3, 1.0)]
        two = [L.Multivariate(k, 2, W.ZScore(np.array([1.0, 1.5]), np.array([0.5, 0.25]))) for k in kinds]
        f = np.stack([x[:, 1] - 1, x[:, 0] - 1], 1)
        return np.stack([m.log_density(x, f) for m in two] + [L.MaximumMargin(1.5).log_density((x[:, 0] > 1).astype(float), 2 * x[:, 1] - 3)], 1)

    rows = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 25.0).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))
    return _rounded(with_values(rows, ["x", "y"], names, run).select("p_partkey", *names), *names)


def training_stop(spark, sf_dir):
    """The steps after which a bound counts as no longer rising; the bound is the price of all parts up to a size."""
    rows = read(spark, sf_dir, "part").groupBy("p_size").agg(F.sum("p_retailprice").alias("s")).orderBy("p_size").collect()
    rule, total, out = Convergence(0.3, 8), 0.0, []
    for r in rows:
        total += r["s"]
        out.append((int(r["p_size"]), rule.stop(total)))
    return spark.createDataFrame(out, "p_size int, stop boolean")


def stored_points(spark, sf_dir):
    """Parts written as a container and opened again."""
    path = _place(spark)
    T.write_container(read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), path, attributes={"unit": "m"})
    rows, _, attributes = T.open_container(spark, path)
    return rows.withColumn("unit", F.lit(attributes["unit"]))


def stored_lattice(spark, sf_dir):
    """Means of parts by cell of a lattice, written without coordinates, which come back with it."""
    grid, path = Grid.of((0.0, 0.0), (51, 3), (1.0, 500.0)), _place(spark)
    cell = (F.col("p_size") + 51 * F.least(F.floor(F.col("p_retailprice") / 700), F.lit(2))).cast("long")
    T.write_container(read(spark, sf_dir, "part").groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).join(grid.rows(spark), "cell"), path, grid)
    rows, back, _ = T.open_container(spark, path)
    return rows.select("cell", *back.labels, F.coalesce("n", F.lit(0)).alias("n"))


def stored_blocks(spark, sf_dir):
    """Blocks with the number of parts of each, written with their geometry and opened again."""
    blocks, path = BlockSet((5.0, 5.0, 5.0), (4, 4, 2), (10.0, 10.0, 10.0), (2, 2, 2), 2), _place(spark)
    n = read(spark, sf_dir, "part").groupBy(F.pmod("p_partkey", F.lit(32)).alias("block_id")).agg(F.count("*").alias("n"))
    T.write_container(blocks.rows(spark).join(n, "block_id", "left"), path, blocks)
    rows, back, _ = T.open_container(spark, path)
    return back.with_size(rows).select("block_id", "x", "y", "z", "volume", F.coalesce("n", F.lit(0)).alias("n"))


def delimited_table(spark, sf_dir):
    """Parts written as text with a mark for what is missing and shares in percent, and read with its layout."""
    path = _place(spark)
    p = read(spark, sf_dir, "part")
    p.select("p_partkey", F.when(F.col("p_size") > 40, -999.0).otherwise(F.col("p_size")).alias("size"), (F.col("p_retailprice") / 20).alias("share")).write.csv(path, header=True, sep="\t")
    back = T.read_delimited(spark, path, "p_partkey long, size double, share double", "\t", "-999", percent=["share"])
    return _rounded(back.select("p_partkey", F.coalesce("size", F.lit(-1.0)).alias("size"), "share"), "share")


def exchanged_mesh(spark, sf_dir):
    """Triangles above the parts' sizes and prices written as drawing entities, read and welded: corners and area of each."""
    path = _place(spark)
    p = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 10.0).alias("x"), F.col("p_size").cast("double").alias("y"))
    corner = F.explode(F.array(*(F.struct((F.col("p_partkey") * 3 + i).alias("v"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(2.5).alias("z")) for i, (dx, dy) in enumerate(((0, 0), (4, 0), (0, 3))))))
    face = p.select(F.col("p_partkey").alias("f"), *((F.col("p_partkey") * 3 + i).alias(k) for i, k in enumerate("abc")))
    T.write_dxf(p.select(corner.alias("c")).select("c.*"), face, path)
    v, f = T.read_dxf(spark, path)
    full = mesh.corners(v, f)
    return full.select(F.least("ax", "bx", "cx").alias("x"), F.least("ay", "by", "cy").alias("y"), F.round(F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2 + 3e-10, 6).alias("area"))


LOW, HIGH = (2.05, 5.0123, 1.5), (8.05, 9.0123, 4.5)


def _box(spark):
    v = [(i, *((HIGH if i >> k & 1 else LOW)[k] for k in range(3))) for i in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    f = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    return spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in v], "v long, x double, y double, z double"), spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "f long, a long, b long, c long")


def _inside(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("loc_id"), (F.col("p_size") / 5).alias("x"), (F.col("p_retailprice") / 200).alias("y"), F.pmod("p_partkey", F.lit(7)).cast("double").alias("z"))


def solid_sides(spark, sf_dir):
    """Which parts, placed by size, price and key, lie in a box."""
    return mesh.assign_from_solid(_inside(spark, sf_dir), *_box(spark), "side").select("loc_id", "side")


def solid_distance(spark, sf_dir):
    """Their distances to its surface, negative inside."""
    return _rounded(contour.signed_distance(_inside(spark, sf_dir), *_box(spark)).select("loc_id", "distance"), "distance")


def solid_distance_by_cells(spark, sf_dir):
    """The same, faces dealt over cubes."""
    return _rounded(contour.signed_distance(_inside(spark, sf_dir), *_box(spark), broadcast_faces=1).select("loc_id", "distance"), "distance")


def mesh_pieces(spark, sf_dir):
    """Strips of triangles over the customers of each nation, told apart by what they share."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("n"))
    face = c.select(F.col("c_custkey").alias("f"), F.col("n").alias("a"), (F.col("c_custkey") + 1000).alias("b"), (F.col("c_custkey") + 10_000_000_000).alias("c"))
    return mesh.pieces(face).select("f", "piece")


TURNED = RotatedBlockSet((5.0, 5.0, 5.0), (4, 4, 2), (10.0, 10.0, 10.0), (2, 2, 2), 2, azimuth=30.0)


def _spread(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 50).alias("y"), F.pmod("p_partkey", F.lit(19)).cast("double").alias("z"))


def rotated_blocks(spark, sf_dir):
    """The block of a turned set that holds each part, -1 where none does."""
    return TURNED.locate(_spread(spark, sf_dir), TURNED.rows(spark)).select("p_partkey", "x", F.coalesce("block_id", F.lit(-1)).alias("block_id"))


def rotated_centres(spark, sf_dir):
    """Centres of the sub-blocks of a turned set, with the parts in each block."""
    n = read(spark, sf_dir, "part").groupBy(F.pmod("p_partkey", F.lit(32)).alias("block_id")).agg(F.count("*").alias("n"))
    return _rounded(TURNED.sub_rows(TURNED.rows(spark)).join(n, "block_id"), "x", "y", "z")


def fitted_blocks(spark, sf_dir):
    """A turned set made to hold all parts: how many blocks it has, and how many parts lie in none (none do)."""
    points = _spread(spark, sf_dir)
    blocks = RotatedBlockSet.of(points, (10.0, 10.0, 10.0), azimuth=30.0)
    located = blocks.locate(points, blocks.rows(spark))
    return located.agg(F.count("*").alias("parts"), F.sum(F.col("block_id").isNull().cast("int")).alias("outside")).withColumn("blocks", F.lit(blocks.n[0] * blocks.n[1] * blocks.n[2]))


def block_shares(spark, sf_dir):
    """Parts as sub-blocks of 32 blocks: the share of large ones, whether a block is crossed, and whether it is to be split."""
    subs = read(spark, sf_dir, "part").select(F.pmod("p_partkey", F.lit(32)).alias("block_id"), (F.col("p_size") > 25).alias("large"))
    out = mesh.shares(subs, "block_id", F.col("large")).withColumn("level", F.lit(0)).withColumn("divided", F.least("share", 1 - F.col("share")))
    return _rounded(out.withColumn("split", TURNED.needs_splitting(["divided"], 0.45)).select("block_id", "share", "crossed", "split"), "share")


def missing_blocks(spark, sf_dir):
    """Of 32 blocks those with more than the average of parts are there: what is missing, and that the rest is not full."""
    n = read(spark, sf_dir, "part").groupBy(F.pmod("p_partkey", F.lit(32)).alias("block_id")).agg(F.sum("p_size").alias("n"))
    mean = n.agg(F.avg("n")).first()[0]
    blocks = BlockSet((5.0, 5.0, 5.0), (4, 4, 2), (10.0, 10.0, 10.0), (2, 2, 2), 2)
    there = blocks.rows(spark).join(n.where(F.col("n") > mean), "block_id").drop("n")
    return blocks.missing(there, spark).select("ox", "oy", "oz", "level").withColumn("full", F.lit(blocks.is_full(there)))


def smoothed_mesh(spark, sf_dir):
    """One round of smoothing of the terrain: towards the neighbours' mean, then away from it."""
    return _rounded(mesh.smooth(*_terrain(spark, sf_dir), iterations=1), "x", "y", "z")


def mesh_kinds(spark, sf_dir):
    """What a box and the terrain are."""
    rows = [("box", mesh.kind(*_box(spark))), ("terrain", mesh.kind(*_terrain(spark, sf_dir)))]
    return spark.createDataFrame(rows, "name string, kind string")


_BOX = ", ".join(f"abs({c} - {(a + b) / 2}) - {(b - a) / 2} AS q{c}" for c, a, b in zip("xyz", LOW, HIGH))
_IN = "p AS (SELECT p_partkey AS loc_id, p_size / 5.0::DOUBLE AS x, p_retailprice / 200 AS y, (p_partkey % 7)::DOUBLE AS z FROM part)"
_DISTANCE = f"""WITH {_IN}, q AS (SELECT loc_id, {_BOX} FROM p)
    SELECT loc_id, round(CASE WHEN greatest(qx, qy, qz) < 0 THEN greatest(qx, qy, qz) ELSE sqrt(pow(greatest(qx, 0), 2) + pow(greatest(qy, 0), 2) + pow(greatest(qz, 0), 2)) END, 6) AS distance FROM q"""
_TURN = """p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 50 AS y, (p_partkey % 19)::DOUBLE AS z FROM part),
l AS (SELECT *, 5 + sqrt(0.75) * (x - 5) + 0.5 * (y - 5) AS lx, 5 - 0.5 * (x - 5) + sqrt(0.75) * (y - 5) AS ly FROM p), h AS (SELECT *, floor(lx / 10) AS i, floor(ly / 10) AS j, floor(z / 10) AS k FROM l)"""
_Z = "p AS (SELECT p_partkey, p_size / 25.0::DOUBLE AS x, p_retailprice / 1000 AS y FROM part), q AS (SELECT p_partkey, abs((x - 1) / 0.5 - (y - 1)) AS u, abs((y - 1.5) / 0.25 - (x - 1)) AS v, CASE WHEN x > 1 THEN 1 ELSE -1 END AS s, 2 * y - 3 AS f FROM p)"
_J = "- ln(0.5 * 0.25)"
_HUBER_NORM = "ln(0.3 * (sqrt(2 * pi()) * 0.6826894921370859 + 2 * exp(-0.5)))"

SQL = {
    "variable_codes": """WITH b AS (SELECT p_brand AS l, row_number() OVER (ORDER BY p_brand) - 1 AS k FROM (SELECT DISTINCT p_brand FROM part)), r AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS k FROM (SELECT p_brand AS l FROM part UNION SELECT p_type FROM part))
        SELECT p_partkey, b.k::INT AS brand_0, (p_brand = 'Brand#11')::INT AS first, x.k::INT AS rock_0, y.k::INT AS rock_1, p_brand <> p_type AS contact FROM part JOIN b ON b.l = p_brand JOIN r x ON x.l = p_brand JOIN r y ON y.l = p_type""",
    "variable_metadata": "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE -1 END AS status, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE '-' END AS text FROM orders",
    "carried_variables": """SELECT p_partkey, p_size::DOUBLE AS size, 'both' AS variable FROM part WHERE p_size > 10 UNION ALL SELECT s_suppkey, -1.0, 'both' FROM supplier UNION ALL SELECT n_nationkey, -2.0, '[5.0, 20.0]' FROM nation""",
    "interval_tables": f"WITH {SQL_INTERVALS} SELECT hole, f, t, grade AS value, lith AS label, 0 AS problems FROM iv",
    "vector_metrics": """WITH e AS (SELECT embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, list_avg(list_transform(embedding, lambda x: x::DOUBLE)) AS m FROM embeddings),
        r AS (SELECT 'first' AS component, m - a AS d FROM e UNION ALL SELECT 'second', a - b FROM e) SELECT component, count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(avg(d), 6) AS bias FROM r GROUP BY 1""",
    "composition_metrics": """WITH p AS (SELECT p_size / 50.0::DOUBLE AS a, p_retailprice / 2000 AS b FROM part), r AS (SELECT 'a' AS component, 0.5 - a AS d FROM p UNION ALL SELECT 'b', 0.4 - b FROM p),
        g AS (SELECT avg(abs(ln(a / b) - ln(0.5 / 0.4)) / sqrt(2)) AS g FROM p) SELECT component, count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(avg(d), 6) AS bias, round(any_value(g), 6) AS aitchison FROM r, g GROUP BY 1""",
    "multivariate_densities": f"""WITH {_Z} SELECT p_partkey, round(-ln(2 * pi() * 0.2) - (u * u + v * v) / 0.4 {_J}, 6) AS gaussian, round(-2 * ln(0.6) - (u + v) / 0.3 {_J}, 6) AS laplace,
        round(-greatest(u / 0.3 - 0.5, 0) - greatest(v / 0.3 - 0.5, 0) - 2 * ln(0.9) {_J}, 6) AS flat,
        round(-CASE WHEN u <= 0.3 THEN u * u / 0.18 ELSE u / 0.3 - 0.5 END - CASE WHEN v <= 0.3 THEN v * v / 0.18 ELSE v / 0.3 - 0.5 END - 2 * {_HUBER_NORM} {_J}, 6) AS huber,
        round(-ln(1 + exp(-s * 1.5 * CASE WHEN abs(f) < 1 THEN 2 * f ELSE f + sign(f) END)), 6) AS margin FROM q""",
    "training_stop": """WITH RECURSIVE s AS (SELECT p_size, row_number() OVER (ORDER BY p_size) AS k, sum(sum(p_retailprice)) OVER (ORDER BY p_size) AS v FROM part GROUP BY p_size),
        m AS (SELECT k, v AS e, v AS start FROM s WHERE k = 1 UNION ALL SELECT s.k, 2.0::DOUBLE / 9 * s.v + 7.0::DOUBLE / 9 * m.e, start FROM m JOIN s ON s.k = m.k + 1)
        SELECT p_size, coalesce(abs(a.e - b.e) < 0.3 * abs(a.e - a.start), false) AS stop FROM s JOIN m a USING (k) LEFT JOIN m b ON b.k = a.k - 8""",
    "stored_points": "SELECT p_partkey, p_brand, p_retailprice, 'm' AS unit FROM part",
    "stored_lattice": """WITH n AS (SELECT p_size + 51 * least(floor(p_retailprice / 700), 2)::BIGINT AS cell, count(*) AS n FROM part GROUP BY 1)
        SELECT i AS cell, (i % 51)::DOUBLE AS x, (i // 51) * 500.0::DOUBLE AS y, coalesce(n, 0) AS n FROM range(0, 153) t(i) LEFT JOIN n ON n.cell = i""",
    "stored_blocks": "SELECT i AS block_id, (i % 4) * 10 + 5.0::DOUBLE AS x, (i // 4 % 4) * 10 + 5.0::DOUBLE AS y, (i // 16) * 10 + 5.0::DOUBLE AS z, 1000.0::DOUBLE AS volume, (SELECT count(*) FROM part WHERE p_partkey % 32 = i) AS n FROM range(0, 32) t(i)",
    "delimited_table": "SELECT p_partkey, CASE WHEN p_size > 40 THEN -1 ELSE p_size END::DOUBLE AS size, round(p_retailprice / 2000, 6) AS share FROM part",
    "exchanged_mesh": "SELECT p_partkey * 10.0::DOUBLE AS x, p_size::DOUBLE AS y, round(6.0::DOUBLE, 6) AS area FROM part",
    "solid_sides": f"WITH {_IN}, q AS (SELECT loc_id, {_BOX} FROM p) SELECT loc_id, CASE WHEN greatest(qx, qy, qz) < 0 THEN 'inside' ELSE 'outside' END AS side FROM q",
    "solid_distance": _DISTANCE,
    "solid_distance_by_cells": _DISTANCE,
    "mesh_pieces": "SELECT c_custkey AS f, c_nationkey::BIGINT AS piece FROM customer",
    "rotated_blocks": f"WITH {_TURN} SELECT p_partkey, x, CASE WHEN i BETWEEN 0 AND 3 AND j BETWEEN 0 AND 3 AND k BETWEEN 0 AND 1 THEN i + 4 * j + 16 * k ELSE -1 END::BIGINT AS block_id FROM h",
    "rotated_centres": """WITH n AS (SELECT p_partkey % 32 AS block_id, count(*) AS n FROM part GROUP BY 1), s AS (SELECT i AS sub, (i % 2) * 5 - 2.5 AS sx, (i // 2 % 2) * 5 - 2.5 AS sy, (i // 4) * 5 - 2.5 AS sz FROM range(0, 8) t(i)),
        l AS (SELECT block_id, sub, n, (block_id % 4) * 10 + sx AS lx, (block_id // 4 % 4) * 10 + sy AS ly, (block_id // 16) * 10 + sz AS lz FROM n, s)
        SELECT block_id, sub, n, round(5 + sqrt(0.75) * lx - 0.5 * ly, 6) AS x, round(5 + 0.5 * lx + sqrt(0.75) * ly, 6) AS y, round(5.0::DOUBLE + lz, 6) AS z FROM l""",
    "fitted_blocks": f"""WITH {_TURN}, e AS (SELECT count(*) AS parts, (floor((max(lx) - min(lx)) / 10) + 1) * (floor((max(ly) - min(ly)) / 10) + 1) * (floor((max(z) - min(z)) / 10) + 1) AS blocks FROM h) SELECT parts, 0 AS outside, blocks::INT AS blocks FROM e""",
    "block_shares": """WITH s AS (SELECT p_partkey % 32 AS block_id, avg((p_size > 25)::INT) AS s FROM part GROUP BY 1) SELECT block_id, round(s, 6) AS share, s > 0 AND s < 1 AS crossed, least(s, 1 - s) > 0.45 AS split FROM s""",
    "missing_blocks": """WITH n AS (SELECT p_partkey % 32 AS b, sum(p_size) AS n FROM part GROUP BY 1), t AS (SELECT b FROM n WHERE n > (SELECT avg(n) FROM n))
        SELECT (i % 4) * 4 AS ox, (i // 4 % 4) * 4 AS oy, (i // 16) * 4 AS oz, 0 AS level, false AS full FROM range(0, 32) r(i) WHERE i NOT IN (SELECT b FROM t)""",
    "smoothed_mesh": f"""WITH {_V}, {_F}, {_E}, g AS (SELECT DISTINCT u, w FROM e), r AS (SELECT u, w FROM g UNION ALL SELECT w, u FROM g), m AS (SELECT u, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM r JOIN v ON v.v = w GROUP BY u),
        a AS (SELECT v.v, v.x + 0.5 * (m.x - v.x) AS x, v.y + 0.5 * (m.y - v.y) AS y, v.z + 0.5 * (m.z - v.z) AS z FROM v JOIN m ON u = v.v), n AS (SELECT u, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM r JOIN a ON a.v = w GROUP BY u)
        SELECT a.v, round(a.x - 0.53 * (n.x - a.x), 6) AS x, round(a.y - 0.53 * (n.y - a.y), 6) AS y, round(a.z - 0.53 * (n.z - a.z), 6) AS z FROM a JOIN n ON u = a.v""",
    "mesh_kinds": "SELECT 'box' AS name, 'solid' AS kind UNION ALL SELECT 'terrain', 'dtm'",
}
SQL = {k: v.replace("round(", "round(3e-10 + ") for k, v in SQL.items()}

QUERIES = {
    f.__name__: f
    for f in (
        variable_codes, variable_metadata, carried_variables, interval_tables, vector_metrics, composition_metrics, multivariate_densities, training_stop, stored_points, stored_lattice, stored_blocks,
        delimited_table, exchanged_mesh, solid_sides, solid_distance, solid_distance_by_cells, mesh_pieces, rotated_blocks, rotated_centres, fitted_blocks, block_shares, missing_blocks, smoothed_mesh, mesh_kinds,
    )
}
