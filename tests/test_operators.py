"""Operators by closed forms and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.functions import arrays, composition, core, geometry, paths, scalars
from lithic.operators import blocks, desurvey, intervals, lattice, mesh, metrics, spatial
from lithic.sources import tables


def test_nan_becomes_null(spark):
    df = core.nan_to_null(spark.createDataFrame([(1.0, "a"), (float("nan"), "b")], "x double, s string"))
    assert df.where("x is null").count() == 1 and df.agg(F.avg("x")).first()[0] == 1.0


def test_straight_and_bent_holes(spark):
    collar = spark.createDataFrame([("a", 0.0, 0.0, 100.0, 50.0), ("b", 10.0, 0.0, 0.0, 50.0), ("c", 0.0, 0.0, 0.0, 9.0)], "hole string, x double, y double, z double, length double")
    # b turns from straight down to level towards east on a quarter circle of radius 100.
    arc = math.pi / 2 * 100
    survey = spark.createDataFrame([("a", 0.0, 45.0, 90.0), ("b", 0.0, 90.0, 90.0), ("b", arc, 0.0, 90.0), ("orphan", 0.0, 1.0, 1.0)], "hole string, depth double, dip double, azimuth double")
    traces = desurvey.stations(collar, survey)
    pts = spark.createDataFrame([("a", 10.0), ("b", arc), ("b", arc / 2), ("b", arc + 7), ("c", 5.0), ("nowhere", 1.0)], "hole string, depth double")
    got = {(r.hole, round(r.depth, 3)): (r.x, r.y, r.z) for r in desurvey.coordinates_at(pts, traces).collect()}
    s = 10 / math.sqrt(2)
    assert np.allclose(got["a", 10.0], (s, 0, 100 - s))
    assert np.allclose(got["b", round(arc, 3)], (110, 0, -100)) and np.allclose(got["b", round(arc + 7, 3)], (117, 0, -100))
    assert np.allclose(got["b", round(arc / 2, 3)], (10 + 100 * (1 - math.cos(math.pi / 4)), 0, -100 * math.sin(math.pi / 4)))
    assert np.allclose(got["c", 5.0], (0, 0, -5)) and got["nowhere", 1.0] == (None, None, None)
    assert desurvey.orphan_surveys(collar, survey).count() == 1


def test_compositions(spark):
    df = spark.createDataFrame([(1, 20.0, 30.0), (2, 0.0, 40.0), (3, None, 10.0), (4, 70.0, 40.0)], "i int, a double, b double")
    got = {r.i: r for r in intervals.prepare_composition(df, ["a", "b"], "%", "rest").collect()}
    assert got[3].a is None and got[3].b is None and abs(got[2].a - 0.1) < 1e-12
    assert all(abs(r.a + r.b + r.rest - 1) < 1e-12 for r in got.values() if r.a is not None) and got[4].rest > 0
    closed = intervals.prepare_composition(df, ["a", "b"], {"a": "%", "b": "%"}).where("a is not null")
    assert closed.where("abs(a + b - 1) > 1e-12").count() == 0
    p = composition.parts("a", "b")
    back = closed.select(composition.clr_inverse(composition.clr(p)).alias("q"), p.alias("p")).collect()
    assert np.allclose([r.q for r in back], [r.p for r in back])
    with pytest.raises(ValueError):
        intervals.divisor("bushel")
    with pytest.raises(ValueError):
        intervals.group_categories(df, "a", {"x": ["1"], "y": ["1"]})


def test_majority_tie_and_missing_labels(spark):
    target = spark.createDataFrame([("h", 0.0, 10.0), ("h", 20.0, 30.0)], "hole string, f double, t double")
    source = spark.createDataFrame([("h", 0.0, 5.0, "b", 1), ("h", 5.0, 10.0, "a", 2), ("h", 10.0, 15.0, None, 3)], "hole string, f double, t double, lith string, src long")
    got = {r.f: r.lith for r in intervals.aggregate_onto(target, source, {"lith": "categorical"}).collect()}
    assert got == {0.0: "b", 20.0: None}
    got = {r.f: r.lith for r in intervals.aggregate_onto(target, source, {"lith": "ignore"}).collect()}
    assert got == {0.0: "a", 20.0: None}
    with pytest.raises(ValueError):
        intervals.aggregate_onto(target, source, {"lith": "nonsense"})


def test_grid_faces_rotation_and_sub_cells(spark):
    grid = lattice.Grid.of((0.0, 0.0), (3, 2), (10.0, 10.0))
    pts = spark.createDataFrame([(5.0, 0.0), (5.1, 0.0), (-5.0, 0.0), (25.0, 15.0), (25.1, 0.0)], "x double, y double")
    assert [r.cell for r in grid.with_cell(pts).collect()] == [0, 1, None, 5, None]
    assert sum(o[0] for o in lattice.Grid.of((0.0,), (3,), (4.0,), discretization=(4,)).sub_offsets()) == 0
    sub = lattice.Grid.of((0.0, 0.0, 0.0), (2, 2, 1), (4.0, 4.0, 2.0), discretization=(2, 2, 1))
    assert sub.sub_rows(spark).count() == 16
    turned = lattice.Grid.of((1.0, 2.0, 3.0), (3, 4, 2), (5.0, 6.0, 7.0), rotation=geometry.rotation_matrix(30, 20, 10))
    back = turned.with_cell(turned.rows(spark).withColumnRenamed("cell", "own"))
    assert back.where("own <> cell OR cell IS NULL").count() == 0
    a = geometry.angles_from_matrix(geometry.rotation_matrix(30, 20, 10))
    assert np.allclose(geometry.rotation_matrix(*a), geometry.rotation_matrix(30, 20, 10))
    cloud = spark.createDataFrame((np.random.default_rng(0).standard_normal((300, 3)) * [3, 30, 1]).tolist(), "x double, y double, z double")
    for g in (lattice.cover(cloud, ["x", "y", "z"], 2.0), lattice.rotated_cover(cloud, 2.0)):
        assert g.with_cell(cloud).where("cell IS NULL").count() == 0
    flat = lattice.smooth(grid, grid.rows(spark).select("cell", F.lit(3.0).alias("v")), "v", 1.0)
    assert np.allclose([r.v for r in flat.collect()], 3.0)
    quad = lattice.Grid.of((0.0,), (6,), (1.0,)).rows(spark).select("cell", (F.col("x") * F.col("x")).alias("v"))
    assert [r.v for r in lattice.laplacian(lattice.Grid.of((0.0,), (6,), (1.0,)), quad, "v", 0).orderBy("cell").collect()] == [0, 2, 2, 2, 2, 0]


def test_block_sets(spark):
    b = blocks.BlockSet((0.0, 0.0, 0.0), (3, 2, 2), (8.0, 8.0, 4.0), max_levels=2)
    base = b.rows(spark)
    assert b.is_full(base)
    once = b.split(base, F.col("block_id") == 0).drop("block_id", "sub", "fresh")
    twice = b.split(once, (F.col("level") == 1) & (F.col("ox") == 0) & (F.col("oy") == 0) & (F.col("oz") == 0)).drop("fresh")
    assert twice.count() == 11 + 7 + 8 and b.is_full(twice)
    assert abs(b.with_size(twice).agg(F.sum("volume")).first()[0] - 12 * 256) < 1e-9
    some = b.split(once, (F.col("level") == 1) & (F.col("ox") == 2) & (F.col("oy") == 0) & (F.col("oz") == 0)).drop("fresh")
    assert [(r.ox, r.oy, r.oz, r.level) for r in b.unbalanced(some).collect()] == [(4, 0, 0, 0)]
    assert b.unbalanced(once).count() == 0
    missing = b.missing(twice.where("level < 2"), spark)
    assert [(r.ox, r.oy, r.oz, r.level) for r in missing.collect()] == [(0, 0, 0, 1)]
    assert not b.is_full(twice.where("level < 2")) and b.overlapping(twice.union(base.select(*twice.columns).where("ox = 0 and oy = 0 and oz = 0"))).count() > 0
    assert b.group(once, F.col("level") == 1).count() == 12
    with pytest.raises(Exception, match="whole families"):
        b.group(once.where("ox <> 2"), F.col("level") == 1).collect()
    with pytest.raises(Exception, match="finest"):
        b.split(twice, F.col("level") == 2).collect()
    assert b.sub_rows(base).count() == 96


def box(spark, half=1.0):
    v = [(i, *(half * (1 if i >> k & 1 else -1) for k in range(3))) for i in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    polygons = spark.createDataFrame([(i, list(q)) for i, q in enumerate(quads)], "p long, corners array<long>")
    f = mesh.fan_triangulation(polygons).withColumn("f", F.monotonically_increasing_id()).select("f", "a", "b", "c")
    return spark.createDataFrame(v, "v long, x double, y double, z double"), f.cache()


def test_meshes(spark, tmp_path):
    v, f = box(spark)
    assert abs(mesh.area(v, f).first()[0] - 24) < 1e-9 and abs(abs(mesh.signed_volume(v, f).first()[0]) - 8) < 1e-9
    assert mesh.kind(v, f) == "solid" and mesh.open_edges(f).count() == 0 and mesh.reversed_edges(f).count() == 0
    rng = np.random.default_rng(1)
    p = rng.uniform(-2, 2, (300, 3))
    pts = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "loc_id long, x double, y double, z double")
    got = {r.loc_id: r.side for r in mesh.assign_from_solid(pts, v, f, "side").collect()}
    assert all((got[i] == "inside") == (np.abs(q).max() < 1) for i, q in enumerate(p))
    sheet = spark.createDataFrame([(0, -3.0, -3.0, -3.0), (1, 3.0, -3.0, 3.0), (2, 3.0, 3.0, 3.0), (3, -3.0, 3.0, -3.0)], "v long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "f long, a long, b long, c long")
    assert mesh.kind(sheet, faces) == "dtm"
    el = {r.loc_id: r.elevation for r in mesh.sheet_elevation(pts, sheet, faces).collect()}
    assert np.allclose([el[i] for i in range(300)], p[:, 0])
    two = f.union(f.select(F.col("f") + 100000000000, *((F.col(k) + 8).alias(k) for k in "abc")))
    assert mesh.pieces(two).select("piece").distinct().count() == 2
    assert mesh.smooth(v, f, 2).count() == 8
    n = mesh.vertex_normals(v, f).collect()
    assert np.allclose([np.linalg.norm([r.nx, r.ny, r.nz]) for r in n], 1)
    tables.write_dxf(v, f, str(tmp_path / "box.dxf"), (10.0, 0.0, 0.0))
    v2, f2 = tables.read_dxf(spark, str(tmp_path / "box.dxf"))
    assert v2.count() >= 1 and abs(mesh.area(v2, f2).first()[0] - 24) < 1e-6 and v2.agg(F.min("x")).first()[0] == 9
    tables.export_mesh_csv(v, f, str(tmp_path / "p"), str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), header=True).count() == 12


def test_containers_come_back(spark, tmp_path):
    grid = lattice.Grid.of((0.0, 0.0, 0.0), (3, 2, 2), (1.0, 2.0, 3.0), labels=("x", "y", "z"), rotation=geometry.rotation_matrix(10, 0, 0))
    tables.write_container(grid.rows(spark).withColumn("v", F.col("cell") * 2), str(tmp_path / "g"), grid, {"unit": "m"})
    df, back, notes = tables.open_container(spark, str(tmp_path / "g"))
    assert back == grid and notes == {"unit": "m"} and df.count() == 12 and df.where("v <> 2 * cell").count() == 0
    tables.write_container(spark.createDataFrame([(1.0, "a")], "x double, s string"), str(tmp_path / "p"))
    assert tables.open_container(spark, str(tmp_path / "p"))[1] is None
    (tmp_path / "w.dat").write_text("ID\tX\tY\tV\tU\tT\n1\t11\t8\t0\t-999\t2\n2\t8\t30\t-999\t3\t2\n")
    w = tables.read_sample(spark, "walker", str(tmp_path / "w.dat")).orderBy("ID").collect()
    assert w[0].U is None and w[1].V is None and w[0].V == 0.0
    (tmp_path / "a.csv").write_text("﻿Sand,Silt,Clay,Depth (m)\n77.5,19.5,3,10.4\n", encoding="utf-8")
    a = tables.read_sample(spark, "arctic_lake", str(tmp_path / "a.csv")).first()
    assert abs(a.Sand - 0.775) < 1e-12


def test_spatial(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 20, (150, 2))
    df = spark.createDataFrame([(i, float(a), float(b), float(a), int(i) % 30) for i, (a, b) in enumerate(p)], "loc_id long, x double, y double, v double, g int")
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    assert spatial.near_pairs(df, ["x", "y"], 3.0).count() == ((d <= 3).sum() - 150) // 2
    q = rng.uniform(-10, 30, (40, 2))
    other = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "loc_id long, x double, y double")
    got = {r.l_id: r.distance for r in spatial.nearest(other, df, ["x", "y"], 1.0).collect()}
    want = np.sqrt(((q[:, None] - p[None]) ** 2).sum(2)).min(1)
    assert np.allclose([got[i] for i in range(40)], want)
    w = spatial.decluster(df, ["x", "y"], "v")
    assert abs(w.agg(F.sum("weight")).first()[0] - 150) < 1e-9
    folds = spatial.spatial_k_fold(df, other, ["x", "y"], 3, group="g", candidates=3)
    assert folds.count() == 150 and folds.select("fold").distinct().count() == 3 and folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert spatial.snap_distinct([df.limit(5), df.limit(5)], ["x", "y"], 0.5).count() <= 5
    sims = df.withColumn("sims", F.array("v", F.col("v") + 1))
    assert spatial.variogram_score(sims, ["x", "y"], "v", "sims", 3.0).first().score < 1e-12
    fan = spatial.variogram_fan(sims, ["x", "y"], "sims", 4, 4.0).collect()
    assert len(fan) == 8
    assert {k: list(v) for k, v in spatial.merge_clusters(np.array([[0.0], [0.1], [9.0], [9.1]]), np.ones(4), [2]).items()} == {2: [0, 0, 1, 1]}


def test_arrays_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 9))
    df = spark.createDataFrame([(int(i), [*map(float, r)], float(i) / 10) for i, r in enumerate(x)] + [(99, [], 0.0), (98, [float("nan"), None, 1.0], 1.0)], "i int, s array<double>, y double")
    got = {r.i: r for r in df.select("i", arrays.quantiles(F.col("s"), [0.3]).alias("q"), arrays.crps(F.col("y"), F.col("s")).alias("c"), arrays.cdf(F.col("s"), 0.0).alias("p"), arrays.interval_score(F.col("y"), F.col("s"), 0.2).alias("k")).collect()}
    for i, r in enumerate(x):
        assert abs(got[i].q[0.3] - np.quantile(r, 0.3)) < 1e-12 and abs(got[i].p - (r <= 0).mean()) < 1e-12
        assert abs(got[i].c - (np.abs(r - i / 10).mean() - np.abs(r[:, None] - r[None]).mean() / 2)) < 1e-9
    assert got[99].q[0.3] is None and got[99].p is None and got[98].q[0.3] == 1.0
    assert abs(df.limit(1).select(scalars.normal_cdf(F.lit(1.0))).first()[0] - 0.8413447) < 1e-6


def test_metrics_edges(spark):
    df = spark.createDataFrame([(0.1 * k,) for k in range(11)], "pit double")
    n = metrics.conformal_nominal(df, "pit", [0.5, 0.99])
    assert n[0.99] == 1.0 and abs(n[0.5] - 0.6) < 1e-9
    e = spark.range(1).select(metrics.entropy(F.array(F.lit(0.5), F.lit(0.5))).alias("a"), metrics.entropy(F.array(F.lit(1.0), F.lit(0.0))).alias("b")).first()
    assert abs(e.a - 1) < 1e-12 and e.b == 0


def test_paths(spark):
    df = spark.sql("select 1 as id, named_struct('zn', named_struct('mean', 2.0D, 'quantiles', map(0.5D, 7.0D)), 'pb', named_struct('mean', 3.0D)) as v, 4 as v_zn_mean")
    assert paths.select_paths(df.schema, "v/*/mean") == [("v", "zn", "mean"), ("v", "pb", "mean")]
    assert len(paths.select_paths(df.schema, "**")) == 5 and paths.select_paths(df.schema, "**/mean") == paths.select_paths(df.schema, "v/*/mean")
    assert df.select(paths.get(df, "v/zn/quantiles", 0.5)).first()[0] == 7.0
    with pytest.raises(KeyError, match="zn"):
        paths.get(df, "v/cu")
    with pytest.warns(UserWarning):
        assert set(paths.flatten(df).columns) >= {"v_zn_mean", "v_zn_mean_2", "v_pb_mean"}
    assert "zn" in paths.tree(df.schema)


def test_streaming_prediction(spark, tmp_path):
    from lithic.models import gp
    from lithic.streaming.predict import predict_stream

    pts = spark.createDataFrame([(float(i), float(i % 3)) for i in range(10)], "x double, v double")
    pts.write.parquet(str(tmp_path / "in"))
    model = gp.GP(["x"], "v").fit(pts)
    stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    q = predict_stream(model, stream).writeStream.format("memory").queryName("predicted").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("predicted").count() == 10


def test_contours_distances_and_solids(spark):
    from lithic.operators import contour

    grid = lattice.Grid.of((-2.0, -2.0, -2.0), (17, 17, 17), (0.25, 0.25, 0.25), labels=("x", "y", "z"))
    ball = grid.rows(spark).select("cell", (1.5 - F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("v"))
    v, f = (d.cache() for d in contour.contour(grid, ball, "v", 0.0))
    assert mesh.kind(v, f) == "solid"
    assert abs(mesh.area(v, f).first()[0] - 4 * math.pi * 1.5**2) < 0.6 and abs(mesh.signed_volume(v, f).first()[0] - 4 / 3 * math.pi * 1.5**3) < 0.4
    flat = grid.rows(spark).select("cell", (F.col("z") + 0.1).alias("v"))
    v2, f2 = contour.contour(grid, flat, "v", 0.0)
    assert mesh.kind(v2, f2) == "dtm" and abs(mesh.area(v2, f2).first()[0] - 16) < 1e-6
    v3, f3 = contour.contour(grid, flat, "v", 0.0, close=-1.0)
    assert mesh.open_edges(f3).isEmpty()

    cube = box(spark)
    p = np.random.default_rng(9).uniform(-2, 2, (60, 3))
    pts = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "loc_id long, x double, y double, z double")
    got = {r.loc_id: r.distance for r in contour.signed_distance(pts, *cube).collect()}
    out = np.maximum(np.abs(p) - 1, 0)
    want = np.where((np.abs(p) < 1).all(1), np.abs(p).max(1) - 1, np.sqrt((out**2).sum(1)))
    assert np.allclose([got[i] for i in range(60)], want)
    moved = (cube[0].withColumn("x", F.col("x") + 1.0), cube[1])
    small = lattice.Grid.of((-1.55, -1.55, -1.55), (21, 16, 16), (0.2, 0.2, 0.2), labels=("x", "y", "z"))
    for operation, volume in (("union", 12.0), ("intersection", 4.0), ("difference", 4.0)):
        w, g = contour.combine_solids(cube, moved, operation, small)
        assert abs(mesh.signed_volume(w, g).first()[0] - volume) < 0.9


def test_sections_discs_growth_and_weights(spark):
    s = geometry.section(spark, (1.0, 2.0, 3.0), 90.0, 90.0, 4.0, 2.0, 5, 3)
    r = s.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.min("z"), F.max("z"), F.count("*")).first()
    assert np.allclose(r[:6], (-1, 3, 2, 2, 2, 4)) and r[6] == 15
    plane = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 30.0, 40.0)], "loc_id long, x double, y double, z double, azimuth double, dip double")
    n = np.array(plane.select(geometry.plane_normal(F.col("azimuth"), F.col("dip"))).first()[0])
    rims = np.array([[r.bx, r.by, r.bz] for r in geometry.disc_faces(plane, size=2.0).collect()])
    assert np.allclose(rims @ n, 0, atol=1e-12) and np.allclose(np.linalg.norm(rims, axis=1), 2)
    b = blocks.BlockSet((0.0, 0.0, 0.0), (5, 5, 1), (1.0, 1.0, 1.0), max_levels=1)
    grown = b.grow(b.rows(spark), F.col("block_id") == 12)
    assert grown.where("grown").count() == 9 and b.grow(b.rows(spark), F.col("block_id") == 12, 2).where("grown").count() == 25
    assert np.allclose(np.array(b.trilinear_weights()).sum(1), 1)
