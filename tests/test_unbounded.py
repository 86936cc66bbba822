"""Searches without a last round, distances to any number of faces, and corrected formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.models import likelihoods, variational, warpings
from lithic.operators import contour, mesh, metrics, spatial


def test_a_long_strip_is_one_piece(spark):
    face = spark.range(3000).select(F.col("id").alias("f"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    face = face.withColumns({k: F.when(F.col("f") >= 2000, F.col(k) + 10_000).otherwise(F.col(k)) for k in "abc"})
    got = {r.piece: r.n for r in mesh.pieces(face).groupBy("piece").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 2000, 12_000: 1000}
    assert mesh.pieces(face.limit(0)).count() == 0


def test_far_points_get_their_answer(spark):
    left = spark.createDataFrame([(1, 0.2), (2, 1e9), (3, None), (4, float("nan"))], "loc_id long, x double")
    right = spark.createDataFrame([(7, 0.0), (8, 5.0), (9, 5.0)], "loc_id long, x double")
    got = {r.l_id: (r.r_id, r.distance) for r in spatial.nearest(left, right, ["x"], 1.0).collect()}
    assert got == {1: (7, 0.2), 2: (8, 1e9 - 5)}
    assert spatial.nearest(left, right.limit(0), ["x"], 1.0).count() == 0


def test_distances_by_cells_equal_those_to_all_faces(spark):
    rng = np.random.default_rng(1)
    tri = rng.uniform(0, 10, (60, 1, 3)) + rng.uniform(-1, 1, (60, 3, 3))
    tri[0] = [[0, 0, 0], [30, 0, 0], [0, 30, 1]]
    pts = np.concatenate([rng.uniform(-2, 12, (80, 3)), [[500.0, 1.0, 2.0]]])
    full = spark.createDataFrame([(i, *map(float, t.ravel())) for i, t in enumerate(tri)], "f long, " + ", ".join(f"{k}{c} double" for k in "abc" for c in "xyz"))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "loc_id long, x double, y double, z double")
    got = {r.loc_id: r.distance for r in contour.face_distances(points, full).collect()}
    assert np.allclose([got[i] for i in range(len(pts))], contour.triangle_distances(pts, tri))


def test_signed_distance_beyond_the_broadcast(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 0.0, 4.0, 0.0), (3, 0.0, 0.0, 4.0)], "v long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 2, 1), (1, 0, 1, 3), (2, 0, 3, 2), (3, 1, 2, 3)], "f long, a long, b long, c long")
    points = spark.createDataFrame([(1, 0.7, 0.6, 0.5), (2, 5.0, 5.0, 5.0), (3, -1.0, 0.3, 0.2)], "loc_id long, x double, y double, z double")
    few, many = ({r.loc_id: r.distance for r in contour.signed_distance(points, v, f, broadcast_faces=n).collect()} for n in (100, 2))
    assert few[1] < 0 < few[2] and few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few)


def test_conformal_levels(spark):
    rng = np.random.default_rng(2)
    pit = rng.uniform(0, 1, 501)
    df = spark.createDataFrame([(float(p),) for p in [*pit, float("nan")]], "pit double")
    scores = np.sort(np.abs(pit - 0.5))
    got = metrics.conformal_nominal(df, "pit", [0.1, 0.5, 0.9, 0.9999], bins=8)
    for c, level in got.items():
        k = int(np.ceil(502 * c))
        assert abs(level - (1.0 if k > 501 else 2 * scores[k - 1])) < 1e-2
    exact = metrics.conformal_nominal(df, "pit", [0.1, 0.5, 0.9])
    assert all(abs(level - 2 * scores[int(np.ceil(502 * c)) - 1]) < 1e-12 for c, level in exact.items())
    with pytest.raises(ValueError):
        metrics.conformal_nominal(df.limit(0), "pit", [0.5])
    rows = spark.createDataFrame([([3.0, 1.0, 2.0, 5.0, 4.0],)], "s array<double>")
    assert metrics.conformal_interval(rows, "s", 0.5).select("lower", "upper").first() == (2.0, 4.0)


class Given(variational.Node):
    def __init__(self, mean, var, share=None):
        self.m, self.v, self.s = np.array([[mean]]), np.array([[var]]), share

    def moments(self, x):
        return self.m, self.v

    def explained(self, x):
        return super().explained(x) if self.s is None else np.array([[self.s]])


def test_experts_weigh_by_what_they_explain():
    a, b = Given(1.0, 0.5, 0.75), Given(3.0, 2.0, 0.2)
    wa, wb = 0.75 / (0.5 + 1e-6) + 1e-6, 0.2 / (2 + 1e-6) + 1e-6
    mean, var = variational.ProductOfExperts(a, b).moments(np.zeros((1, 1)))
    assert np.isclose(mean, (wa + 3 * wb) / (wa + wb)) and np.isclose(var, (0.5 * wa + 2 * wb) / (wa + wb))


def test_compositions_come_back_without_negative_parts():
    rng = np.random.default_rng(3)
    x = rng.dirichlet([2, 1, 0.5], 50)
    w = warpings.ScaledSimplex().initialize(x)
    assert np.allclose(w.backward(w.forward(x)[0]), x)
    back = w.backward(rng.standard_normal((200, 3)) * 3)
    assert (back >= 0).all() and np.allclose(back.sum(1), 1) and (back.min(1) < 1e-12).any()


def test_gamma_shape():
    g = likelihoods.Gamma(0.5)
    shape = np.exp(0.2 + 0.5) + 0.01
    from math import lgamma

    assert np.isclose(g.log_density(np.array([2.0]), np.array([0.2]))[0], (shape - 1) * np.log(2.0) - 2.0 - lgamma(shape))


@pytest.mark.parametrize("n_cuts", [3, 150])
@pytest.mark.parametrize("density", [None, 2.5, "d", "ds"])
def test_grade_and_tonnage(spark, n_cuts, density):
    from lithic.operators.ensemble import grade_tonnage

    rng = np.random.default_rng(4)
    v, ds, d = rng.uniform(0, 1, (60, 5)), rng.uniform(1, 3, (60, 5)), rng.uniform(1, 3, 60)
    v[3, 2], v[4, 1], v[5] = np.nan, np.inf, -1.0
    rows = [(i, [float(x) for x in a], [float(x) for x in b], float(c)) for i, (a, b, c) in enumerate(zip(v, ds, d))] + [(99, None, None, 1.0), (98, [], [], 1.0), (97, [None, 0.9], [1.0, 1.0], 1.0)]
    df = spark.createDataFrame(rows, "block long, sims array<double>, ds array<double>, d double")
    cuts = np.linspace(0.02, 0.9, n_cuts)
    got = {(r.sim, round(r.cutoff, 9)): (r.tonnage, r.metal, r.grade) for r in grade_tonnage(df, "sims", list(cuts), 4.0, density).collect()}
    w = np.full((60, 5), 4.0) * {None: 1.0, 2.5: 2.5}.get(density, ds if density == "ds" else d[:, None] if density == "d" else 1.0)
    good = np.isfinite(v)
    assert len(got) == 5 * n_cuts
    for s in range(5):
        for c in cuts:
            hit = good[:, s] & (v[:, s] >= c)
            extra = 4.0 * (2.5 if density == 2.5 else 1.0) if s == 1 and c <= 0.9 else 0.0
            t, m = w[hit, s].sum() + extra, (w[hit, s] * v[hit, s]).sum() + 0.9 * extra
            a, b, g = got[s, round(float(c), 9)]
            assert np.isclose(a, t) and np.isclose(b, m) and (g is None if t == 0 else np.isclose(g, m / t))
