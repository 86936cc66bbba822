"""Models by identities: interpolation, batch invariance, derivatives, inverses, and agreement of sparse with exact."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.models import gp, kernels, stats, warpings


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, (80, 2))
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1]
    return spark.createDataFrame([(int(i), float(a), float(b), float(v), "hi" if v > 1.5 else "lo", int(i) % 4) for i, ((a, b), v) in enumerate(zip(x, y))], "loc_id long, x double, y double, v double, label string, fold int")


def test_interpolation_and_batches(spark, points):
    model = gp.GP(["x", "y"], "v", kernels.Covariance("gaussian", kernels.Isotropic(5.0)), noise=1e-8, trend=True).fit(points)
    got = model.predict(points.repartition(5), n_sim=6).select("loc_id", "v", "prediction.*").toPandas().sort_values("loc_id")
    assert np.allclose(got["mean"], got["v"], atol=1e-2) and (got["variance"] < 1e-3).all()
    again = model.predict(points.coalesce(1), n_sim=6).select("loc_id", "prediction.*").toPandas().sort_values("loc_id")
    assert np.allclose(np.stack(got["sims"]), np.stack(again["sims"]), atol=1e-8)


def test_training_raises_the_likelihood(points):
    make = lambda p: kernels.Covariance("gaussian", kernels.ARD(p))
    model = gp.GP(["x", "y"], "v", make(np.array([1.0, 1.0])), noise=0.1).fit(points)
    before = model.log_likelihood()
    assert model.train(make, [1.0, 1.0], 60).log_likelihood() > before + 10


def test_sparse_with_all_points_is_exact(points):
    data = points.select("x", "y").toPandas().to_numpy()
    k = kernels.Covariance("matern52", kernels.Isotropic(6.0))
    exact = gp.GP(["x", "y"], "v", k, noise=0.1).fit(points)
    sparse = gp.SparseGP(["x", "y"], "v", data, k, noise=0.1).fit(points)
    x = np.random.default_rng(1).uniform(0, 10, (30, 2))
    a, b = exact.raw(x, 0, np.zeros(0)), sparse.raw(x, 0, np.zeros(0))
    assert np.allclose(a["mean"], b["mean"], atol=1e-2) and np.allclose(a["variance"], b["variance"], atol=1e-2)
    assert abs(sparse.bound - exact.log_likelihood()) < 1.0
    assert sparse.train_noise(30).bound > exact.log_likelihood() - 1


def test_cross_validation_classes_and_ensembles(points):
    fit = lambda d: gp.GP(["x", "y"], "v", kernels.Covariance("gaussian", kernels.Isotropic(5.0)), noise=1e-3).fit(d)
    oof = gp.cross_validate(points, "fold", fit, 5)
    assert oof.count() == 80 and oof.select(F.avg(F.abs(F.col("prediction.mean") - F.col("v")))).first()[0] < 0.2
    got = gp.Classifier(["x", "y"], "label", kernels.Covariance("gaussian", kernels.Isotropic(5.0))).fit(points).predict(points)
    assert got.where("prediction.label = label").count() > 72
    both = gp.combine([fit(points), fit(points)], points)
    assert abs(both.select(F.avg(F.col("mean") - F.col("v"))).first()[0]) < 0.05


def test_structural_field(spark):
    t = spark.createDataFrame([(float(i), 0.0, 1.0, 0.0) for i in range(5)], "x double, y double, dx double, dy double")
    n = spark.createDataFrame([(2.0, 1.0, 0.0, 1.0), (0.0, 2.0, 0.0, 1.0)], "x double, y double, dx double, dy double")
    field = gp.StructuralField(["x", "y"], kernels.Covariance("gaussian", kernels.Isotropic(6.0))).fit_directions(t, n, ["dx", "dy"])
    v = field._cross(np.array([[0.5, 0.0], [3.5, 0.0], [2.0, 0.5], [2.0, 1.5]])) @ field.alpha
    assert abs(v[0] - v[1]) < 0.15 and v[3] - v[2] > 0.7


@pytest.mark.parametrize("name", ["gaussian", "cubic", "matern52", "rational"])
def test_kernel_derivatives(name):
    k = kernels.Covariance(name, kernels.Anisotropy2D(7.0, 0.6, 25.0)) * kernels.Covariance("gaussian", kernels.Isotropic(9.0)) + kernels.Scale(kernels.Covariance(name, kernels.Isotropic(8.0)), 2.0)
    rng = np.random.default_rng(2)
    x, y, p, q = (rng.uniform(0, 4, (3, 2)) for _ in range(4))
    e = 1e-4
    first = np.array([[(k(x[i : i + 1], y[j : j + 1] + e * q[j]) - k(x[i : i + 1], y[j : j + 1] - e * q[j]))[0, 0] / (2 * e) for j in range(3)] for i in range(3)])
    assert np.allclose(k.d1(x, y, q), first, atol=1e-5)
    second = np.array([[(k.d1(x[i : i + 1] + e * p[i], y[j : j + 1], q[j : j + 1]) - k.d1(x[i : i + 1] - e * p[i], y[j : j + 1], q[j : j + 1]))[0, 0] / (2 * e) for j in range(3)] for i in range(3)])
    assert np.allclose(k.d2(x, y, p, q), second, atol=1e-4)
    assert np.linalg.eigvalsh(k(x, x)).min() > -1e-9


@pytest.mark.parametrize("w", [warpings.ZScore(robust=True), warpings.Log(), warpings.Softplus(), warpings.Spline(), warpings.Chained(warpings.Log(), warpings.ZScore(), warpings.Spline())])
def test_warpings_invert(w):
    x = np.random.default_rng(3).gamma(2.0, 2.0, (200, 1)) + 0.1
    w.initialize(x)
    z, d = w.forward(x)
    assert np.allclose(w.backward(z), x, atol=1e-5)
    e = 1e-6
    assert np.allclose(d, np.log(np.abs((w.forward(x + e)[0] - w.forward(x - e)[0]) / (2 * e)))[:, 0], atol=1e-2)


def test_vector_warpings_invert():
    x = np.random.default_rng(4).dirichlet([2, 3, 4], 50)
    for w in (warpings.CenteredLogRatio(), warpings.PCA()):
        w.initialize(x)
        assert np.allclose(w.backward(w.forward(x)[0]), x, atol=1e-4)
    s = warpings.Sigmoid()
    assert np.allclose(s.backward(s.forward(x)[0]), x)


def test_distributions_and_solvers():
    p = np.linspace(0.01, 0.99, 41)
    assert np.allclose(stats.normal_cdf(stats.normal_quantile(p)), p, atol=1e-9)
    e = stats.EpsilonInsensitive(1.0, 2.0, 0.7)
    assert np.allclose(e.cdf(e.quantile(p)), p)
    for d in (e, stats.Huber(1.0, 2.0, 1.3)):
        g = np.linspace(-80, 80, 200_001)
        mass = np.exp(d.log_prob(g))
        assert abs(mass.sum() * (g[1] - g[0]) - 1) < 1e-3 and np.allclose(np.cumsum(mass)[::20000] * (g[1] - g[0]), d.cdf(g)[::20000], atol=2e-3)
    a = np.random.default_rng(5).standard_normal((40, 40))
    a = a @ a.T + 40 * np.eye(40)
    b = np.arange(40.0)[:, None]
    assert np.allclose(stats.conjugate_gradient(lambda v: a @ v, b), np.linalg.solve(a, b))
    assert abs(stats.log_determinant(lambda v: a @ v, 40, 30) - np.linalg.slogdet(a)[1]) < 3
    assert abs(stats.wasserstein_1([0, 1], [2, 3]) - 2) < 1e-12


def test_variational_gaussian_is_the_sparse_optimum(points):
    from lithic.models import likelihoods, variational

    data = points.select("x", "y").toPandas().to_numpy()
    k = kernels.Covariance("matern52", kernels.Isotropic(6.0))
    u = data[::4]
    sparse = gp.SparseGP(["x", "y"], "v", u, k, noise=0.1).fit(points)
    own = variational.VariationalGP(["x", "y"], "v", u, likelihoods.Gaussian(0.1), k).fit(points, 3)
    x = np.random.default_rng(6).uniform(0, 10, (30, 2))
    a, b = sparse.raw(x, 0, np.zeros(0)), own.raw(x, 0, np.zeros(0))
    assert np.allclose(a["mean"], b["mean"], atol=1e-2) and np.allclose(a["variance"], b["variance"], atol=1e-2)
    assert abs(own.bounds[-1] - sparse.bound) < 0.5
    half = variational.VariationalGP(["x", "y"], "v", u, likelihoods.Gaussian(0.1), k).fit_batches(points, 8, 2)
    assert np.abs(half.raw(x, 0, np.zeros(0))["mean"] - b["mean"]).mean() < 0.1


@pytest.mark.parametrize("name", ["Laplace", "StudentT", "Huber", "EpsilonInsensitive", "Bernoulli", "Gamma", "Mixture"])
def test_other_likelihoods_raise_their_bound(points, name):
    from lithic.models import likelihoods, variational

    kind = getattr(likelihoods, name)()
    df = points.withColumn("v", (F.col("label") == "hi").cast("double") if name == "Bernoulli" else F.abs("v") + 0.1)
    u = points.select("x", "y").toPandas().to_numpy()[::4]
    model = variational.VariationalGP(["x", "y"], "v", u, kind, kernels.Covariance("gaussian", kernels.Isotropic(5.0))).fit(df, 8, 0.5)
    assert model.bounds[-1] > model.bounds[0]
    y, f, v = np.array([0.4, 1.0]), np.array([0.2, 0.1]), np.array([0.3, 0.2])
    e = 1e-5
    if name in ("StudentT", "Gamma"):
        base = kind.expectations(y, f, v)
        assert np.allclose(base[1], (kind.expectations(y, f + e, v)[0] - kind.expectations(y, f - e, v)[0]) / (2 * e), atol=1e-3)
        assert np.allclose(base[2], (kind.expectations(y, f, v + e)[0] - kind.expectations(y, f, v - e)[0]) / (2 * e), atol=2e-2)


def test_networks_persistence_and_refinement(spark, points, tmp_path):
    from lithic.models import likelihoods, persistence, refine, variational
    from lithic.operators.blocks import BlockSet

    one = gp.GP(["x", "y"], "v", kernels.Covariance("gaussian", kernels.Isotropic(5.0)) + kernels.Scale(kernels.Covariance("cubic", kernels.ARD([4.0, 6.0])), 0.5), warpings.ZScore(), noise=0.01).fit(points)
    persistence.save_model(spark, one, str(tmp_path / "m"))
    two = persistence.load_model(spark, str(tmp_path / "m"))
    x = np.random.default_rng(7).uniform(0, 10, (9, 2))
    assert np.allclose(one.raw(x, 0, np.zeros(0))["mean"], two.raw(x, 0, np.zeros(0))["mean"])
    p = variational.Process(one)
    for node in (variational.Linear(p), variational.LinearCombination(p, p), variational.ProductOfExperts(p, p), variational.Exponentiation(p), variational.Multiply(p, p), variational.Add(p, p), variational.Bias(p, 1.0), variational.Scale(p, 2.0), variational.RadialTrend([5.0, 5.0], 3.0), variational.Select(variational.Stack(p, p), [1]), variational.Walk(variational.Stack(p, p), p)):
        m, v = node.moments(x)
        assert m.shape == v.shape and np.isfinite(m).all() and (v >= 0).all()
    m, v = variational.ProductOfExperts(p, p).moments(x)
    assert np.allclose(m, p.moments(x)[0])
    assert "Process" in variational.to_dot(variational.Add(p, p))
    net = variational.Network(["x", "y"], variational.Bias(p, 1.0)).predict(points, 3)
    assert net.select("prediction.mean").count() == 80
    q = likelihoods.Ordered([0.0, 1.0]).probabilities(np.array([0.5, -3.0]))
    assert np.allclose(q.sum(-1), 1) and np.allclose(likelihoods.categorical_entropy(np.full((1, 4), 0.25)), 1) and np.allclose(likelihoods.indicators(np.array([[0.5, 0.5]])), 0)
    r = likelihoods.Mixture([0.1, 3.0]).responsibilities(np.zeros(2), np.full(2, 0.01), np.array([0.0, 5.0]))
    assert r[0, 0] > 0.5 > r[1, 0]

    lattice = BlockSet((1.0, 1.0, 1.0), (4, 4, 1), (2.0, 2.0, 2.0), max_levels=2)
    plane = spark.createDataFrame([(float(i), float(j), float(k), float(i - 3.4)) for i in range(0, 9, 2) for j in range(0, 9, 2) for k in (0, 2)], "x double, y double, z double, v double")
    model = gp.GP(["x", "y", "z"], "v", kernels.Covariance("gaussian", kernels.Isotropic(12.0)), noise=1e-4).fit(plane)
    out = refine.refine(model, lattice, lattice.rows(spark), [0.0], 5)
    assert lattice.is_full(out) and lattice.unbalanced(out).isEmpty()
    near = lattice.with_size(out).where("level = 2")
    assert near.count() > 0 and near.agg(F.avg(F.abs(F.col("x") - 3.4))).first()[0] < 1.0


def test_robust_and_independent_components():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 2)) @ np.array([[2.0, 0.5], [0.0, 1.0]])
    dirty = np.concatenate([x, rng.normal(40, 1, (60, 2))])
    mean, _ = warpings.robust_moments(dirty)
    assert np.abs(mean - x.mean(0)).max() < 0.3 < np.abs(dirty.mean(0) - x.mean(0)).min()
    sources = rng.uniform(-1, 1, (2000, 2)) * np.sqrt(3)
    turned = sources @ np.array([[np.cos(0.7), np.sin(0.7)], [-np.sin(0.7), np.cos(0.7)]])
    white = warpings.PCA().initialize(turned).forward(turned)[0]
    r = warpings.Rotation().initialize(white)
    found = np.abs(np.corrcoef(r.forward(white)[0].T, sources.T)[:2, 2:])
    assert (found.max(1) > 0.97).all() and np.allclose(r.backward(r.forward(white)[0]), white)
    p = rng.dirichlet([2, 3, 4], 20)
    s = warpings.ScaledSimplex().initialize(p)
    assert np.allclose(s.backward(s.forward(p)[0]), p)


def test_interpolation_on_lattices_and_curves():
    from lithic.models.interpolate import CubicConvolution, CubicSpline

    x, y = np.arange(8.0), np.arange(6.0)
    f = lambda a, b: a**2 - a * b + b
    c = CubicConvolution([0, 0], [1, 1], f(x[:, None], y[None]))
    p = np.random.default_rng(9).uniform(1, 4, (40, 2))
    assert np.allclose(c(p), f(p[:, 0], p[:, 1]))
    k = np.array([0.0, 1, 2, 4, 5])
    v = np.array([0.0, 0.1, 3, 3.05, 8])
    s = CubicSpline(k, v, monotone=True)
    g = np.linspace(-1, 6, 400)
    assert np.allclose(s(k), v) and (np.diff(s(g)) >= -1e-12).all() and np.allclose(s.inverse(s(g)), g, atol=1e-5)
    assert np.allclose(s.gradient(g[1:-1]), (s(g[1:-1] + 1e-6) - s(g[1:-1] - 1e-6)) / 2e-6, atol=1e-4)


def test_built_kernels_and_parameters():
    from lithic.models import parameters as P

    x = np.random.default_rng(10).uniform(0, 5, (12, 2))
    for k in (kernels.additive("gaussian", [2.0, 3.0]), kernels.projected("matern52", 2, 9, 3.0), kernels.nested("spherical", [1.0, 4.0])):
        c = k(x, x)
        assert np.allclose(np.diag(c), 1) and np.linalg.eigvalsh(c).min() > -1e-9
    sure = np.concatenate([x, np.zeros_like(x)], 1)
    assert np.allclose(kernels.UncertainInput([2.0, 3.0])(sure, sure), kernels.Covariance("gaussian", kernels.ARD([2.0, 3.0]))(x, x))
    vague = np.concatenate([x, np.ones_like(x)], 1)
    assert (np.diag(kernels.UncertainInput([2.0, 3.0])(vague, vague)) < 1).all()
    shared = P.Positive(2.0, prior=lambda v: -v)
    r = P.Registry(a=shared, b=shared, c=P.Simplex([1.0, 3.0]), d=P.Circular(370.0, 0.0, 360.0), e=P.Parameter(9.0, 0.0, 5.0, fixed=True))
    assert len(r.unfixed()) == 3 and r.parameters["e"].value == 5 and r.parameters["d"].value == 10 and r.log_prior() == -2
    state = r.state()
    r.set_flat(r.flat() + 0.1)
    assert np.isclose(shared.value, 2 * np.exp(0.1)) and np.isclose(r.parameters["c"].value.sum(), 1)
    r.load(state)
    assert np.isclose(shared.value, 2.0)
    m = P.Orthonormal(np.random.default_rng(11).standard_normal((5, 3)), centred=True).value
    assert np.allclose(m.T @ m, np.eye(3)) and np.allclose(m.sum(0), 0) and np.allclose(np.linalg.norm(P.UnitColumns(m * 3).value, axis=0), 1)
