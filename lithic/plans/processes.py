"""Queries over covariances, likelihoods, latent nodes and Gaussian processes, each with its SQL.

Parts are the data: x is the size in units of 25, y the retail price in thousands.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lithic.models import kernels as K
from lithic.models import likelihoods as L
from lithic.models import variational as V
from lithic.models import warpings as W
from lithic.models.gp import GP, SparseGP, StructuralField, combine, cross_validate
from lithic.models.parameters import Circular, Parameter, Positive, Simplex, UnitColumns
from lithic.models.rows import with_values
from lithic.operators import metrics as M
from lithic.plans.drillholes import _rounded, read


def _parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 25.0).alias("x"), (F.col("p_retailprice") / 1000).alias("y"))


SQL_PARTS = "p AS (SELECT p_partkey, p_size / 25.0::DOUBLE AS x, p_retailprice / 1000 AS y FROM part)"


def _values(df, columns, names, function):
    return _rounded(with_values(df, columns, names, function).select("p_partkey", *names), *names)


KERNELS = ["gaussian", "cubic", "matern32", "matern52", "spherical", "exponential", "constant", "cosine", "rational"]


def kernel_profiles(spark, sf_dir):
    """Each kernel between x and 0 with a range of 1.5."""

    def run(x):
        return np.concatenate([K.Covariance(k, K.Isotropic(1.5), 2.0)(x, np.zeros((1, 1))) for k in KERNELS], 1)

    return _values(_parts(spark, sf_dir), ["x"], KERNELS, run)


SMOOTH = ["gaussian", "matern32", "matern52", "cubic"]


def kernel_derivatives(spark, sf_dir):
    """Value against derivative, and derivative against derivative, of x and 0.3."""
    names = [f"{k}_{d}" for k in SMOOTH for d in ("d1", "d2")]

    def run(x):
        at, one = np.array([[0.3]]), np.ones((1, 1))
        cov = [K.Covariance(k, K.Isotropic(1.5)) for k in SMOOTH]
        return np.concatenate([f for c in cov for f in (c.d1(x, at, one), c.d2(x, at, np.ones_like(x), one))], 1)

    return _values(_parts(spark, sf_dir), ["x"], names, run)


def kernel_algebra(spark, sf_dir):
    """Sums, products, scales, dot products, and the kernels of several inputs, ranges or directions, of (x, y) and (0.5, 1)."""
    names = ["summed", "product", "scaled", "dot", "additive", "nested", "projected", "product_d1", "diagonal"]

    def run(x):
        at = np.array([[0.5, 1.0]])
        g, e = K.Covariance("gaussian", K.Isotropic(1.5)), K.Covariance("exponential", K.Isotropic(2.0))
        smooth = K.Covariance("matern32", K.Isotropic(2.0))
        return np.concatenate([
            K.Sum(g, e, weights=[3, 1])(x, at), (g * e)(x, at), K.Scale(g, 2.5)(x, at), K.Linear(K.Isotropic(2.0))(x, at), K.additive("gaussian", [1.5, 0.7])(x, at),
            K.nested("gaussian", [2.0, 0.5])(x, at), K.projected("gaussian", 2, 4, 1.2)(x, at), (g * smooth).d1(x, at, np.array([[0.6, 0.8]])), K.Scale(K.Linear(K.Isotropic(2.0)), 3.0).diagonal(x)[:, None],
        ], 1)

    return _values(_parts(spark, sf_dir), ["x", "y"], names, run)


def kernel_transforms(spark, sf_dir):
    """A Gaussian kernel of transformed coordinates: ranges by axis, an ellipse, a projection, one column, turns, and inputs with variances."""
    names = ["ard", "ellipse", "projection", "selected", "periodic", "uncertain"]

    def run(x):
        at = np.array([[0.5, 1.0]])
        ways = [K.ARD([1.5, 0.5]), K.Anisotropy2D(2.0, 0.4, 30.0), K.Chained(K.Projection([3.0, 4.0]), K.Isotropic(0.8)), K.Chained(K.Select([1], 2), K.Isotropic(0.6)), K.Chained(K.Periodic(), K.Isotropic(2.0))]
        wide = np.concatenate([x, 0.1 + 0.05 * x], 1)
        return np.concatenate([*(K.Covariance("gaussian", w)(x, at) for w in ways), K.UncertainInput([1.5, 0.9])(wide, np.array([[0.5, 1.0, 0.02, 0.03]]))], 1)

    return _values(_parts(spark, sf_dir), ["x", "y"], names, run)


def likelihood_densities(spark, sf_dir):
    """Log densities of y under a latent value of x."""
    kinds = {"gaussian": L.Gaussian(0.2), "laplace": L.Laplace(0.3), "student": L.StudentT(0.3, 4.0), "flat": L.EpsilonInsensitive(0.3, 0.5), "huber": L.Huber(0.3, 1.0), "mixture": L.Mixture([0.1, 0.6], [3, 1]), "gamma": L.Gamma(0.5)}
    return _values(_parts(spark, sf_dir), ["x", "y"], list(kinds), lambda x: np.stack([k.log_density(x[:, 1], x[:, 0]) for k in kinds.values()], 1))


def likelihood_expectations(spark, sf_dir):
    """Expected log density of y under a normal latent of mean x and variance 0.3, with its derivatives; means of observations."""
    names = ["value", "by_mean", "by_variance", "gamma_mean"]

    def run(x):
        var = np.full(len(x), 0.3)
        return np.stack([*L.Gaussian(0.2).expectations(x[:, 1], x[:, 0], var), L.Gamma(-0.5).predictive_mean(x[:, 0], var)], 1)

    return _values(_parts(spark, sf_dir), ["x", "y"], names, run)


def probit_probabilities(spark, sf_dir):
    """Probabilities of a positive, of a member of the one class, and of three levels, at a latent value of x."""
    names = ["bernoulli", "one_class", "predictive", "level_0", "level_1", "level_2"]

    def run(x):
        f = x[:, 0]
        one, three = np.ones_like(f), L.Ordered([0.6, 1.4], 0.5)
        return np.stack([np.exp(L.Bernoulli(0.2, 1.5).log_density(one, f)), np.exp(L.Bernoulli.one_class(2.0).log_density(one, f)), L.Bernoulli(0.2, 1.5).predictive_mean(f, 0.4 * one), *three.probabilities(f).T], 1)

    return _values(_parts(spark, sf_dir), ["x"], names, run)


def mixture_responsibilities(spark, sf_dir):
    names = ["narrow", "wide"]
    return _values(_parts(spark, sf_dir), ["x", "y"], names, lambda x: L.Mixture([0.1, 0.6], [3, 1]).responsibilities(x[:, 0], np.full(len(x), 0.05), x[:, 1]))


def label_indicators(spark, sf_dir):
    """Entropy and log odds against the best rival of three shares."""
    names = ["entropy", "first", "second", "third"]

    def run(x):
        p = np.stack([x[:, 0], x[:, 1], np.full(len(x), 0.5)], 1)
        p /= p.sum(1, keepdims=True)
        return np.concatenate([L.categorical_entropy(p)[:, None], L.indicators(p)], 1)

    return _values(_parts(spark, sf_dir), ["x", "y"], names, run)


def latent_nodes(spark, sf_dir):
    """Moments of nodes over two inputs: means x and y, variances x / 10 and y / 20."""
    ways = ["linear", "combination", "experts", "exponential", "multiplied", "added", "shifted", "scaled", "selected", "stacked"]
    names = [f"{w}_{m}" for w in ways for m in ("mean", "var")] + ["trend"]

    def run(x):
        a, b = V.Input([0], [2]), V.Input([1], [3])
        both = V.Stack(a, b)
        nodes = [
            V.Linear(both, np.array([[3.0], [4.0]])), V.LinearCombination(a, b, shares=[1, 3]), V.ProductOfExperts(a, b), V.Exponentiation(b), V.Multiply(a, b), V.Add(a, b), V.Bias(a, 2.0),
            V.Scale(b, 3.0), V.Select(both, [1]), V.Add(V.Select(V.Stack(both, a), [2]), b),
        ]
        return np.concatenate([m for n in nodes for m in n.moments(x)] + [V.RadialTrend(np.array([0.5, 1.0]), 0.6).moments(x[:, :2])[0]], 1)

    rows = _parts(spark, sf_dir).withColumns({"vx": F.col("x") / 10, "vy": F.col("y") / 20})
    return _values(rows, ["x", "y", "vx", "vy"], names, run)


def walk(spark, sf_dir):
    """Positions after three steps through a field that pulls them to 0 (the field is minus the position)."""

    def run(x):
        node = V.Walk(V.Scale(V.Input([0]), -1.0), V.Input([0]), 0.1, 3)
        return np.concatenate([node.moments(x)[0], node.path(x)[1]], 1)

    return _values(_parts(spark, sf_dir), ["x"], ["end", "first_step"], run)


def parameter_maps(spark, sf_dir):
    """Bounded, positive, circular and simplex parameters, and columns of unit length, set to the data and read back."""
    names = ["bounded", "positive_free", "circular", "share", "share_free", "unit", "centred"]

    def run(x):
        shares = [Simplex(np.array([a, b, 1.0])) for a, b in x]
        free = np.array([s.free()[0] for s in shares])
        for s, z in zip(shares, free):
            s.set_free(s.free())
        columns = np.stack([x[:, 0], x[:, 1], np.ones(len(x))])
        return np.stack([Parameter(x[:, 0], 0.3, 1.1).value, Positive(x[:, 0]).free(), Circular(x[:, 0] * 7, 1.0, 3.0).value, [s.value[1] for s in shares], free, UnitColumns(columns).value[0], UnitColumns(columns, centred=True).value[1]], 1)

    return _values(_parts(spark, sf_dir), ["x", "y"], names, run)


def warping_values(spark, sf_dir):
    """Forward values and log determinants, and what comes back from them."""
    names = [f"{w}_{k}" for w in ("zscore", "log", "softplus", "sigmoid", "scale", "chained") for k in ("z", "log_det", "back")]

    def run(x):
        out = []
        for w, v in ((W.ZScore(1.0, 0.5), x[:, :1]), (W.Log(0.01), x[:, 1:]), (W.Softplus(0.01), x[:, 1:]), (W.Sigmoid(0.001), x[:, :1] / 2.5), (W.Scale(4.0), x[:, :1]), (W.Chained(W.Log(0.01), W.ZScore(0.2, 3.0)), x[:, 1:])):
            z, d = w.forward(v)
            out += [z, d[:, None], w.backward(z)]
        return np.concatenate(out, 1)

    return _values(_parts(spark, sf_dir), ["x", "y"], names, run)


def composition_warpings(spark, sf_dir):
    """Centred log ratios of three shares and parts over given means, with a way back that needs drawing in."""
    names = ["clr", "clr_log_det", "clr_back", "scaled", "drawn_a", "drawn_b", "drawn_c"]

    def run(x):
        p = np.stack([x[:, 0], x[:, 1], np.full(len(x), 0.5)], 1)
        p /= p.sum(1, keepdims=True)
        clr, simplex = W.CenteredLogRatio(), W.ScaledSimplex()
        simplex.mean = np.array([0.5, 0.3, 0.2])
        z, d = clr.forward(p)
        return np.concatenate([z[:, :1], d[:, None], clr.backward(z)[:, 1:2], simplex.forward(p)[0][:, :1], simplex.backward(np.stack([4 * x[:, 0] - 2, x[:, 1], np.full(len(x), -0.5)], 1))], 1)

    return _values(_parts(spark, sf_dir), ["x", "y"], names, run)


def _moments(df, name="prediction"):
    return _rounded(df.select("p_partkey", F.col(f"{name}.mean").alias("mean"), F.col(f"{name}.variance").alias("variance"), F.col(f"{name}.explained").alias("explained")), "mean", "variance", "explained")


GAUSS = K.Covariance("gaussian", K.Isotropic(1.5))


def _two(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg((F.avg("l_quantity") / F.lit(25.0) + F.when(F.col("l_linestatus") == "F", 0.5).otherwise(0.0)).alias("x"), (F.avg("l_discount") * 20 + F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("y"))


def exact_process(spark, sf_dir):
    """Predictions at all parts from a process of two points, the means of lineitem's two states."""
    return _moments(GP(["x"], "y", GAUSS, noise=0.1).fit(_two(spark, sf_dir)).predict(_parts(spark, sf_dir).drop("y")))


def exact_likelihood(spark, sf_dir):
    value = GP(["x"], "y", GAUSS, noise=0.1).fit(_two(spark, sf_dir)).log_likelihood()
    return _rounded(spark.range(1).select(F.lit(value).alias("log_likelihood")), "log_likelihood")


INDUCING = np.array([[0.4], [1.6]])


def sparse_statistics(spark, sf_dir):
    """Sums over all parts that a sparse process needs."""
    kk, ky, y, yy, n, trace = SparseGP(["x"], "y", INDUCING, GAUSS).statistics(_parts(spark, sf_dir))
    rows = [("k1k1", kk[0, 0]), ("k1k2", kk[0, 1]), ("k2k2", kk[1, 1]), ("k1y", ky[0]), ("k2y", ky[1]), ("y", y), ("yy", yy), ("n", n), ("trace", trace)]
    return _rounded(spark.createDataFrame([(k, float(v)) for k, v in rows], "name string, value double"), "value")


def sparse_process(spark, sf_dir):
    """Predictions at all parts of a sparse process fitted to all parts."""
    p = _parts(spark, sf_dir)
    return _moments(SparseGP(["x"], "y", INDUCING, GAUSS, 0.5).fit(p).predict(p.drop("y")))


def variational_process(spark, sf_dir):
    """One full natural-gradient step under Gaussian noise lands where the sparse process is."""
    p = _parts(spark, sf_dir)
    return _moments(V.VariationalGP(["x"], "y", INDUCING, L.Gaussian(0.5), GAUSS).fit(p, 1).predict(p.drop("y")))


def variational_divergence(spark, sf_dir):
    model = V.VariationalGP(["x"], "y", INDUCING, L.Gaussian(0.5), GAUSS).fit(_parts(spark, sf_dir), 1)
    return _rounded(spark.range(1).select(F.lit(model.divergence()).alias("divergence")), "divergence")


def latent_network(spark, sf_dir):
    """A network of a sparse process, scaled and shifted, as a model over all parts."""
    p = _parts(spark, sf_dir)
    node = V.Bias(V.Scale(V.Process(SparseGP(["x"], "y", INDUCING, GAUSS, 0.5).fit(p)), 2.0), -1.0)
    return _rounded(V.Network(["x"], node).predict(p.drop("y")).select("p_partkey", F.col("prediction.mean").alias("mean"), F.col("prediction.variance").alias("variance")), "mean", "variance")


def process_ensemble(spark, sf_dir):
    """Two sparse processes of different noise as one, weighted by what each explains."""
    p = _parts(spark, sf_dir)
    members = [SparseGP(["x"], "y", INDUCING, GAUSS, s).fit(p) for s in (0.5, 40.0)]
    return _rounded(combine(members, p.select("p_partkey", "x")).select("p_partkey", "mean", "variance"), "mean", "variance")


def cross_validation(spark, sf_dir):
    """Out-of-fold predictions of a sparse process; the folds are price bands."""
    p = _parts(spark, sf_dir).withColumn("fold", (F.col("x") > 1).cast("int"))
    out = cross_validate(p, "fold", lambda d: SparseGP(["x"], "y", INDUCING, GAUSS, 0.5).fit(d), 0)
    return _moments(out)


def structural_field(spark, sf_dir):
    """The field of one normal at 0.5 along x, at all parts."""
    one = spark.createDataFrame([(0.5, 1.0)], "x double, dx double")
    model = StructuralField(["x"], GAUSS).fit_directions(one.where("false"), one, ["dx"])
    return _rounded(model.predict(_parts(spark, sf_dir).drop("y")).select("p_partkey", F.col("prediction.mean").alias("mean")), "mean")


COVERAGES = [0.2, 0.5, 0.8, 0.95]


def conformal_levels(spark, sf_dir):
    """Calibrated levels from all parts' PIT values (x / 2.1)."""
    got = M.conformal_nominal(_parts(spark, sf_dir).withColumn("pit", F.col("x") / 2.1), "pit", COVERAGES)
    return _rounded(spark.createDataFrame(sorted(got.items()), "coverage double, level double"), "level")


def conformal_bounds(spark, sf_dir):
    """Central intervals of all embeddings, read as realizations, at a calibrated level of 0.6."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("s"))
    return _rounded(M.conformal_interval(e, "s", 0.6).select("vec_id", "lower", "upper"), "lower", "upper")


def _r(columns: dict[str, str]) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


def _select(columns: dict[str, str], source: str = "p", extra: str = "") -> str:
    return f"WITH {SQL_PARTS}{extra} SELECT p_partkey, {_r(columns)} FROM {source}"


_G = "exp(-3 * pow(({}) / 1.5, 2))"
_D1 = {
    "gaussian": ("6 * s * exp(-3 * h * h)", "(6 - 36 * h * h) * exp(-3 * h * h)"),
    "matern32": ("25 * s * exp(-5 * h)", "(25 - 125 * h) * exp(-5 * h)"),
    "matern52": ("(12 + 72 * h) * s * exp(-6 * h)", "(12 + 72 * h - 432 * h * h) * exp(-6 * h)"),
    "cubic": ("CASE WHEN h < 1 THEN s * (14 - 26.25 * h + 17.5 * pow(h, 3) - 5.25 * pow(h, 5)) ELSE 0 END", "CASE WHEN h < 1 THEN 14 - 52.5 * h + 70 * pow(h, 3) - 31.5 * pow(h, 5) ELSE 0 END"),
}
_CDF = "(0.5 + (SELECT sum(CASE WHEN i IN (0, 200) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(({0}) * i / 200.0, 2) / 2)) FROM range(0, 201) t(i)) * ({0}) / 600 / sqrt(2 * pi()))"
#: Sums over parts, the 2 x 2 algebra of a sparse process with noise s2, and predictions; {where} and {by} split folds.
_SPARSE = """,
k AS (SELECT *, exp(-3 * pow((x - 0.4) / 1.5, 2)) AS k1, exp(-3 * pow((x - 1.6) / 1.5, 2)) AS k2, (x > 1)::INT AS fold FROM p),
su AS (SELECT f.fold, sum(k1 * k1) AS a, sum(k1 * k2) AS b, sum(k2 * k2) AS c, sum(k1 * y) AS u, sum(k2 * y) AS v FROM k JOIN (SELECT unnest({folds}) AS fold) f ON {where} GROUP BY f.fold),
no AS (SELECT unnest({noises}) AS s2),
al AS (SELECT su.*, s2, 1 + 1e-6 AS q, exp(-3 * pow(1.2 / 1.5, 2)) AS o FROM su, no),
be AS (SELECT *, q * q - o * o AS dq, (q + a / s2) * (q + c / s2) - pow(o + b / s2, 2) AS ds FROM al),
mm AS (SELECT *, ((q + c / s2) * u - (o + b / s2) * v) / ds / s2 AS w1, ((q + a / s2) * v - (o + b / s2) * u) / ds / s2 AS w2,
  q / dq - (q + c / s2) / ds AS m11, -o / dq + (o + b / s2) / ds AS m12, q / dq - (q + a / s2) / ds AS m22 FROM be),
pr AS (SELECT p_partkey, x, y, s2, k1 * w1 + k2 * w2 AS mean, 1 - (k1 * k1 * m11 + 2 * k1 * k2 * m12 + k2 * k2 * m22) AS variance FROM k JOIN mm ON {match})"""


def _sparse(noises="[0.5]", folds="[-1]", where="TRUE", match="TRUE") -> str:
    return _SPARSE.replace("{noises}", noises).replace("{folds}", folds).replace("{where}", where).replace("{match}", match)


_PREDICTED = {"mean": "mean", "variance": "greatest(variance, 0)", "explained": "1 - greatest(variance, 0)"}
_TWO = """,
t AS (SELECT avg(l_quantity) / 25.0 + CASE WHEN l_linestatus = 'F' THEN 0.5 ELSE 0 END AS x, avg(l_discount) * 20 + CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END AS y, l_linestatus AS s FROM lineitem GROUP BY l_linestatus),
d AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, 1.1 + 1e-9 AS q, exp(-3 * pow((a.x - b.x) / 1.5, 2)) AS o FROM t a JOIN t b ON a.s = 'F' AND b.s = 'O'),
e AS (SELECT *, q * q - o * o AS det FROM d)"""
_SHARES = ", s AS (SELECT p_partkey, x, y, x / (x + y + 0.5) AS a, y / (x + y + 0.5) AS b, 0.5 / (x + y + 0.5) AS c FROM p)"
_DRAW = _SHARES + """, v AS (SELECT p_partkey, (4 * x - 2) * 0.5 AS va, y * 0.3 AS vb, -0.1 AS vc FROM p), w AS (SELECT p_partkey, va + (1 - va - vb - vc) * 0.5 AS va, vb + (1 - va - vb - vc) * 0.3 AS vb, vc + (1 - va - vb - vc) * 0.2 AS vc FROM v),
n AS (SELECT *, greatest(CASE WHEN va < 0 THEN -va / (0.5 - va) ELSE 0 END, CASE WHEN vb < 0 THEN -vb / (0.3 - vb) ELSE 0 END, CASE WHEN vc < 0 THEN -vc / (0.2 - vc) ELSE 0 END) AS t FROM w)"""

SQL = {
    "kernel_profiles": _select({
        "gaussian": "exp(-3 * d * d)", "cubic": "CASE WHEN d < 1 THEN 1 - 7 * d * d + 8.75 * pow(d, 3) - 3.5 * pow(d, 5) + 0.75 * pow(d, 7) ELSE 0 END", "matern32": "(1 + 5 * d) * exp(-5 * d)", "matern52": "(1 + 6 * d + 12 * d * d) * exp(-6 * d)",
        "spherical": "CASE WHEN d < 1 THEN 1 - 1.5 * d + 0.5 * pow(d, 3) ELSE 0 END", "exponential": "exp(-3 * d)", "constant": "1.0::DOUBLE", "cosine": "cos(2 * pi() * d)", "rational": "pow(1 + 1.5 * d * d, -2)",
    }, "q", ", q AS (SELECT *, x / 1.5 AS d FROM p)"),
    "kernel_derivatives": _select({f"{k}_{n}": f"({v}) / {r}" for k, two in _D1.items() for n, v, r in zip(("d1", "d2"), two, ("1.5", "2.25"))}, "q", ", q AS (SELECT *, (x - 0.3) / 1.5 AS s, abs(x - 0.3) / 1.5 AS h FROM p)"),
    "kernel_algebra": _select({
        "summed": "0.75 * g + 0.25 * exp(-1.5 * h)", "product": "g * exp(-1.5 * h)", "scaled": "2.5 * g", "dot": "(0.5 * x + y) / 4", "additive": "(exp(-3 * pow(dx / 1.5, 2)) + exp(-3 * pow(dy / 0.7, 2))) / 2",
        "nested": "(exp(-3 * pow(h / 2, 2)) + 0.5 * exp(-3 * pow(h / 0.5, 2))) / 1.5",
        "projected": "(exp(-3 * pow(dx / 1.2, 2)) + exp(-3 * pow((dx + dy) / sqrt(2) / 1.2, 2)) + exp(-3 * pow(dy / 1.2, 2)) + exp(-3 * pow((dy - dx) / sqrt(2) / 1.2, 2))) / 4",
        "product_d1": "(6 * g / 2.25 * (1 + 2.5 * h) * exp(-2.5 * h) + g * 25 * exp(-2.5 * h) / 4) * (0.6 * dx + 0.8 * dy)", "diagonal": "3 * (x * x + y * y) / 4",
    }, "q", ", r AS (SELECT *, x - 0.5 AS dx, y - 1.0 AS dy, sqrt(pow(x - 0.5, 2) + pow(y - 1.0, 2)) AS h FROM p), q AS (SELECT *, exp(-3 * pow(h / 1.5, 2)) AS g FROM r)"),
    "kernel_transforms": _select({
        "ard": "exp(-3 * (pow(dx / 1.5, 2) + pow(dy / 0.5, 2)))", "ellipse": "exp(-3 * (pow((dx * 0.5 + dy * sqrt(0.75)) / 2, 2) + pow((dx * sqrt(0.75) - dy * 0.5) / 0.8, 2)))", "projection": "exp(-3 * pow((0.6 * dx + 0.8 * dy) / 0.8, 2))",
        "selected": "exp(-3 * pow(dy / 0.6, 2))", "periodic": "exp(-3 * (4 - 2 * cos(2 * pi() * dx) - 2 * cos(2 * pi() * dy)) / 4)",
        "uncertain": "sqrt(0.375 / v1) * exp(-dx * dx / (2 * v1)) * sqrt(0.135 / v2) * exp(-dy * dy / (2 * v2))",
    }, "q", ", q AS (SELECT *, x - 0.5 AS dx, y - 1.0 AS dy, 0.375 + 0.1 + 0.05 * x + 0.02 AS v1, 0.135 + 0.1 + 0.05 * y + 0.03 AS v2 FROM p)"),
    "likelihood_densities": _select({
        "gaussian": "-0.5 * ln(2 * pi() * 0.2) - pow(y - x, 2) / 0.4", "laplace": "-ln(0.6) - abs(y - x) / 0.3", "student": "ln(1.329340388179137) - 0.5 * ln(4 * pi()) - ln(0.3) - 2.5 * ln(1 + pow((y - x) / 0.3, 2) / 4)",
        "flat": "-greatest(abs(y - x) / 0.3 - 0.5, 0) - ln(0.9)", "huber": f"-CASE WHEN u <= 1 THEN u * u / 2 ELSE u - 0.5 END - ln(0.3 * (sqrt(2 * pi()) * (2 * {_CDF.format('1.0')} - 1) + 2 * exp(-0.5)))",
        "mixture": "ln(0.75 / (0.1 * sqrt(2 * pi())) * exp(-pow((y - x) / 0.1, 2) / 2) + 0.25 / (0.6 * sqrt(2 * pi())) * exp(-pow((y - x) / 0.6, 2) / 2))",
        "gamma": "(exp(x + 0.5) + 0.01 - 1) * ln(y) - y - lgamma(exp(x + 0.5) + 0.01)",
    }, "q", ", q AS (SELECT *, abs(y - x) / 0.3 AS u FROM p)"),
    "likelihood_expectations": _select({"value": "-0.5 * ln(2 * pi() * 0.2) - (pow(y - x, 2) + 0.3) / 0.4", "by_mean": "(y - x) / 0.2", "by_variance": "-2.5::DOUBLE", "gamma_mean": "exp(x - 0.5 + 0.15) + 0.01"}),
    "probit_probabilities": _select({
        "bernoulli": _CDF.format("1.5 * x + 0.2"), "one_class": _CDF.format("2 * x - 3"), "predictive": _CDF.format("(1.5 * x + 0.2) / sqrt(1.9)"),
        "level_0": _CDF.format("(0.6 - x) / 0.5"), "level_1": _CDF.format("(1.4 - x) / 0.5") + " - " + _CDF.format("(0.6 - x) / 0.5"), "level_2": "1 - " + _CDF.format("(1.4 - x) / 0.5"),
    }),
    "mixture_responsibilities": _select({"narrow": "a / (a + b)", "wide": "b / (a + b)"}, "q", ", q AS (SELECT *, 0.75 / sqrt(0.06) * exp(-pow(y - x, 2) / 0.12) AS a, 0.25 / sqrt(0.41) * exp(-pow(y - x, 2) / 0.82) AS b FROM p)"),
    "label_indicators": _select({"entropy": "-(a * ln(a) + b * ln(b) + c * ln(c)) / ln(3)", **{n: f"ln({v}) - CASE WHEN {v} = greatest(a, b, c) THEN ln(a + b + c - greatest(a, b, c) - least(a, b, c)) ELSE ln(greatest(a, b, c)) END" for n, v in zip(("first", "second", "third"), "abc")}}, "s", _SHARES),
    "latent_nodes": _select({
        "linear_mean": "0.6 * x + 0.8 * y", "linear_var": "0.36 * vx + 0.64 * vy", "combination_mean": "0.5 * x + sqrt(0.75) * y", "combination_var": "0.25 * vx + 0.75 * vy",
        "experts_mean": "(wx * x + wy * y) / (wx + wy)", "experts_var": "(wx * vx + wy * vy) / (wx + wy)", "exponential_mean": "exp(y + vy / 2)", "exponential_var": "(exp(vy) - 1) * exp(2 * y + vy)",
        "multiplied_mean": "x * y", "multiplied_var": "vx * vy + vx * y * y + vy * x * x", "added_mean": "x + y", "added_var": "vx + vy", "shifted_mean": "x + 2", "shifted_var": "vx", "scaled_mean": "3 * y", "scaled_var": "9 * vy",
        "selected_mean": "y", "selected_var": "vy", "stacked_mean": "x + y", "stacked_var": "vx + vy", "trend": "CASE WHEN r < 1 THEN 1 - r * r WHEN r < 2 THEN r * r - 4 * r + 3 ELSE -1.0 END",
    }, "q", ", o AS (SELECT *, x / 10 AS vx, y / 20 AS vy, sqrt(pow(x - 0.5, 2) + pow(y - 1, 2)) / 0.6 AS r FROM p), q AS (SELECT *, greatest(0, least(1, 1 - vx)) / (vx + 1e-6) + 1e-6 AS wx, greatest(0, least(1, 1 - vy)) / (vy + 1e-6) + 1e-6 AS wy FROM o)"),
    "walk": _select({"end": "x * pow(0.9, 3)", "first_step": "x * 0.9"}),
    "parameter_maps": _select({
        "bounded": "least(1.1, greatest(0.3, x))", "positive_free": "ln(x)", "circular": "1 + (x * 7 - 1) - 2 * floor((x * 7 - 1) / 2)", "share": "y / (x + y + 1)", "share_free": "ln(x) - (ln(x) + ln(y)) / 3",
        "unit": "x / sqrt(x * x + y * y + 1)", "centred": "(y - m) / sqrt(pow(x - m, 2) + pow(y - m, 2) + pow(1 - m, 2))",
    }, "q", ", q AS (SELECT *, (x + y + 1) / 3 AS m FROM p)"),
    "warping_values": _select({
        "zscore_z": "(x - 1) / 0.5", "zscore_log_det": "-ln(0.5::DOUBLE)", "zscore_back": "x", "log_z": "ln(y + 0.01)", "log_log_det": "-ln(y + 0.01)", "log_back": "y", "softplus_z": "ln(exp(y + 0.01) - 1)", "softplus_log_det": "-ln(1 - exp(-(y + 0.01)))", "softplus_back": "y",
        "sigmoid_z": "ln(s / (1 - s))", "sigmoid_log_det": "ln(0.998) - ln(s * (1 - s))", "sigmoid_back": "x / 2.5", "scale_z": "x / 4", "scale_log_det": "-ln(4.0::DOUBLE)", "scale_back": "x",
        "chained_z": "(ln(y + 0.01) - 0.2) / 3", "chained_log_det": "-ln(y + 0.01) - ln(3.0::DOUBLE)", "chained_back": "y",
    }, "q", ", q AS (SELECT *, x / 2.5 * 0.998 + 0.001 AS s FROM p)"),
    "composition_warpings": _select({
        "clr": "ln(a) - (ln(a) + ln(b) + ln(c)) / 3", "clr_log_det": "-(ln(a) + ln(b) + ln(c))", "clr_back": "b", "scaled": "a / 0.5",
        "drawn_a": "greatest(0, va + t * (0.5 - va))", "drawn_b": "greatest(0, vb + t * (0.3 - vb))", "drawn_c": "greatest(0, vc + t * (0.2 - vc))",
    }, "s JOIN n USING (p_partkey)", _DRAW),
    "exact_process": _select({"mean": "(k1 * (q * y1 - o * y2) + k2 * (q * y2 - o * y1)) / det", "variance": "greatest(1 - g, 0)", "explained": "g"}, "h", _TWO + """,
        f AS (SELECT p.p_partkey, e.*, exp(-3 * pow((p.x - x1) / 1.5, 2)) AS k1, exp(-3 * pow((p.x - x2) / 1.5, 2)) AS k2 FROM p, e), h AS (SELECT *, (q * k1 * k1 - 2 * o * k1 * k2 + q * k2 * k2) / det AS g FROM f)"""),
    "exact_likelihood": f"WITH {SQL_PARTS}{_TWO} SELECT round(-0.5 * (q * y1 * y1 - 2 * o * y1 * y2 + q * y2 * y2) / det - 0.5 * ln(det) - ln(2 * pi()), 6) AS log_likelihood FROM e",
    "sparse_statistics": f"""WITH {SQL_PARTS}, k AS (SELECT *, {_G.format('x - 0.4')} AS k1, {_G.format('x - 1.6')} AS k2 FROM p),
        s AS (SELECT sum(k1 * k1) AS k1k1, sum(k1 * k2) AS k1k2, sum(k2 * k2) AS k2k2, sum(k1 * y) AS k1y, sum(k2 * y) AS k2y, sum(y) AS y, sum(y * y) AS yy, count(*)::DOUBLE AS n, count(*)::DOUBLE AS trace FROM k)
        SELECT name, round(value, 6) AS value FROM (UNPIVOT s ON k1k1, k1k2, k2k2, k1y, k2y, y, yy, n, trace INTO NAME name VALUE value)""",
    "sparse_process": _select(_PREDICTED, "pr", _sparse()),
    "variational_process": _select(_PREDICTED, "pr", _sparse()),
    "variational_divergence": f"""WITH {SQL_PARTS}{_sparse()}, l AS (SELECT *, (q * (q + c / s2) - 2 * o * (o + b / s2) + q * (q + a / s2)) / ds AS tr, q * w1 * w1 + 2 * o * w1 * w2 + q * w2 * w2 AS mm FROM mm)
        SELECT round(0.5 * (tr + mm - 2 + ln(ds / dq)), 6) AS divergence FROM l""",
    "latent_network": _select({"mean": "2 * mean - 1", "variance": "4 * greatest(variance, 0)"}, "pr", _sparse()),
    "process_ensemble": f"""WITH {SQL_PARTS}{_sparse(noises='[0.5, 40.0]')}, w AS (SELECT *, (1 - variance) / sum(1 - variance) OVER (PARTITION BY p_partkey) AS w FROM pr)
        SELECT p_partkey, round(sum(w * mean), 6) AS mean, round(sum(w * w * variance), 6) AS variance FROM w GROUP BY p_partkey""",
    "cross_validation": _select(_PREDICTED, "pr", _sparse(folds="[0, 1]", where="k.fold <> f.fold", match="k.fold = mm.fold")),
    "structural_field": _select({"mean": "6 * (x - 0.5) / 2.25 * exp(-3 * pow((x - 0.5) / 1.5, 2)) / (6 / 2.25 + 1e-4)"}),
    "conformal_levels": f"""WITH {SQL_PARTS}, s AS (SELECT abs(x / 2.1 - 0.5) AS s, row_number() OVER (ORDER BY abs(x / 2.1 - 0.5)) AS k, count(*) OVER () AS n FROM p), c AS (SELECT unnest([0.2, 0.5, 0.8, 0.95])::DOUBLE AS coverage)
        SELECT coverage, round(least(1, 2 * s), 6) AS level FROM c JOIN s ON k = ceil((n + 1) * coverage - 1e-12)""",
    "conformal_bounds": "SELECT vec_id, round(quantile_cont(v, 0.2), 6) AS lower, round(quantile_cont(v, 0.8), 6) AS upper FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY vec_id",
}
SQL = {k: v.replace("round(", "round(3e-10 + ") for k, v in SQL.items()}

QUERIES = {
    f.__name__: f
    for f in (
        kernel_profiles, kernel_derivatives, kernel_algebra, kernel_transforms, likelihood_densities, likelihood_expectations, probit_probabilities, mixture_responsibilities, label_indicators, latent_nodes, walk,
        parameter_maps, warping_values, composition_warpings, exact_process, exact_likelihood, sparse_statistics, sparse_process, variational_process, variational_divergence, latent_network, process_ensemble,
        cross_validation, structural_field, conformal_levels, conformal_bounds,
    )
}
