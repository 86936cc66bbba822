"""Exact and sparse Gaussian-process regression over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lithic.models.kernels import Covariance, Kernel
from lithic.models.warpings import Warping

JITTER = 1e-9
#: Points that an exact model is fitted to, at most: its cost is their cube. Beyond, use SparseGP.
EXACT_POINTS = 5_000
#: Rows that a prediction holds covariances of at once.
PREDICTED = 2_048


def minimize(f: Callable[[np.ndarray], float], x: np.ndarray, iterations: int = 200, size: float = 0.3) -> np.ndarray:
    """Downhill simplex, without derivatives."""
    n = len(x)
    pts = [x.copy()] + [x + size * np.eye(n)[i] for i in range(n)]
    val = [f(p) for p in pts]
    for _ in range(iterations):
        order = np.argsort(val)
        pts, val = [pts[i] for i in order], [val[i] for i in order]
        if abs(val[-1] - val[0]) < 1e-9 * (1 + abs(val[0])):
            break
        mid = np.mean(pts[:-1], axis=0)
        r = mid + (mid - pts[-1])
        fr = f(r)
        if fr < val[0]:
            e = mid + 2 * (mid - pts[-1])
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = mid + 0.5 * (pts[-1] - mid)
            fc = f(c)
            if fc < val[-1]:
                pts[-1], val[-1] = c, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [f(p) for p in pts[1:]]
    return pts[int(np.argmin(val))]


class _Predictor:
    """Prediction of a fitted model on every row of a DataFrame, in parallel."""

    coordinates: list[str]

    def raw(self, x: np.ndarray, n_sim: int, normals: np.ndarray) -> dict[str, np.ndarray]:
        raise NotImplementedError

    def predict(self, df: DataFrame, n_sim: int = 0, name: str = "prediction", seed: int = 1) -> DataFrame:
        """`df` with a struct `name`: mean, variance, explained (share of prior variance) and sims.

        Realization j uses one normal draw for all rows, so the result does not depend on batches or
        partitions. The posterior is broadcast; its size is set by the number of (inducing) points.
        """
        spark = df.sparkSession
        normals = np.random.default_rng(seed).standard_normal(n_sim)
        model = spark.sparkContext.broadcast((self, normals))
        out = T.StructType([*df.schema.fields, T.StructField(name, T.StructType([T.StructField("mean", T.DoubleType()), T.StructField("variance", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("sims", T.ArrayType(T.DoubleType()))]))])
        columns = self.coordinates

        def run(batches):
            own, z = model.value
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
                parts = [own.raw(x[at : at + PREDICTED], len(z), z) for at in range(0, max(len(x), 1), PREDICTED)]
                got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
                sims = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(z), pa.int32()), pa.array(got["sims"].ravel()))
                block = pa.StructArray.from_arrays([pa.array(got["mean"]), pa.array(got["variance"]), pa.array(got["explained"]), sims], ["mean", "variance", "explained", "sims"])
                yield pa.RecordBatch.from_arrays([*b.columns, block], [*b.schema.names, name])

        return df.mapInArrow(run, out)


class GP(_Predictor):
    """Gaussian-process regression of one variable, with a nugget, an optional linear trend, an optional
    warping, and optional directional data whose derivative along a direction is 0."""

    def __init__(self, coordinates: list[str], value: str, covariance: Kernel | None = None, warping: Warping | None = None, noise: float = 0.01, trend: bool = False, interpolation: bool = False):
        self.coordinates, self.value = list(coordinates), value
        self.covariance, self.warping, self.trend = covariance or Covariance(), warping or Warping(), trend
        self.noise = 0.0 if interpolation else noise
        self.amplitude = 1.0

    def fit(self, df: DataFrame, directional: DataFrame | None = None, directions: list[str] | None = None) -> GP:
        rows = df.select(*self.coordinates, self.value).dropna().limit(EXACT_POINTS + 1).toPandas().to_numpy(float)
        if len(rows) > EXACT_POINTS:
            raise ValueError(f"over {EXACT_POINTS} points; use SparseGP")
        self.x, y = rows[:, :-1], rows[:, -1:]
        self.warping.initialize(y)
        z, self._jacobian = self.warping.forward(y)
        self.y = z[:, 0]
        self.dx = self.dd = None
        if directional is not None:
            d = directional.select(*self.coordinates, *directions).toPandas().to_numpy(float)
            self.dx, self.dd = d[:, : len(self.coordinates)], d[:, len(self.coordinates) :]
        return self.refresh()

    def _basis(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), x], 1) if self.trend else np.zeros((len(x), 0))

    def _cross(self, x: np.ndarray) -> np.ndarray:
        k = self.covariance(x, self.x)
        if self.dx is not None:
            k = np.concatenate([k, self.covariance.d1(x, self.dx, self.dd)], 1)
        return self.amplitude * k

    def refresh(self) -> GP:
        """Cholesky factor, weights and trend coefficients."""
        n = len(self.x)
        k = self.covariance(self.x, self.x) + np.eye(n) * (self.noise + JITTER)
        y, h = self.y, self._basis(self.x)
        if self.dx is not None:
            c, d = self.covariance.d1(self.x, self.dx, self.dd), self.covariance.d2(self.dx, self.dx, self.dd, self.dd)
            k = np.block([[k, c], [c.T, d + np.eye(len(self.dx)) * 1e-6]])
            y = np.concatenate([y, np.zeros(len(self.dx))])
            h = np.concatenate([h, np.concatenate([np.zeros((len(self.dx), 1)), self.dd], 1) if self.trend else np.zeros((len(self.dx), 0))])
        self.chol = np.linalg.cholesky(self.amplitude * k)
        solve = lambda b: np.linalg.solve(self.chol.T, np.linalg.solve(self.chol, b))
        self.solved_h = solve(h)
        self.gram = np.linalg.inv(h.T @ self.solved_h) if h.shape[1] else np.zeros((0, 0))
        self.beta = self.gram @ (self.solved_h.T @ y)
        self.alpha = solve(y - h @ self.beta)
        self.inverse = np.linalg.inv(self.chol)
        self._residual = y - h @ self.beta
        return self

    def log_likelihood(self) -> float:
        """Marginal likelihood of the data, with the warping's Jacobian."""
        n = len(self._residual)
        return float(-0.5 * self._residual @ self.alpha - np.log(np.diag(self.chol)).sum() - 0.5 * n * np.log(2 * np.pi) + np.sum(self._jacobian))

    def train(self, make: Callable[[np.ndarray], Kernel], start, iterations: int = 150) -> GP:
        """Maximize the likelihood over log parameters: those of `make(parameters)`, then noise and amplitude."""
        start = np.log(np.concatenate([np.atleast_1d(start), [max(self.noise, 1e-6), self.amplitude]]))

        def loss(p):
            v = np.exp(np.clip(p, -20, 20))
            self.covariance, self.noise, self.amplitude = make(v[:-2]), v[-2], v[-1]
            try:
                return -self.refresh().log_likelihood()
            except np.linalg.LinAlgError:
                return 1e12

        best = minimize(loss, start, iterations)
        loss(best)
        return self

    def raw(self, x, n_sim, normals):
        if not len(x):
            return {"mean": np.zeros(0), "variance": np.zeros(0), "explained": np.zeros(0), "sims": np.zeros((0, n_sim))}
        k, h = self._cross(x), self._basis(x)
        mean = k @ self.alpha + h @ self.beta
        v = self.inverse @ k.T
        prior = self.amplitude * self.covariance.diagonal(x)
        explained = (v**2).sum(0)
        r = h - k @ self.solved_h
        var = np.maximum(prior - explained + ((r @ self.gram) * r).sum(1), 0.0)
        sims = self.warping.backward((mean[:, None] + np.sqrt(var)[:, None] * normals)[..., None].reshape(-1, 1)).reshape(len(x), n_sim)
        return {"mean": self.warping.backward(mean[:, None])[:, 0], "variance": var, "explained": explained / np.maximum(prior, 1e-300), "sims": sims}


class SparseGP(_Predictor):
    """Variational sparse regression with inducing points and Gaussian noise.

    The collapsed bound needs sums over data of k k', k y, y y and the prior variance only. Executors
    add them up; one small matrix reaches the driver, however many rows there are.
    """

    def __init__(self, coordinates: list[str], value: str, inducing: np.ndarray, covariance: Kernel | None = None, noise: float = 0.1):
        self.coordinates, self.value = list(coordinates), value
        self.inducing, self.covariance, self.noise = np.asarray(inducing, float), covariance or Covariance(), noise
        self.amplitude = 1.0

    def statistics(self, df: DataFrame) -> tuple:
        m = len(self.inducing)
        sent = df.sparkSession.sparkContext.broadcast((self.covariance, self.inducing))
        columns, value = self.coordinates, self.value

        def run(batches):
            kernel, u = sent.value
            total = np.zeros(m * m + m + 4)
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
                y = b.column(value).to_numpy(zero_copy_only=False).astype(float)
                good = np.isfinite(x).all(1) & np.isfinite(y)
                for at in range(0, int(good.sum()), 4096):
                    xs, ys = x[good][at : at + 4096], y[good][at : at + 4096]
                    k = kernel(u, xs)
                    total += np.concatenate([(k @ k.T).ravel(), k @ ys, [ys.sum(), ys @ ys, len(ys), kernel.diagonal(xs).sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        parts = df.select(*columns, value).mapInArrow(run, "s binary")
        # Halve the rows on the executors until few are left, so that no single task or the driver adds up all of them.
        summed = parts.rdd.map(lambda r: np.frombuffer(r[0])).treeAggregate(np.zeros(m * m + m + 4), lambda a, b: a + b, lambda a, b: a + b, 2)
        return summed[: m * m].reshape(m, m), summed[m * m : m * m + m], *summed[-4:]

    def fit(self, df: DataFrame) -> SparseGP:
        self._stats = self.statistics(df)
        return self.refresh()

    def refresh(self) -> SparseGP:
        kk, ky, _, yy, n, trace = self._stats
        m, s2, a = len(self.inducing), self.noise, self.amplitude
        kuu = a * self.covariance(self.inducing, self.inducing) + np.eye(m) * 1e-6 * a
        self.luu = np.linalg.cholesky(kuu)
        half = np.linalg.solve(self.luu, a * kk * a)
        inner = np.linalg.solve(self.luu, half.T) / s2
        self.lb = np.linalg.cholesky(np.eye(m) + inner)
        self.first = np.linalg.inv(self.luu)
        self.second = np.linalg.inv(self.lb)
        self.c = np.linalg.solve(self.lb, np.linalg.solve(self.luu, a * ky)) / s2
        self.bound = float(
            -0.5 * n * np.log(2 * np.pi * s2) - np.log(np.diag(self.lb)).sum() - 0.5 * yy / s2 + 0.5 * s2 * (self.c @ self.c) / s2 - 0.5 / s2 * (a * trace - s2 * np.trace(inner))
        )
        return self

    def train_noise(self, iterations: int = 60) -> SparseGP:
        """Maximize the bound over noise and amplitude; the sums over data stay as they are."""

        def loss(p):
            self.noise, self.amplitude = np.exp(np.clip(p, -15, 15))
            try:
                return -self.refresh().bound
            except np.linalg.LinAlgError:
                return 1e12

        loss(minimize(loss, np.log([self.noise, self.amplitude]), iterations))
        return self

    def raw(self, x, n_sim, normals):
        if not len(x):
            return {"mean": np.zeros(0), "variance": np.zeros(0), "explained": np.zeros(0), "sims": np.zeros((0, n_sim))}
        k = self.first @ (self.amplitude * self.covariance(self.inducing, x))
        w = self.second @ k
        mean = w.T @ self.c
        prior = self.amplitude * self.covariance.diagonal(x)
        var = np.maximum(prior - (k**2).sum(0) + (w**2).sum(0), 0)
        sims = mean[:, None] + np.sqrt(var)[:, None] * normals
        return {"mean": mean, "variance": var, "explained": 1 - var / np.maximum(prior, 1e-300), "sims": sims}


def kmeans_inducing(df: DataFrame, columns: list[str], n: int, seed: int = 1) -> np.ndarray:
    """Centres of a distributed k-means as inducing points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="v").transform(df.dropna(subset=columns))
    return np.array(KMeans(k=n, seed=seed, featuresCol="v", maxIter=20).fit(v).clusterCenters())


def cross_validate(df: DataFrame, fold: str, fit: Callable[[DataFrame], _Predictor], n_sim: int = 20) -> DataFrame:
    """Out-of-fold predictions of every row, in a struct `prediction`."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    parts = [fit(df.where(df[fold] != f)).predict(df.where(df[fold] == f), n_sim) for f in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def combine(members: list[_Predictor], df: DataFrame) -> DataFrame:
    """An ensemble on every row: means weighted by explained variance, variances by its square."""
    from pyspark.sql import functions as F

    from lithic.operators.ensemble import combine_models

    names = [f"__m{i}" for i in range(len(members))]
    out = df
    for m, n in zip(members, names):
        out = m.predict(out, 0, n)
    flat = out.select(*df.columns, *(F.col(f"{n}.{f}").alias(f"{n}_{f}") for n in names for f in ("mean", "variance", "explained")))
    done = combine_models(flat, [f"{n}_mean" for n in names], [f"{n}_variance" for n in names], [f"{n}_explained" for n in names])
    return done.select(*df.columns, "mean", "variance")


class Classifier(_Predictor):
    """One indicator process per label; probabilities from the share of joint draws in which a label is the highest."""

    def __init__(self, coordinates: list[str], label: str, covariance: Kernel | None = None, noise: float = 0.05):
        self.coordinates, self.label, self.covariance, self.noise = list(coordinates), label, covariance or Covariance(), noise

    def fit(self, df: DataFrame) -> Classifier:
        from pyspark.sql import functions as F

        known = df.where(F.col(self.label).isNotNull())
        self.labels = sorted(r[0] for r in known.select(self.label).distinct().collect())
        self.members = [GP(self.coordinates, "__y", self.covariance, noise=self.noise, trend=False).fit(known.withColumn("__y", F.when(F.col(self.label) == v, 1.0).otherwise(-1.0))) for v in self.labels]
        return self

    def predict(self, df: DataFrame, n_sim: int = 256, name: str = "prediction", seed: int = 1) -> DataFrame:
        """`df` with a struct `name`: label, entropy (0 to 1) and probability (map by label)."""
        z = np.random.default_rng(seed).standard_normal((n_sim, len(self.labels)))
        sent = df.sparkSession.sparkContext.broadcast((self, z))
        out = T.StructType([*df.schema.fields, T.StructField(name, T.StructType([T.StructField("label", T.StringType()), T.StructField("entropy", T.DoubleType()), T.StructField("probability", T.ArrayType(T.DoubleType()))]))])

        def run(batches):
            own, normals = sent.value
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in own.coordinates], 1)
                got = [m.raw(x, 0, np.zeros(0)) for m in own.members]
                mean, std = np.stack([g["mean"] for g in got], 1), np.sqrt(np.stack([g["variance"] for g in got], 1))
                top = (mean[:, None] + std[:, None] * normals[None]).argmax(2)
                p = np.stack([(top == i).mean(1) for i in range(len(own.labels))], 1)
                h = -(p * np.log(np.maximum(p, 1e-300))).sum(1) / max(np.log(len(own.labels)), 1e-300)
                probs = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))
                block = pa.StructArray.from_arrays([pa.array([str(own.labels[i]) for i in p.argmax(1)], pa.string()), pa.array(h), probs], ["label", "entropy", "probability"])
                yield pa.RecordBatch.from_arrays([*b.columns, block], [*b.schema.names, name])

        return df.mapInArrow(run, out)


class StructuralField(GP):
    """A potential field from tangents (no change along them) and normals (unit change along them)."""

    def __init__(self, coordinates: list[str], covariance: Kernel | None = None):
        super().__init__(coordinates, "__none", covariance, noise=1e-4)

    def fit_directions(self, tangents: DataFrame, normals: DataFrame, directions: list[str]) -> StructuralField:
        t = tangents.select(*self.coordinates, *directions).toPandas().to_numpy(float)
        n = normals.select(*self.coordinates, *directions).toPandas().to_numpy(float)
        d = len(self.coordinates)
        self.dx, self.dd = np.concatenate([t[:, :d], n[:, :d]]), np.concatenate([t[:, d:], n[:, d:]])
        y = np.concatenate([np.zeros(len(t)), np.ones(len(n))])
        k = self.covariance.d2(self.dx, self.dx, self.dd, self.dd) + np.eye(len(y)) * self.noise
        self.chol = np.linalg.cholesky(k)
        self.inverse = np.linalg.inv(self.chol)
        self.alpha = self.inverse.T @ (self.inverse @ y)
        self.gram, self.beta, self.solved_h = np.zeros((0, 0)), np.zeros(0), np.zeros((len(y), 0))
        return self

    def _cross(self, x):
        return self.covariance.d1(x, self.dx, self.dd)
