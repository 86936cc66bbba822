"""Variational Gaussian processes with any likelihood, and latent networks of such nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lithic.models.gp import _Predictor
from lithic.models.kernels import Covariance, Kernel
from lithic.models.likelihoods import Gaussian, Likelihood


class VariationalGP(_Predictor):
    """A sparse process under a non-Gaussian likelihood, fitted by natural-gradient steps.

    A step turns every datum into a Gaussian site by the derivatives of its expected log density and
    adds the sites up on the executors: an m x m matrix and a vector come back, whatever the number
    of rows. With a Gaussian likelihood the first full step is the exact optimum.
    """

    def __init__(self, coordinates: list[str], value: str, inducing: np.ndarray, likelihood: Likelihood | None = None, covariance: Kernel | None = None, amplitude: float = 1.0):
        self.coordinates, self.value = list(coordinates), value
        self.inducing, self.likelihood = np.asarray(inducing, float), likelihood or Gaussian()
        self.covariance, self.amplitude = covariance or Covariance(), amplitude
        m = len(self.inducing)
        self.prior = amplitude * self.covariance(self.inducing, self.inducing) + np.eye(m) * 1e-6 * amplitude
        self.first = np.linalg.inv(self.prior)
        self.precision, self.shift = np.zeros((m, m)), np.zeros(m)
        self._posterior()

    def _posterior(self) -> None:
        self.spread = np.linalg.inv(self.first + self.precision)
        self.mean = self.spread @ self.shift

    def latent(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean, variance and projection of the latent at x."""
        a = self.amplitude * self.covariance(x, self.inducing) @ self.first
        var = self.amplitude * self.covariance.diagonal(x) - ((a @ self.prior) * a).sum(1) + ((a @ self.spread) * a).sum(1)
        return a @ self.mean, np.maximum(var, 1e-10), a

    def step(self, df: DataFrame, rate: float) -> float:
        """One natural-gradient step; returns the bound before it."""
        m = len(self.inducing)
        sent = df.sparkSession.sparkContext.broadcast(self)
        columns, value = self.coordinates, self.value

        def run(batches):
            model = sent.value
            total = np.zeros(m * m + m + 1)
            for b in batches:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1)
                y = b.column(value).to_numpy(zero_copy_only=False).astype(float)
                good = np.isfinite(x).all(1) & np.isfinite(y)
                for at in range(0, int(good.sum()), 2048):
                    xs, ys = x[good][at : at + 2048], y[good][at : at + 2048]
                    mean, var, a = model.latent(xs)
                    value_, by_mean, by_var = model.likelihood.expectations(ys, mean, var)
                    site = np.maximum(-2 * by_var, 1e-9)
                    total += np.concatenate([((a * site[:, None]).T @ a).ravel(), a.T @ (by_mean + site * mean), [value_.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

        parts = df.select(*columns, value).mapInArrow(run, "s binary")
        total = parts.rdd.map(lambda r: np.frombuffer(r[0])).treeAggregate(np.zeros(m * m + m + 1), lambda a, b: a + b, lambda a, b: a + b, 2)
        sent.destroy()
        bound = total[-1] - self.divergence()
        self.precision = (1 - rate) * self.precision + rate * total[: m * m].reshape(m, m)
        self.shift = (1 - rate) * self.shift + rate * total[m * m : -1]
        self._posterior()
        return float(bound)

    def divergence(self) -> float:
        """Kullback-Leibler divergence of the inducing values' posterior from their prior."""
        m = len(self.mean)
        inner = self.first @ self.spread
        return float(0.5 * (np.trace(inner) + self.mean @ self.first @ self.mean - m - np.linalg.slogdet(inner)[1]))

    def fit(self, df: DataFrame, steps: int = 15, rate: float = 0.7) -> VariationalGP:
        df = df.select(*self.coordinates, self.value).persist()
        self.bounds: list[float] = []
        rate = 1.0 if isinstance(self.likelihood, Gaussian) else rate
        held = None
        for _ in range(steps):
            here = (self.precision, self.shift)
            bound = self.step(df, rate)
            if held is not None and bound < self.bounds[-1] - 1e-9:
                # The last step went too far: back to before it, with half the rate.
                self.precision, self.shift = held
                self._posterior()
                rate, held = rate / 2, None
                self.bounds.pop()
                continue
            held = here
            self.bounds.append(bound)
        df.unpersist()
        return self

    def fit_batches(self, df: DataFrame, epochs: int = 5, batches: int = 4, rate: float = 0.3) -> VariationalGP:
        """Steps over hashed slices of the data in turn, each scaled up to the whole."""
        from pyspark.sql import functions as F

        sliced = df.select(*self.coordinates, self.value, F.pmod(F.xxhash64(*self.coordinates), F.lit(batches)).alias("__b")).persist()
        for e in range(epochs * batches):
            before = (self.precision, self.shift)
            self.step(sliced.where(F.col("__b") == e % batches), 1.0)
            self.precision = (1 - rate) * before[0] + rate * batches * self.precision
            self.shift = (1 - rate) * before[1] + rate * batches * self.shift
            self._posterior()
        sliced.unpersist()
        return self

    def raw(self, x, n_sim, normals):
        if not len(x):
            return {"mean": np.zeros(0), "variance": np.zeros(0), "explained": np.zeros(0), "sims": np.zeros((0, n_sim))}
        mean, var, _ = self.latent(x)
        prior = self.amplitude * self.covariance.diagonal(x)
        return {"mean": self.likelihood.predictive_mean(mean, var), "variance": var, "explained": 1 - var / prior, "sims": mean[:, None] + np.sqrt(var)[:, None] * normals}


class Convergence:
    """Whether a bound has stopped rising: its smoothed gain over the last `window` values is less than `tolerance` of the gain since the start."""

    def __init__(self, tolerance: float, window: int = 20):
        self.tolerance, self.window, self.start, self.smoothed = tolerance, window, None, []

    def stop(self, value: float) -> bool:
        if not self.tolerance or self.tolerance < 0:
            return False
        if self.start is None:
            self.start = value
        share = 2 / (self.window + 1)
        self.smoothed.append(value if not self.smoothed else share * value + (1 - share) * self.smoothed[-1])
        if len(self.smoothed) <= self.window:
            return False
        here = self.smoothed[-1]
        return abs(here - self.smoothed[-1 - self.window]) < self.tolerance * abs(here - self.start)


class Node:
    """A latent function: `moments(x)` gives mean and variance, each (rows, outputs)."""

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def explained(self, x: np.ndarray) -> np.ndarray:
        """Share of the prior variance that the data explain; of a unit prior by default."""
        return np.clip(1 - self.moments(x)[1], 0, 1)


class Process(Node):
    """A fitted model as a node of one output."""

    def __init__(self, model: _Predictor):
        self.model = model

    def moments(self, x):
        got = self.model.raw(x, 0, np.zeros(0))
        return got["mean"][:, None], got["variance"][:, None]

    def explained(self, x):
        return self.model.raw(x, 0, np.zeros(0))["explained"][:, None]


class Input(Node):
    """Coordinates as they are, with variances from other columns or none."""

    def __init__(self, columns: list[int], variances: list[int] = ()):
        self.columns, self.variances = list(columns), list(variances)

    def moments(self, x):
        m = x[:, self.columns]
        return m, x[:, self.variances] if self.variances else np.zeros_like(m)


class Stack(Node):
    def __init__(self, *parents: Node):
        self.parents = parents

    def moments(self, x):
        got = [p.moments(x) for p in self.parents]
        return np.concatenate([m for m, _ in got], 1), np.concatenate([v for _, v in got], 1)


class Select(Node):
    def __init__(self, parent: Node, columns: list[int]):
        self.parent, self.columns = parent, list(columns)

    def moments(self, x):
        m, v = self.parent.moments(x)
        return m[:, self.columns], v[:, self.columns]


class Linear(Node):
    """Outputs mixed by a matrix, its columns of unit norm if asked; from one to two outputs it is [1, -1]."""

    def __init__(self, parent: Node, weights: np.ndarray | None = None, unit_norm: bool = True):
        w = np.array([[1.0, -1.0]]) if weights is None else np.asarray(weights, float)
        self.parent, self.weights = parent, w / np.linalg.norm(w, axis=0) if unit_norm else w

    def moments(self, x):
        m, v = self.parent.moments(x)
        return m @ self.weights, v @ self.weights**2


class LinearCombination(Node):
    """Parents weighted by shares; with unit variance the weights are square roots of them."""

    def __init__(self, *parents: Node, shares: list[float] | None = None, unit_variance: bool = True):
        s = np.ones(len(parents)) if shares is None else np.asarray(shares, float)
        s = s / s.sum()
        self.parents, self.weights = parents, np.sqrt(s) if unit_variance else s

    def moments(self, x):
        got = [p.moments(x) for p in self.parents]
        return sum(w * m for w, (m, _) in zip(self.weights, got)), sum(w**2 * v for w, (_, v) in zip(self.weights, got))


class ProductOfExperts(Node):
    """Parents weighted by how much of the prior they explain over what is left."""

    def __init__(self, *parents: Node):
        self.parents = parents

    def moments(self, x):
        got = [p.moments(x) for p in self.parents]
        w = np.stack([p.explained(x) / (v + 1e-6) + 1e-6 for p, (_, v) in zip(self.parents, got)])
        w /= w.sum(0)
        return sum(a * m for a, (m, _) in zip(w, got)), sum(a * v for a, (_, v) in zip(w, got))


class Exponentiation(Node):
    def __init__(self, parent: Node):
        self.parent = parent

    def moments(self, x):
        m, v = self.parent.moments(x)
        mean = np.exp(m + v / 2)
        return mean, (np.exp(v) - 1) * mean**2


class Multiply(Node):
    def __init__(self, *parents: Node):
        self.parents = parents

    def moments(self, x):
        m, v = self.parents[0].moments(x)
        for p in self.parents[1:]:
            n, u = p.moments(x)
            m, v = m * n, v * u + v * n**2 + u * m**2
        return m, v


class Add(Node):
    def __init__(self, *parents: Node):
        self.parents = parents

    def moments(self, x):
        got = [p.moments(x) for p in self.parents]
        return sum(m for m, _ in got), sum(v for _, v in got)


class Bias(Node):
    def __init__(self, parent: Node, value: float = 0.0):
        self.parent, self.value = parent, value

    def moments(self, x):
        m, v = self.parent.moments(x)
        return m + self.value, v


class Scale(Node):
    def __init__(self, parent: Node, value: float = 1.0):
        self.parent, self.value = parent, value

    def moments(self, x):
        m, v = self.parent.moments(x)
        return m * self.value, v * self.value**2


class RadialTrend(Node):
    """1 - d^2 near a centre, d^2 - 4 d + 3 to two ranges, -1 beyond."""

    def __init__(self, centre: np.ndarray, reach: float = 1.0):
        self.centre, self.reach = np.asarray(centre, float), reach

    def moments(self, x):
        d = np.linalg.norm(x - self.centre, axis=1) / self.reach
        t = np.where(d < 1, 1 - d**2, np.where(d < 2, d**2 - 4 * d + 3, -1.0))[:, None]
        return t, np.zeros_like(t)


class Walk(Node):
    """Positions moved by small steps through a vector field, then the parent read where they arrive."""

    def __init__(self, field: Node, parent: Node, step: float = 0.01, n_steps: int = 10):
        self.field, self.parent, self.step, self.n_steps = field, parent, step, n_steps

    def path(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for _ in range(self.n_steps):
            m, v = self.field.moments(out[-1])
            out.append(out[-1] + self.step * m / (1 + v))
        return out

    def moments(self, x):
        return self.parent.moments(self.path(x)[-1])


class Network(_Predictor):
    """A node's first output as a model over DataFrames."""

    def __init__(self, coordinates: list[str], node: Node):
        self.coordinates, self.node = list(coordinates), node

    def raw(self, x, n_sim, normals):
        if not len(x):
            return {"mean": np.zeros(0), "variance": np.zeros(0), "explained": np.zeros(0), "sims": np.zeros((0, n_sim))}
        m, v = (a[:, 0] for a in self.node.moments(x))
        return {"mean": m, "variance": v, "explained": np.clip(1 - v, 0, 1), "sims": m[:, None] + np.sqrt(np.maximum(v, 0))[:, None] * normals}


def to_dot(node: object) -> str:
    """A network as a DOT graph, parents below."""
    lines, seen = [], {}

    def visit(n):
        if id(n) not in seen:
            seen[id(n)] = f"n{len(seen)}"
            lines.append(f'{seen[id(n)]} [label="{type(n).__name__}"];')
            for v in vars(n).values():
                for p in v if isinstance(v, tuple) else (v,):
                    if isinstance(p, Node):
                        lines.append(f"{visit(p)} -> {seen[id(n)]};")
        return seen[id(n)]

    visit(node)
    return "digraph {rankdir=BT;\n" + "\n".join(lines) + "\n}"
