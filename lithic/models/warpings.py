"""Invertible maps from data to a scale on which a Gaussian process makes sense.

forward(x) gives the warped values and the log determinant per row; backward inverts it; initialize
takes parameters from data, with optional weights.
"""

from __future__ import annotations

import numpy as np


class Warping:
    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x, np.zeros(len(x))

    def backward(self, z: np.ndarray) -> np.ndarray:
        return z

    def initialize(self, x: np.ndarray, weights: np.ndarray | None = None) -> Warping:
        return self


Identity = Warping


class ZScore(Warping):
    """Mean 0 and deviation 1; robust: of values drawn in to the central 90 %."""

    def __init__(self, mean=0.0, std=1.0, robust=False):
        self.mean, self.std, self.robust = mean, std, robust

    def initialize(self, x, weights=None):
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        if self.robust:
            x = np.clip(x, *np.quantile(x, [0.05, 0.95], axis=0))
        self.mean = np.average(x, axis=0, weights=w)
        self.std = np.sqrt(np.average((x - self.mean) ** 2, axis=0, weights=w)) + 1e-300
        return self

    def forward(self, x):
        z = (x - self.mean) / self.std
        return z, np.full(len(x), -np.sum(np.log(np.broadcast_to(self.std, z.shape[1:]))))

    def backward(self, z):
        return z * self.std + self.mean


class Log(Warping):
    def __init__(self, shift=1e-6):
        self.shift = shift

    def forward(self, x):
        z = np.log(x + self.shift)
        return z, -z.reshape(len(x), -1).sum(1)

    def backward(self, z):
        return np.exp(z) - self.shift


class Softplus(Warping):
    def __init__(self, shift=1e-6):
        self.shift = shift

    def forward(self, x):
        v = x + self.shift
        z = np.where(v > 50, v, np.log(np.expm1(np.minimum(v, 50))))
        return z, -np.log1p(-np.exp(-np.minimum(v, 700))).reshape(len(x), -1).sum(1)

    def backward(self, z):
        return np.where(z > 50, z, np.log1p(np.exp(np.minimum(z, 50)))) - self.shift


class Sigmoid(Warping):
    def __init__(self, shift=1e-6):
        self.shift = shift

    def forward(self, x):
        p = x * (1 - 2 * self.shift) + self.shift
        return np.log(p / (1 - p)), (np.log(1 - 2 * self.shift) - np.log(p * (1 - p))).reshape(len(x), -1).sum(1)

    def backward(self, z):
        return (1 / (1 + np.exp(-z)) - self.shift) / (1 - 2 * self.shift)


class CenteredLogRatio(Warping):
    def forward(self, x):
        z = np.log(x)
        return z - z.mean(1, keepdims=True), -z.sum(1)

    def backward(self, z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


class PCA(Warping):
    """Whitening by the population covariance, keeping the leading components."""

    def __init__(self, n_components=None):
        self.n_components = n_components

    def initialize(self, x, weights=None):
        w = np.ones(len(x)) if weights is None else np.asarray(weights, float)
        self.mean = np.average(x, axis=0, weights=w)
        c = (x - self.mean).T @ ((x - self.mean) * (w / w.sum())[:, None])
        values, vectors = np.linalg.eigh(c)
        keep = np.argsort(-values)[: self.n_components or len(values)]
        self.scale, self.axes = np.sqrt(np.maximum(values[keep], 1e-12)), vectors[:, keep]
        return self

    def forward(self, x):
        return (x - self.mean) @ self.axes / self.scale, np.full(len(x), -np.log(self.scale).sum())

    def backward(self, z):
        return (z * self.scale) @ self.axes.T + self.mean


class Chained(Warping):
    def __init__(self, *steps: Warping):
        self.steps = steps

    def initialize(self, x, weights=None):
        for s in self.steps:
            x = s.initialize(x, weights).forward(x)[0]
        return self

    def forward(self, x):
        total = np.zeros(len(x))
        for s in self.steps:
            x, d = s.forward(x)
            total = total + d
        return x, total

    def backward(self, z):
        for s in reversed(self.steps):
            z = s.backward(z)
        return z


class Spline(Warping):
    """Monotone cubic map through knots (Steffen's slopes), linear beyond them; fitted to normal scores."""

    def __init__(self, knots=11, reach=5.0):
        self.x = np.linspace(-reach, reach, knots)
        self.y = self.x.copy()
        self._slopes()

    def _slopes(self):
        h, s = np.diff(self.x), np.diff(self.y) / np.diff(self.x)
        p = (s[:-1] * h[1:] + s[1:] * h[:-1]) / (h[:-1] + h[1:])
        inner = (np.sign(s[:-1]) + np.sign(s[1:])) * np.minimum(np.minimum(np.abs(s[:-1]), np.abs(s[1:])), 0.5 * np.abs(p))
        self.slope = np.concatenate([s[:1], inner, s[-1:]])
        return self

    def initialize(self, x, weights=None):
        from lithic.models.stats import normal_quantile

        v = np.sort(np.ravel(x))
        probs = (np.arange(len(v)) + 0.5) / len(v)
        at = np.quantile(v, np.linspace(0.02, 0.98, len(self.x)))
        at = np.maximum.accumulate(at + 1e-9 * np.arange(len(at)))
        self.x, self.y = at, normal_quantile(np.interp(at, v, probs))
        self.y = np.maximum.accumulate(self.y + 1e-9 * np.arange(len(at)))
        return self._slopes()

    def _parts(self, x):
        i = np.clip(np.searchsorted(self.x, x, "right") - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        s = (self.y[i + 1] - self.y[i]) / h
        a, b = (self.slope[i] + self.slope[i + 1] - 2 * s) / h**2, (3 * s - 2 * self.slope[i] - self.slope[i + 1]) / h
        return i, x - self.x[i], a, b

    def forward(self, x):
        i, t, a, b = self._parts(x)
        y = ((a * t + b) * t + self.slope[i]) * t + self.y[i]
        d = (3 * a * t + 2 * b) * t + self.slope[i]
        low, high = x < self.x[0], x > self.x[-1]
        y = np.where(low, self.y[0] + (x - self.x[0]) * self.slope[0], np.where(high, self.y[-1] + (x - self.x[-1]) * self.slope[-1], y))
        d = np.where(low, self.slope[0], np.where(high, self.slope[-1], d))
        return y, np.log(np.maximum(d, 1e-12)).reshape(len(x), -1).sum(1)

    def backward(self, z):
        z = np.asarray(z, float)
        reach = 1 + np.abs(z - np.clip(z, self.y[0], self.y[-1])) / max(min(self.slope[0], self.slope[-1]), 1e-12)
        lo, hi = self.x[0] - reach, self.x[-1] + reach
        for _ in range(100):
            mid = 0.5 * (lo + hi)
            above = self.forward(mid)[0] > z
            lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
        return 0.5 * (lo + hi)


def robust_moments(x: np.ndarray, support: float = 0.75, tries: int = 30, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the most compact share of (bounded) data: random starts, then concentration steps."""
    n, d = x.shape
    h = max(int(n * support), d + 2)
    rng, best = np.random.default_rng(seed), None
    for _ in range(tries):
        take = rng.choice(n, min(n, d + 2), replace=False)
        last = np.inf
        for _ in range(30):
            mean, cov = x[take].mean(0), np.cov(x[take].T, bias=True) + np.eye(d) * 1e-12
            gap = x - mean
            take = np.argsort(((gap @ np.linalg.inv(cov)) * gap).sum(1))[:h]
            size = np.linalg.slogdet(np.cov(x[take].T, bias=True) + np.eye(d) * 1e-12)[1]
            if size >= last - 1e-12:
                break
            last = size
        if best is None or last < best[0]:
            best = (last, x[take].mean(0), np.cov(x[take].T, bias=True))
    return best[1], best[2]


class RobustPCA(PCA):
    """Whitening by the moments of the most compact share of the data."""

    def __init__(self, n_components=None, support=0.75):
        super().__init__(n_components)
        self.support = support

    def initialize(self, x, weights=None):
        self.mean, c = robust_moments(x, self.support)
        values, vectors = np.linalg.eigh(np.atleast_2d(c))
        keep = np.argsort(-values)[: self.n_components or len(values)]
        self.scale, self.axes = np.sqrt(np.maximum(values[keep], 1e-12)), vectors[:, keep]
        return self


class Rotation(Warping):
    """An orthogonal rotation of whitened data, started from independent components."""

    def __init__(self, matrix=None):
        self.matrix = None if matrix is None else np.asarray(matrix, float)

    def initialize(self, x, weights=None):
        d = x.shape[1]
        w = np.linalg.qr(np.random.default_rng(0).standard_normal((d, d)))[0]
        for _ in range(200):
            g = np.tanh(x @ w)
            new = (x.T @ g) / len(x) - w * (1 - g**2).mean(0)
            u, _, v = np.linalg.svd(new)
            new = u @ v
            if np.abs(np.abs((new * w).sum(0)) - 1).max() < 1e-9:
                w = new
                break
            w = new
        self.matrix = w
        return self

    def forward(self, x):
        return x @ self.matrix, np.zeros(len(x))

    def backward(self, z):
        return z @ self.matrix.T


class Center(ZScore):
    """The mean taken off, the scale left alone."""

    def initialize(self, x, weights=None):
        super().initialize(x, weights)
        self.std = np.ones_like(np.asarray(self.std))
        return self


class Scale(Warping):
    def __init__(self, scale=1.0):
        self.scale = scale

    def forward(self, x):
        return x / self.scale, np.full(len(x), -np.log(self.scale) * x.reshape(len(x), -1).shape[1])

    def backward(self, z):
        return z * self.scale


class ScaledSimplex(Warping):
    """Parts over their means, zeros allowed. Back, a row first gets what it lacks to a sum of one in
    proportion to the means, and is then drawn towards them just until no part is negative."""

    def initialize(self, x, weights=None):
        whole = np.isfinite(x).all(1)
        self.mean = np.average(x[whole], axis=0, weights=None if weights is None else np.asarray(weights)[whole])
        return self

    def forward(self, x):
        return x / self.mean, np.full(len(x), -np.log(self.mean).sum())

    def backward(self, z):
        v = z * self.mean
        v = v + (1 - v.sum(1, keepdims=True)) * self.mean
        needed = np.where(v < 0, -v / np.where(v < 0, self.mean - v, 1.0), 0.0).max(1, keepdims=True)
        return np.maximum(v + needed * (self.mean - v), 0.0)
