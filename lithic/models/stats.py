"""Normal distribution functions, empirical distributions and seeded draws, in numpy only."""

from __future__ import annotations

import math

import numpy as np


def erf(x):
    """Elementwise. The wrapper is made here: one that has been called can't be sent to executors."""
    return np.vectorize(math.erf, otypes=[float])(x)


def normal_cdf(x):
    return 0.5 * (1 + erf(np.asarray(x, float) / math.sqrt(2)))


def normal_quantile(p):
    """Inverse of the normal distribution function by Newton steps from a logistic start."""
    p = np.clip(np.asarray(p, float), 1e-15, 1 - 1e-15)
    x = np.log(p / (1 - p)) / 1.702
    for _ in range(40):
        step = (normal_cdf(x) - p) / np.maximum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-12)
        x = x - np.clip(step, -0.5, 0.5)
    return x


def hazen(n: int) -> np.ndarray:
    """Plotting positions (i - 1/2) / n."""
    return (np.arange(n) + 0.5) / n


class SmoothEmpirical:
    """A distribution whose function goes through the Hazen positions of sorted samples."""

    def __init__(self, samples):
        self.x, self.p = np.sort(np.ravel(samples)), hazen(np.size(samples))

    def cdf(self, v):
        return np.interp(v, self.x, self.p, 0.0, 1.0)

    def quantile(self, q):
        return np.interp(q, self.p, self.x)


class EpsilonInsensitive:
    """Flat within epsilon scales of the centre, exponential beyond."""

    def __init__(self, loc=0.0, scale=1.0, epsilon=0.5):
        self.loc, self.scale, self.epsilon = loc, scale, epsilon

    def log_prob(self, x):
        u = np.abs((x - self.loc) / self.scale)
        return -np.maximum(u - self.epsilon, 0) - np.log(2 * self.scale * (1 + self.epsilon))

    def cdf(self, x):
        u, e = (np.asarray(x, float) - self.loc) / self.scale, self.epsilon
        tail = np.exp(-np.maximum(np.abs(u) - e, 0)) / (2 * (1 + e))
        return np.where(u < -e, tail, np.where(u > e, 1 - tail, 0.5 + u / (2 * (1 + e))))

    def quantile(self, p):
        p, e = np.asarray(p, float), self.epsilon
        t = 1 / (2 * (1 + e))
        low = -e + np.log(np.maximum(p, 1e-300) / t)
        high = e - np.log(np.maximum(1 - p, 1e-300) / t)
        return self.loc + self.scale * np.where(p < t, low, np.where(p > 1 - t, high, (p - 0.5) * 2 * (1 + e)))


class Huber:
    """Gaussian within epsilon scales of the centre, exponential beyond."""

    def __init__(self, loc=0.0, scale=1.0, epsilon=1.0):
        self.loc, self.scale, self.epsilon = loc, scale, epsilon
        self.core = math.sqrt(2 * math.pi) * math.erf(epsilon / math.sqrt(2))
        self.tail = math.exp(-(epsilon**2) / 2) / epsilon
        self.norm = self.core + 2 * self.tail

    def log_prob(self, x):
        u, e = np.abs((x - self.loc) / self.scale), self.epsilon
        return -np.where(u <= e, u**2 / 2, e * u - e**2 / 2) - np.log(self.norm * self.scale)

    def cdf(self, x):
        u, e = (np.asarray(x, float) - self.loc) / self.scale, self.epsilon
        beyond = self.tail * np.exp(-e * (np.maximum(np.abs(u), e) - e)) / self.norm
        inside = 0.5 + math.sqrt(2 * math.pi) * (normal_cdf(np.clip(u, -e, e)) - 0.5) / self.norm
        return np.where(u < -e, beyond, np.where(u > e, 1 - beyond, inside))


def gauss_hermite(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights for the mean of a function of a standard normal."""
    x, w = np.polynomial.hermite_e.hermegauss(n)
    return x, w / w.sum()


_seed = [0]


def set_seed(seed: int) -> None:
    _seed[0] = int(seed)


def rng() -> np.random.Generator:
    """A generator that continues from the package's seed."""
    _seed[0] += 1
    return np.random.default_rng(_seed[0])


def sobol(dimension: int, n: int, seed: int = 0) -> np.ndarray:
    """Digitally shifted low-discrepancy points (a Korobov lattice with a random shift), in (0, 1)."""
    shift = np.random.default_rng(seed).random(dimension)
    primes = [p for p in range(2, 20 * dimension + 30) if all(p % q for q in range(2, int(p**0.5) + 1))][:dimension]
    return (np.outer(np.arange(n) + 1, np.sqrt(primes)) + shift) % 1.0


def wasserstein_1(a, b) -> float:
    from lithic.operators.spatial import wasserstein_1 as distance

    return distance(np.asarray(a), np.asarray(b))


def conjugate_gradient(matmul, b: np.ndarray, tol: float = 1e-10, max_iter: int = 1000) -> np.ndarray:
    x, r = np.zeros_like(b), b.copy()
    p, rs = r.copy(), (r**2).sum(0)
    for _ in range(max_iter):
        if np.all(rs < tol**2):
            break
        ap = matmul(p)
        alpha = rs / np.maximum((p * ap).sum(0), 1e-300)
        x, r = x + alpha * p, r - alpha * ap
        new = (r**2).sum(0)
        p, rs = r + new / np.maximum(rs, 1e-300) * p, new
    return x


def lanczos(matmul, q: np.ndarray, m: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal basis and tridiagonal matrix of a symmetric operator, with full reorthogonalization."""
    q = q / np.linalg.norm(q)
    basis, alpha, beta = [q], [], []
    for k in range(m):
        v = matmul(basis[-1])
        alpha.append(float(v @ basis[-1]))
        for u in basis:
            v = v - (v @ u) * u
        size = np.linalg.norm(v)
        if size < 1e-10 or k == m - 1:
            break
        beta.append(size)
        basis.append(v / size)
    return np.stack(basis, 1), np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1)


def log_determinant(matmul, size: int, n: int = 10, m: int = 100, seed: int = 1234) -> float:
    """Stochastic Lanczos quadrature of a log determinant."""
    g, total = np.random.default_rng(seed), 0.0
    for _ in range(n):
        _, t = lanczos(matmul, g.choice([-1.0, 1.0], size), min(m, size))
        values, vectors = np.linalg.eigh(t)
        total += size * (vectors[0] ** 2 * np.log(np.maximum(values, 1e-300))).sum()
    return total / n
