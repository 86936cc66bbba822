"""Likelihoods of a latent Gaussian value, with expectations by Gauss-Hermite quadrature."""

from __future__ import annotations

import math

import numpy as np

from lithic.models.stats import EpsilonInsensitive as _Flat
from lithic.models.stats import Huber as _Huber
from lithic.models.stats import gauss_hermite, normal_cdf

NODES = 32


class Likelihood:
    """log_density(y, f) elementwise; the rest follows."""

    def log_density(self, y: np.ndarray, f: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def expectations(self, y: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """E[log p] under a normal latent, and its derivatives by that normal's mean and variance (Bonnet and Price)."""
        x, w = gauss_hermite(NODES)
        s = np.sqrt(np.maximum(var, 1e-12))
        value = self.log_density(y[:, None], mean[:, None] + s[:, None] * x)
        return value @ w, (value * x) @ w / s, (value * (x**2 - 1)) @ w / (2 * s**2)

    def predictive_mean(self, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
        """Mean of an observation; the latent mean where noise is symmetric."""
        return mean


class Gaussian(Likelihood):
    def __init__(self, noise: float = 0.1):
        self.noise = noise

    def log_density(self, y, f):
        return -0.5 * np.log(2 * np.pi * self.noise) - (y - f) ** 2 / (2 * self.noise)


class Laplace(Likelihood):
    def __init__(self, scale: float = 0.3):
        self.scale = scale

    def log_density(self, y, f):
        return -np.log(2 * self.scale) - np.abs(y - f) / self.scale

    def expectations(self, y, mean, var):
        """In closed form: the kink defeats quadrature where the latent is wide."""
        s = np.sqrt(np.maximum(var, 1e-12))
        d = (mean - y) / s
        side, peak = 2 * normal_cdf(d) - 1, np.exp(-d * d / 2) / np.sqrt(2 * np.pi)
        return -np.log(2 * self.scale) - s * (2 * peak + d * side) / self.scale, -side / self.scale, -peak / (s * self.scale)


class StudentT(Likelihood):
    def __init__(self, scale: float = 0.3, df: float = 4.0):
        if not 2.01 <= df <= 50:
            raise ValueError("degrees of freedom lie between 2.01 and 50")
        self.scale, self.df = scale, df

    def log_density(self, y, f):
        v = self.df
        norm = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) - math.log(self.scale)
        return norm - (v + 1) / 2 * np.log1p(((y - f) / self.scale) ** 2 / v)


class EpsilonInsensitive(Likelihood):
    def __init__(self, scale: float = 0.3, epsilon: float = 0.5):
        self.scale, self.epsilon = scale, epsilon

    def log_density(self, y, f):
        return _Flat(f, self.scale, self.epsilon).log_prob(y)


class Huber(Likelihood):
    def __init__(self, scale: float = 0.3, epsilon: float = 1.0):
        self.scale, self.epsilon = scale, epsilon

    def log_density(self, y, f):
        return _Huber(f, self.scale, self.epsilon).log_prob(y)


class Gamma(Likelihood):
    """Rate 1 and a shape of exp(latent + shift) and 0.01; the shift lies between -3 and 3."""

    def __init__(self, shift: float = 0.0):
        self.shift = float(np.clip(shift, -3, 3))

    def shape(self, f):
        return np.exp(np.minimum(f + self.shift, 700)) + 0.01

    def log_density(self, y, f):
        shape = self.shape(f)
        return (shape - 1) * np.log(np.maximum(y, 1e-12)) - y - np.vectorize(math.lgamma, otypes=[float])(shape)

    def predictive_mean(self, mean, var):
        return np.exp(mean + self.shift + var / 2) + 0.01


class Bernoulli(Likelihood):
    """Probit of a shifted latent; y is 1 or 0."""

    def __init__(self, shift: float = 0.0, sharpness: float = 1.0):
        self.shift, self.sharpness = shift, sharpness

    @classmethod
    def one_class(cls, sharpness: float = 1.0) -> Bernoulli:
        return cls(-3.0, sharpness)

    def log_density(self, y, f):
        return np.log(np.maximum(normal_cdf((2 * y - 1) * (self.sharpness * f + self.shift)), 1e-12))

    def predictive_mean(self, mean, var):
        return normal_cdf((self.sharpness * mean + self.shift) / np.sqrt(1 + self.sharpness**2 * var))


class MaximumMargin(Likelihood):
    """A sigmoid that is twice as steep within the margin of 1; y is 1 or 0."""

    def __init__(self, rate: float = 1.0):
        self.rate = float(np.clip(rate, 1e-3, 1e3))

    def _logit(self, f):
        return self.rate * np.where(np.abs(f) < 1, 2 * f, f + np.sign(f))

    def log_density(self, y, f):
        return -np.logaddexp(0, -(2 * y - 1) * self._logit(f))

    def predictive_mean(self, mean, var):
        x, w = gauss_hermite(64)
        return (1 / (1 + np.exp(-self._logit(mean[:, None] + np.sqrt(var)[:, None] * x)))) @ w


class Multivariate(Likelihood):
    """Several variables, each with noise of its own around its own latent, on the scale of a common warping.

    `parts` has a likelihood per variable, or one for all; the warping (standard scores by default) is
    taken from data by `initialize`.
    """

    def __init__(self, parts: list[Likelihood] | Likelihood, n: int | None = None, warping=None):
        from lithic.models.warpings import ZScore

        self.parts = list(parts) if isinstance(parts, (list, tuple)) else [parts] * int(n)
        self.warping = warping or ZScore()

    def initialize(self, y: np.ndarray) -> Multivariate:
        self.warping.initialize(y)
        return self

    def log_density(self, y, f):
        """Per row, of all variables together; y and f are (rows, variables)."""
        z, log_det = self.warping.forward(y)
        return sum(p.log_density(z[:, i], f[:, i]) for i, p in enumerate(self.parts)) + log_det

    def expectations(self, y, mean, var):
        """Expected log densities by row, and derivatives by row and variable."""
        z, log_det = self.warping.forward(y)
        got = [p.expectations(z[:, i], mean[:, i], var[:, i]) for i, p in enumerate(self.parts)]
        return sum(g[0] for g in got) + log_det, np.stack([g[1] for g in got], 1), np.stack([g[2] for g in got], 1)

    def predictive_mean(self, mean, var):
        return self.warping.backward(np.stack([p.predictive_mean(mean[:, i], var[:, i]) for i, p in enumerate(self.parts)], 1))


class Ordered(Likelihood):
    """Level 0, 1, .. by which of the increasing thresholds the latent passes, with probit noise."""

    def __init__(self, thresholds: list[float], noise: float = 0.1):
        self.thresholds, self.noise = np.sort(np.asarray(thresholds, float)), noise

    def probabilities(self, f):
        c = normal_cdf((self.thresholds - f[..., None]) / self.noise)
        c = np.concatenate([np.zeros((*f.shape, 1)), c, np.ones((*f.shape, 1))], -1)
        return np.diff(c, axis=-1)

    def log_density(self, y, f):
        p = self.probabilities(f)
        index = np.broadcast_to(np.asarray(y, int), f.shape)[..., None]
        return np.log(np.maximum(np.take_along_axis(p, index, -1)[..., 0], 1e-12))


class Mixture(Likelihood):
    """Gaussian noise of several scales; `responsibilities` says which one a datum belongs to."""

    def __init__(self, scales: list[float] = (0.1, 0.6), weights: list[float] | None = None):
        self.scales = np.asarray(scales, float)
        w = np.ones(len(self.scales)) if weights is None else np.asarray(weights, float)
        self.weights = w / w.sum()

    def _parts(self, y, f):
        d = (np.asarray(y - f, float)[..., None] / self.scales) ** 2
        return np.log(self.weights) - np.log(self.scales * math.sqrt(2 * math.pi)) - d / 2

    def log_density(self, y, f):
        p = self._parts(y, f)
        top = p.max(-1)
        return top + np.log(np.exp(p - top[..., None]).sum(-1))

    def responsibilities(self, mean, var, y):
        """Posterior share of each component, the latent integrated out."""
        s2 = self.scales**2 + np.asarray(var)[..., None]
        p = np.log(self.weights) - 0.5 * np.log(s2) - (np.asarray(y - mean)[..., None]) ** 2 / (2 * s2)
        p = np.exp(p - p.max(-1, keepdims=True))
        return p / p.sum(-1, keepdims=True)


def categorical_entropy(p: np.ndarray) -> np.ndarray:
    """Entropy over the log of the number of labels."""
    return -(p * np.log(np.maximum(p, 1e-300))).sum(-1) / max(math.log(p.shape[-1]), 1e-300)


def indicators(p: np.ndarray) -> np.ndarray:
    """Log odds of each label against its best rival; a tie gives 0."""
    logs = np.log(np.maximum(p, 1e-12))
    order = np.sort(logs, axis=-1)
    best, second = order[..., -1:], order[..., -2:-1]
    return logs - np.where(logs == best, second, best)
