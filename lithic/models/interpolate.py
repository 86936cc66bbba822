"""Cubic convolution on lattices, and cubic splines with their inverses."""

from __future__ import annotations

import itertools

import numpy as np


def _weights(t: np.ndarray) -> np.ndarray:
    """Cubic convolution weights of the four nodes about a position t between the middle two."""
    return np.stack([((-0.5 * t + 1) * t - 0.5) * t, (1.5 * t - 2.5) * t * t + 1, ((-1.5 * t + 2) * t + 0.5) * t, (0.5 * t - 0.5) * t * t], -1)


class CubicConvolution:
    """Interpolation of values on a regular lattice of any dimension, separable, edges extended by their nodes."""

    def __init__(self, start, step, values: np.ndarray):
        self.start, self.step, self.values = np.atleast_1d(np.asarray(start, float)), np.atleast_1d(np.asarray(step, float)), np.asarray(values, float)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float).reshape(len(x), -1)
        at = (x - self.start) / self.step
        base = np.clip(np.floor(at).astype(int), 0, np.array(self.values.shape) - 2)
        w = _weights(np.clip(at - base, 0, 1))
        out = np.zeros(len(x))
        for shift in itertools.product(range(4), repeat=x.shape[1]):
            index = tuple(np.clip(base[:, d] + s - 1, 0, self.values.shape[d] - 1) for d, s in enumerate(shift))
            out += self.values[index] * np.prod([w[:, d, s] for d, s in enumerate(shift)], axis=0)
        return out


class CubicSpline:
    """Cubic Hermite curve through points; monotone=True limits slopes so that it never turns between them."""

    def __init__(self, x, y, monotone: bool = False):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        h, s = np.diff(self.x), np.diff(self.y) / np.diff(self.x)
        p = (s[:-1] * h[1:] + s[1:] * h[:-1]) / (h[:-1] + h[1:])
        if monotone:
            p = (np.sign(s[:-1]) + np.sign(s[1:])) * np.minimum(np.minimum(np.abs(s[:-1]), np.abs(s[1:])), 0.5 * np.abs(p))
        self.slope = np.concatenate([s[:1], p, s[-1:]])

    def _parts(self, v):
        i = np.clip(np.searchsorted(self.x, v, "right") - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        s = (self.y[i + 1] - self.y[i]) / h
        return i, v - self.x[i], (self.slope[i] + self.slope[i + 1] - 2 * s) / h**2, (3 * s - 2 * self.slope[i] - self.slope[i + 1]) / h

    def __call__(self, v):
        v = np.asarray(v, float)
        i, t, a, b = self._parts(np.clip(v, self.x[0], self.x[-1]))
        y = ((a * t + b) * t + self.slope[i]) * t + self.y[i]
        return y + np.where(v < self.x[0], (v - self.x[0]) * self.slope[0], 0) + np.where(v > self.x[-1], (v - self.x[-1]) * self.slope[-1], 0)

    def gradient(self, v):
        i, t, a, b = self._parts(np.clip(np.asarray(v, float), self.x[0], self.x[-1]))
        return (3 * a * t + 2 * b) * t + self.slope[i]

    def inverse(self, z, rounds: int = 80):
        """The position of a value on a rising curve, by bisection."""
        z = np.asarray(z, float)
        reach = np.abs(z - np.clip(z, self.y[0], self.y[-1])) / max(min(self.slope[0], self.slope[-1]), 1e-12)
        lo, hi = self.x[0] - reach, self.x[-1] + reach
        for _ in range(rounds):
            mid = (lo + hi) / 2
            above = self(mid) > z
            lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
        return (lo + hi) / 2
