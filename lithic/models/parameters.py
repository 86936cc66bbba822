"""Bounded model parameters: plain, positive, on a simplex, circular, and matrices of unit or orthonormal columns."""

from __future__ import annotations

import json

import numpy as np


class Parameter:
    """A value between bounds that training moves on an unbounded scale; fixed ones stay."""

    def __init__(self, value, low=-np.inf, high=np.inf, fixed: bool = False, prior=None):
        self.low, self.high, self.fixed, self.prior = low, high, fixed, prior
        self.set(value)

    def set(self, value) -> None:
        """Values outside the bounds are drawn in to them."""
        self.value = np.clip(np.asarray(value, float), self.low, self.high)

    def free(self) -> np.ndarray:
        return self.value

    def set_free(self, z) -> None:
        self.set(z)

    def log_prior(self) -> float:
        return 0.0 if self.fixed or self.prior is None else float(np.sum(self.prior(self.value)))


class Positive(Parameter):
    def __init__(self, value, low=1e-12, high=np.inf, fixed=False, prior=None):
        super().__init__(value, max(low, 1e-300), high, fixed, prior)

    def free(self):
        return np.log(self.value)

    def set_free(self, z):
        self.set(np.exp(z))


class Simplex(Parameter):
    """Shares that add up to one."""

    def set(self, value):
        v = np.maximum(np.asarray(value, float), 1e-12)
        self.value = v / v.sum()

    def free(self):
        return np.log(self.value) - np.log(self.value).mean()

    def set_free(self, z):
        z = np.asarray(z, float)
        self.set(np.exp(z - z.max()))


class Circular(Parameter):
    """Wraps around at its bounds."""

    def set(self, value):
        self.value = self.low + np.mod(np.asarray(value, float) - self.low, self.high - self.low)


class UnitColumns(Parameter):
    """A matrix whose columns have length one, centred first if asked."""

    def __init__(self, value, centred: bool = False, fixed=False):
        self.centred = centred
        super().__init__(value, fixed=fixed)

    def set(self, value):
        v = np.asarray(value, float)
        v = v - v.mean(0) if self.centred else v
        self.value = v / np.maximum(np.linalg.norm(v, axis=0), 1e-300)


class Orthonormal(Parameter):
    """A matrix with orthonormal columns, centred first if asked."""

    def __init__(self, value, centred: bool = False, fixed=False):
        self.centred = centred
        super().__init__(value, fixed=fixed)

    def set(self, value):
        v = np.asarray(value, float)
        q, r = np.linalg.qr(v - v.mean(0) if self.centred else v)
        self.value = q * np.where(np.diag(r) < 0, -1, 1)


class Registry:
    """Parameters by name; one that several names share counts once."""

    def __init__(self, **parameters: Parameter):
        self.parameters = parameters

    def unfixed(self) -> list[Parameter]:
        return list({id(p): p for p in self.parameters.values() if not p.fixed}.values())

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(p.free()) for p in self.unfixed()] or [np.zeros(0)])

    def set_flat(self, z: np.ndarray) -> None:
        at = 0
        for p in self.unfixed():
            n = np.size(p.value)
            p.set_free(np.reshape(z[at : at + n], np.shape(p.value)))
            at += n

    def log_prior(self) -> float:
        return sum(p.log_prior() for p in {id(p): p for p in self.parameters.values()}.values())

    def state(self) -> str:
        return json.dumps({k: np.asarray(p.value).tolist() for k, p in self.parameters.items()})

    def load(self, state: str) -> None:
        for k, v in json.loads(state).items():
            self.parameters[k].set(v)
