"""Support points for sparse models: lattices, clusters and overlapping experts."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _extent(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    row = df.agg(*(F.min(c) for c in columns), *(F.max(c) for c in columns)).first()
    return np.array(row[: len(columns)], float), np.array(row[len(columns) :], float)


def from_grid(df: DataFrame, columns: list[str], step) -> np.ndarray:
    """A lattice over the data, centred on its box; the first axis varies slowest."""
    low, high = _extent(df, columns)
    step = np.broadcast_to(np.asarray(step, float), len(columns))
    axes = []
    for a, b, s in zip(low, high, step):
        n = int(np.ceil((b - a) / s - 1e-9)) + 1
        axes.append((a + b) / 2 + (np.arange(n) - (n - 1) / 2) * s)
    return np.array(list(itertools.product(*axes)))


def from_kmeans(df: DataFrame, columns: list[str], n: int, seed: int = 1) -> np.ndarray:
    """Centres of a distributed k-means."""
    from lithic.models.gp import kmeans_inducing

    return kmeans_inducing(df, columns, n, seed)


def combine(*sources: np.ndarray, tolerance: float = 0.0) -> np.ndarray:
    """Sources one after the other without points that snap to the place of an earlier one."""
    points = np.concatenate(sources)
    key = np.round(points / tolerance) if tolerance > 0 else points
    _, first = np.unique(key, axis=0, return_index=True)
    return points[np.sort(first)]


def grid_experts(df: DataFrame, columns: list[str], step: float, block: int = 4) -> list[np.ndarray]:
    """Blocks of a lattice with a margin of one node on each side: (block + 2)^d nodes each."""
    low, high = _extent(df, columns)
    n = np.maximum(1, np.ceil((high - low) / step / block - 1e-9)).astype(int)
    out = []
    for corner in itertools.product(*(range(k) for k in n)):
        axes = [a + step * (np.arange(-1, block + 1) + c * block) for a, c in zip(low, corner)]
        out.append(np.array(list(itertools.product(*axes))))
    return out


def balanced_labels(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre for each point, no centre taking over its even share; the cheapest choices go first."""
    n, k = len(points), len(centres)
    room = np.full(k, -(-n // k))
    d = ((points[:, None] - centres[None]) ** 2).sum(2)
    label = np.full(n, -1)
    for flat in np.argsort(d, axis=None, kind="stable"):
        i, c = divmod(int(flat), k)
        if label[i] < 0 and room[c]:
            label[i], room[c] = c, room[c] - 1
    return label


def experts(points: np.ndarray, n_experts: int, overlap: float = 0.1, seed: int = 0) -> list[np.ndarray]:
    """Balanced clusters of (bounded) support points; each borrows its nearest outsiders by Mahalanobis distance."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), n_experts, replace=False)]
    for _ in range(15):
        label = balanced_labels(points, centres)
        centres = np.stack([points[label == c].mean(0) if (label == c).any() else centres[c] for c in range(n_experts)])
    out = []
    for c in range(n_experts):
        mine, rest = points[label == c], points[label != c]
        cov = np.cov(mine.T) + np.eye(points.shape[1]) * 1e-9 if len(mine) > 1 else np.eye(points.shape[1])
        d = rest - mine.mean(0)
        far = ((d @ np.linalg.inv(np.atleast_2d(cov))) * d).sum(1)
        take = np.argsort(far)[: int(round(overlap * len(mine)))]
        out.append(np.concatenate([mine, rest[take]]))
    return out
