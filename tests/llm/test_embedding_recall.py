"""Recall of links on vectors that do not lie evenly about the origin, against brute force."""

import numpy as np
import pytest

from lithic.llm import embedding_dedup

unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)


def common_and_six(rng):
    x, c = unit(rng.standard_normal((3000, 6)) @ rng.standard_normal((6, 64))), rng.standard_normal(64)
    return unit(x + c / np.linalg.norm(c))


def clusters(rng):
    centres = unit(rng.standard_normal((30, 64)))
    return unit(centres[rng.integers(0, 30, 3000)] + 0.24 * unit(rng.standard_normal((3000, 64))) * rng.uniform(0.3, 1.3, (3000, 1)))


def isotropic(rng):
    x = unit(rng.standard_normal((2500, 64)))
    return np.concatenate([x, unit(x[:800] + 0.31 * unit(rng.standard_normal((800, 64))))])


@pytest.mark.parametrize("make", [common_and_six, clusters, isotropic])
def test_recall(spark, make):
    x = make(np.random.default_rng(12))
    want = ((x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)).sum(1)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() > 0


def test_sql_says_the_same(spark):
    import duckdb

    rng = np.random.default_rng(13)
    base = rng.standard_normal((40, 16))
    x = [*base.tolist(), *(base[rng.integers(0, 8, 60)] + 0.05 * rng.standard_normal((60, 16))).tolist(), [0.0] * 16, None, [None] + [1.0] * 15, [float("nan")] * 16, base[0].tolist()]
    embeddings = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>").toArrow()  # noqa: F841  read by the SQL
    want = duckdb.sql(embedding_dedup.ORACLE).fetchall()
    got = embedding_dedup.near_vectors(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
