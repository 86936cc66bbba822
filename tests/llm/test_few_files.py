"""Staged rows that are few go to few files, however many partitions a shuffle has; results stay the same."""

from pathlib import Path

import numpy as np
import pytest

from lithic.llm import common, simhash
from lithic.llm.components import connected_components


@pytest.fixture
def partitions(spark):
    """24 partitions that Spark leaves as they are."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(since):
    return {Path(p).name.split("-")[1]: len(list(Path(p.removeprefix("file:")).glob("part-*"))) for _, p in common._written[since:]}


def test_near_duplicates_write_few_files(spark, partitions):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(40):
        base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
        for c in range(4):
            rows.append((10 * g + c, " ".join(base[:-1] + [f"end{c // 2}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    since = len(common._written)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    files = written(since)
    assert set(files) >= {"distinct", "edges", "stars", "least", "linked"}
    assert {k: n for k, n in files.items() if k != "prints" and n > 1} == {}
    fps = {i: simhash.simhash(t.encode()) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    label, changed = {i: i for i in fps}, True
    while changed:
        new = {i: min(label[j] for j, g in fps.items() if (f ^ g).bit_count() <= 4) for i, f in fps.items()}
        label, changed = new, new != label
    assert {i: r.component_id for i, r in got.items()} == label


def test_rows_above_the_broadcast_are_joined_alike(spark, partitions, monkeypatch):
    rows = [(i, f"some words of text {i // 3}") for i in range(90)] + [(None, None), (200, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, simhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(common, "FILE_ROWS", 10)
    assert sorted(map(str, simhash.near_duplicates(docs).collect())) == want and len(want) == 92


@pytest.mark.parametrize("files", [None, 1, 3])
def test_components_are_the_same_in_few_files(spark, partitions, files):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 70)] + [(100, 101), (103, 101), (104, 104)], "a long, b long")
    want = {i: 1 for i in range(1, 71)} | {100: 100, 101: 100, 103: 100}
    since = len(common._written)
    assert {r.node: r.root for r in connected_components(edges, files).collect()} == want
    assert max(written(since).values()) <= (files or 24)
