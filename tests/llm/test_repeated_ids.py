"""Repeated and null ids, and the plain versions of the vote and of the risk's gradient."""

import re

import numpy as np
import pytest

from lithic.llm import mixing, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("kind", ["one id", "null ids", "same rows", "same rows of one source"])
def test_mix_meets_its_targets(spark, kind):
    rows = []
    for i in range(1000):
        name = {"one id": 7, "null ids": None, "same rows": 7}.get(kind, i)
        same = kind == "same rows" or (kind == "same rows of one source" and i % 2)
        rows.append((1 if same and kind != "same rows" else name, "w " * 50 if same else f"x{i} " + "w " * 49, "en", f"s{i % 2}", i))
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == 1000 and all(r.taken % 50 == 0 and r.taken <= 150 for r in got)
    for s in ("s0", "s1"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 25
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_learning_sets_are_bounded_where_an_id_repeats(spark, monkeypatch):
    rows = [(3, f"text number {i} of one id", "en", "s", 1) for i in range(3000)] + [(i, f"other words {i}", "en", "s", 1) for i in range(10, 60)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(3, 1, 1), *((i, i % 2, i % 2) for i in range(10, 60))], "doc_id long, quality int, toxic int")
    seen = {}

    def fit(positives, unlabelled, prior):
        seen.update(p=len(positives), u=len(unlabelled))
        return np.zeros(toxicity.SLOTS, np.float32), 0.0

    monkeypatch.setattr(toxicity, "fit", fit)
    everyone = lambda i: i.isNotNull()
    toxicity.learn(docs, labels.select("doc_id", "toxic"), "toxic", everyone)
    assert seen == {"p": 26, "u": 51}
    model = quality.learn(docs, labels.select("doc_id", "quality"), "quality", everyone, 20)
    assert len(model[4]) <= 40


def test_vote_by_hand():
    rng = np.random.default_rng(1)
    known, latent = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.standard_normal((80, 6)), rng.standard_normal((15, 6))))
    labels, mass = rng.integers(0, 2, 80).astype(float), rng.uniform(0.5, 2, 80)
    got = quality.vote(latent, known, labels, mass, 7)
    for x, g in zip(latent, got):
        near = sorted(range(80), key=lambda j: -float(x @ known[j]))[:7]
        w = [np.exp(float(x @ known[j]) / quality.FALL) * mass[j] for j in near]
        assert abs(g - sum(a * labels[j] for a, j in zip(w, near)) / sum(w)) < 1e-9


def test_fit_lowers_the_risk():
    """The risk by its formula, at the start and after the steps, and where nothing pulls it down any more."""
    rng = np.random.default_rng(2)
    clean = [rng.integers(0, 500, 20).astype(np.int32) for _ in range(300)]
    toxic = [np.append(rng.integers(0, 500, 20), 700 + rng.integers(0, 4, 2)).astype(np.int32) for _ in range(90)]
    positives, unlabelled, prior = toxic[:60], clean + toxic[60:], 0.1

    def risk(w, b):
        s = lambda x: 1 / (1 + np.exp(-(float(w[np.asarray(x)].sum()) + b)))
        p, u = np.array([s(x) for x in positives]), np.array([s(x) for x in unlabelled])
        return prior * (1 - p).mean() + max(0.0, u.mean() - prior * p.mean())

    start, end = (toxicity.fit(positives, unlabelled, prior, steps=n) for n in (1, 400))
    assert risk(*end) < 0.5 * risk(*start)
    w, b = end
    for j in (700, 701, 702, 703):
        for step in (-0.5, 0.5):
            moved = w.copy()
            moved[j] += step
            assert risk(moved, b) >= risk(w, b) - 2e-3
