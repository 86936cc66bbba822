"""Held-out texts score above the add-one base, from the smallest tables on, and alike on any number of cores; a plain sum over one text."""

import numpy as np

from lithic.llm import lm_score

SF = "/root/testdata/sf0.001"


def test_held_out_texts_gain(spark):
    got = lm_score.op3_lm_score(spark, SF).toPandas()
    held = got[got.held_out]
    assert len(held) > 10 and (held.score.sum() - held.base_score.sum()) / held.n_tokens.sum() > 0.1


def test_start_is_the_unigram_model():
    counts = np.array([50.0, 20.0, 5.0])
    layout = lm_score.Layout.of([b"aa", b"bb", b"cc"], counts, np.full(lm_score.BUCKETS, 2.0))
    got = lm_score.Model(layout).log_probs(np.array([0, 1, 2, lm_score.WORDS], np.uint16))
    total = counts.sum() + 2 * lm_score.BUCKETS
    assert np.allclose(np.exp(got), [50 / total, 20 / total, 5 / total, 2 / total], rtol=1e-4)


def test_averages_in_steps_equal_one(spark):
    rng = np.random.default_rng(1)
    encoded = spark.createDataFrame([(k, bytearray(rng.integers(0, 40, 400).astype("<u2").tobytes())) for k in range(40)], "uid long, symbols binary").repartition(20).cache()
    layout, share, fan = lm_score.Layout.of([b"%d" % i for i in range(40)]), lm_score.SHARE, lm_score.FAN
    found = []
    try:
        lm_score.SHARE = 900
        for lm_score.FAN in (2, 64):
            found.append(lm_score.train(encoded, layout, 1))
    finally:
        lm_score.SHARE, lm_score.FAN = share, fan
    assert (found[0].seen1 == found[1].seen1).all() and np.abs(found[0].w1 - found[1].w1).max() < 5e-3
