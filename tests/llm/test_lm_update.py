"""A step of the language model is the plain gradient step, and reads each parameter row that a batch uses once."""

import numpy as np

from lithic.llm import lm_score


class Counted(np.ndarray):
    """Parameters that count how many of their rows are read."""

    read = 0

    def take(self, rows, axis):
        Counted.read += len(rows)
        return np.asarray(self).take(rows, axis)


def plain_step(weights, seen, rows, off, hit, rate):
    z = weights[rows].astype(float).sum(1) + off
    g = np.exp(z - z.max(1, keepdims=True))
    g /= g.sum(1, keepdims=True)
    g[np.arange(len(g)), hit] -= 1
    total, times = np.zeros(weights.shape), np.bincount(rows.ravel(), minlength=len(weights))
    np.add.at(total, rows.ravel(), np.repeat(g, rows.shape[1], 0))
    seen, n = seen + times, np.maximum(times, 1)
    return weights - rate * total / (np.sqrt(np.maximum(seen, 1)) * np.sqrt(n))[:, None], seen


def test_step_is_plain_and_reads_rows_once():
    rng = np.random.default_rng(11)
    words = 300
    layout = lm_score.Layout.of([b"%d" % i for i in range(words)], np.arange(words, 0, -1.0), np.ones(lm_score.BUCKETS))
    s = np.minimum(rng.zipf(1.3, 6_000) - 1, words - 1)
    rows, symbols = lm_score.contexts(s), s
    model = lm_score.Model(layout)
    for at in range(0, len(s), lm_score.BATCH):
        r, y = rows[at : at + lm_score.BATCH], symbols[at : at + lm_score.BATCH]
        c = layout.cls[y]
        q = lm_score.word_rows(r, c)
        base = np.asarray(model.w1)
        want1 = plain_step(base, model.seen1, r, 0, c, lm_score.RATE)
        want2 = plain_step(np.asarray(model.w2), model.seen2, q, layout.slot_off[c], layout.slot[y], lm_score.RATE)
        model.w1, model.w2, Counted.read = base.view(Counted), np.asarray(model.w2).view(Counted), 0
        model.update(r, y)
        assert Counted.read == len(np.unique(r)) + len(np.unique(q))
        for (w, seen), got, got_seen in ((want1, model.w1, model.seen1), (want2, model.w2, model.seen2)):
            assert np.allclose(np.asarray(got), w, rtol=1e-5, atol=1e-4) and (got_seen == seen).all()
    assert np.diff(model.seen1.nonzero()[0]).min() == 1 and model.seen1.max() > lm_score.LAYERS
