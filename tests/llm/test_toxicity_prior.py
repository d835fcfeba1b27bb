"""Probabilities of the toxicity model are those of all labelled rows, whatever share of them it learns from."""

import random

import numpy as np
import pytest

from graphspan.llm import toxicity

rng = random.Random(12)
WORDS = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in "nrst"]


def some(n, toxic):
    out = []
    for _ in range(n):
        w = rng.choices(WORDS, k=rng.randrange(4, 25))
        if toxic and rng.random() < 0.9:
            w[rng.randrange(len(w))] = "grubbel"
        if not toxic and rng.random() < 0.05:
            w[rng.randrange(len(w))] = "grubbel"
        out.append(" ".join(w))
    return out


def brute_calibration(logit, y, counts):
    """The same regression with every row repeated as often as it counts."""
    n = np.where(y > 0, counts[1] / y.sum(), counts[0] / (len(y) - y.sum())).astype(int)
    z, t = np.repeat(logit, n), np.repeat(y, n)
    target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * z + b)))
        w, r = p * (1 - p), p - target
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, [(r * z).sum() + 0.01 * (a - 1), r.sum() + 0.01 * b])
        a, b = a - step[0], b - step[1]
    return a, b


def test_calibration_counts_rows_that_are_not_there():
    r = np.random.default_rng(1)
    y = np.repeat([1.0, 0.0], [30, 40])
    logit = r.normal(size=70) + 2 * y
    counts = (400, 60)
    got = toxicity._calibrate(logit, y, np.where(y > 0, counts[1] / 30, counts[0] / 40))
    assert np.allclose(got, brute_calibration(logit, y, counts), atol=1e-6)


@pytest.mark.parametrize("mix", [(60, 240), (150, 150), (151, 150), (1500, 1500)])
def test_scores_do_not_follow_the_mix(mix):
    """100 toxic among 1000 rows in all, whatever the sample's mix: empty texts and clean ones stay below 0.5."""
    texts, labels = some(mix[0], True) + some(mix[1], False), [1] * mix[0] + [0] * mix[1]
    net = toxicity.fit(texts, labels, epochs=3, counts=(9 * mix[0], mix[0]))
    assert net.scores([""])[0] == pytest.approx(0.1)
    clean = net.scores(some(400, False))
    assert (clean >= 0.5).mean() <= 0.08
    assert abs(np.average(net.scores(texts), weights=np.where(np.array(labels) > 0, 1.0, 9 * mix[0] / mix[1])) - 0.1) < 0.02
    assert (net.scores(some(200, True)) > net.scores([""])[0]).mean() >= 0.8


def test_empty_texts_are_not_toxic():
    for counts in ((0, 10), (1, 99), None):
        assert toxicity.fit(["a b", "c d"], [1, 0], epochs=1, counts=counts).scores([""])[0] < 0.5
    assert toxicity.fit(["a"], [1], epochs=1).scores([""])[0] < 0.5
    assert toxicity.fit([], []).scores([""])[0] == 0
