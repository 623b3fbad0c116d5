"""The label model of toxicity: labels aren't votes, and votes outweigh wrong labels."""

from __future__ import annotations

import numpy as np

from fleetlens.llm import toxicity as T


def test_equal_votes_have_equal_posteriors_whatever_the_label():
    rng = np.random.default_rng(0)
    truth = (rng.random(4000) < 0.2).astype(float)
    fires = np.column_stack([np.where(truth == 1, rng.random(4000) < 0.6, rng.random(4000) < 0.02) for _ in range(6)]).astype(float)
    wrong = rng.random(4000) < 0.1
    y = np.where(wrong, 1 - truth, truth)
    post, rates, groups = T.label_model(fires, y)
    by_votes = {}
    for v, p in zip(map(tuple, fires), post, strict=True):
        assert abs(by_votes.setdefault(v, p) - p) < 1e-12
    said = post >= 0.5
    assert (said == (truth == 1)).mean() > 0.97 > (y == truth).mean()
    assert rates.shape == (2, 6) and np.abs(rates[1] - 0.6).max() < 0.1 and np.abs(rates[0] - 0.02).max() < 0.03
    assert (groups == 1).all()


def test_copies_of_a_voter_share_its_evidence():
    rng = np.random.default_rng(1)
    truth = (rng.random(3000) < 0.3).astype(float)
    vote = lambda: np.where(truth == 1, rng.random(3000) < 0.7, rng.random(3000) < 0.1).astype(float)
    a, b, c = vote(), vote(), vote()
    _, _, groups = T.label_model(np.column_stack([a, a, a, b, c]), truth)
    assert list(groups) == [3, 3, 3, 1, 1]


def test_silence_sparse_and_dense_votes():
    counts = np.array([[0.0, 0.0], [1.0, 0.0], [2.0, 3.0], [0.0, 0.0]])
    assert T.votes_of(counts, np.array([100.0, 5000.0, 50.0, 0.0])).tolist() == [[0, 0, 1, 1, 0], [1, 0, 0, 1, 0], [1, 1, 0, 0, 1], [0, 0, 1, 1, 0]]


def test_constant_labels_give_finite_posteriors():
    votes = T.votes_of(np.zeros((5, 2)), np.ones(5))
    for y in (np.zeros(5), np.ones(5)):
        assert np.isfinite(T.label_model(votes, y)[0]).all()
