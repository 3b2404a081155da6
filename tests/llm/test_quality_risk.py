"""The first step of the quality network against the numerical gradient of its risk."""

from __future__ import annotations

import numpy as np
import pytest

from tracehound.llm import quality as Q


def start(positive, unlabelled, seed):
    """Weights and first batches as ``train`` draws them."""
    r = np.random.default_rng(seed)
    width = positive.shape[1]
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    w1, w2 = r.normal(0, 1 / np.sqrt(width), (width, Q.HIDDEN)), r.normal(0, 0.3, Q.HIDDEN)
    scaled = [np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled)]
    return np.concatenate([w1.ravel(), np.zeros(Q.HIDDEN), w2, [0.0]]), [x[r.integers(0, len(x), Q.BATCH)] for x in scaled]


def risks(weights, xp, xu, prior):
    """(positive part, negative part) of the unbiased risk under the logistic loss."""
    a = xp.shape[1] * Q.HIDDEN
    w1, b1, w2, b2 = weights[:a].reshape(-1, Q.HIDDEN), weights[a : a + Q.HIDDEN], weights[a + Q.HIDDEN : -1], weights[-1]
    gp, gu = (np.tanh(x @ w1 + b1) @ w2 + b2 for x in (xp, xu))
    loss = lambda z: np.log1p(np.exp(-z)).mean()
    return prior * loss(gp), loss(-gu) - prior * loss(-gp)


@pytest.mark.parametrize("prior,below", [(0.3, False), (0.6, False), (3.0, True)])
def test_a_step_descends_the_risk_and_climbs_its_negative_part_below_zero(prior, below):
    r = np.random.default_rng(2)
    positive, unlabelled = r.normal(1, 1, (50, 6)), r.normal(0, 1, (90, 6))
    weights, (xp, xu) = start(positive, unlabelled, 5)
    assert (risks(weights, xp, xu, prior)[1] < 0) == below

    def aim(w):
        pos, neg = risks(w, xp, xu, prior)
        return -neg if below else pos + neg

    grad = np.array([(aim(weights + e) - aim(weights - e)) / 2e-5 for e in np.eye(len(weights)) * 1e-5])
    grad[: 6 * Q.HIDDEN] += 1e-4 * weights[: 6 * Q.HIDDEN]  # weight decay
    m = Q.train(positive, unlabelled, prior, seed=5, steps=1)
    moved = np.concatenate([m.w1.ravel(), m.b1, m.w2, [m.b2]]) - weights
    clear = np.abs(grad) > 1e-5
    # the first step of Adam has the gradient's sign and one length
    assert clear.mean() > 0.9
    assert np.allclose(moved[clear], -0.001 * np.sign(grad[clear]), rtol=0.01)
