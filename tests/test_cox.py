"""The regression and its concordance against sums over every risk set, and on as many rows as a large table has."""

import signal

import numpy as np
import pytest

from quillmark.operators import models as O


def brute_cox(start, stop, event, x):
    """Newton steps by the textbook, time by time."""
    z, b = x - x.mean(axis=0), np.zeros(x.shape[1])
    for _ in range(50):
        w, grad, info, value = np.exp(z @ b), np.zeros(len(b)), np.zeros((len(b),) * 2), 0.0
        for s in np.unique(stop[event == 1]):
            risk, dead = (start < s) & (stop >= s), (stop == s) & (event == 1)
            for k in range(n := int(dead.sum())):
                u = w * (risk - k / n * dead)
                a0, a1 = u.sum(), u @ z
                info += (z * u[:, None]).T @ z / a0 - np.outer(a1, a1) / a0**2
                grad -= a1 / a0
                value -= np.log(a0)
            grad += z[dead].sum(axis=0)
            value += (z[dead] @ b).sum()
        step = np.linalg.solve(info, grad)
        b = b + step
        if abs(step).max() < 1e-8:
            return b, np.sqrt(np.diag(np.linalg.inv(info))), value
    raise AssertionError("no convergence")


def brute_concordance(start, stop, event, score):
    right = n = 0
    for i in np.flatnonzero(event == 1):
        for j in range(len(stop)):
            if start[j] < stop[i] <= stop[j] and not (stop[j] == stop[i] and event[j] == 1):
                right += (score[j] < score[i]) + 0.5 * (score[j] == score[i])
                n += 1
    return right / n if n else 0.5


@pytest.mark.parametrize("seed", range(12))
def test_cox_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = 60
    start = rng.integers(0, 12, n).astype(float)
    stop = start + rng.integers(1 if seed % 2 else 0, 9, n)
    event = (rng.random(n) < 0.6).astype(int)
    if seed % 2 == 0:  # also rows that are never at risk
        event[start >= stop] = 0
    x = np.stack([rng.integers(0, 2, n).astype(float), rng.normal(size=n).round(1)], axis=1)
    f = O.cox(start, stop, event, x)
    b, se, value = brute_cox(start, stop, event, x)
    assert np.allclose(f["coef"], b, atol=1e-9) and np.allclose(f["se"], se, atol=1e-8) and abs(f["log_likelihood"] - value) < 1e-8
    score = x[:, 0] * 2 - x[:, 1].round()
    assert O.concordance(start, stop, event, score) == pytest.approx(brute_concordance(start, stop, event, score), abs=1e-12)


def test_cox_odd_groups():
    one = np.ones(3)
    f = O.cox(np.zeros(3), one, np.zeros(3, int), np.arange(6.0).reshape(3, 2))
    assert f["coef"].tolist() == [0, 0] and f["concordance"] == 0.5
    f = O.cox(np.zeros(3), np.array([1.0, 2, 3]), np.array([1, 1, 1]), np.stack([one, one], axis=1))
    assert f["coef"].tolist() == [0, 0] and np.isnan(f["se"]).all() and f["concordance"] == 0.5


def test_cox_of_many_times():
    """100,000 rows of as many times: work goes with the rows and not with rows times events."""
    rng = np.random.default_rng(3)
    n = 100_000
    x = rng.normal(size=(n, 2))
    start = rng.random(n)
    stop = start + rng.exponential(np.exp(-(x @ [0.5, -0.25])))
    event = (rng.random(n) < 0.7).astype(int)

    def late(*_):
        raise TimeoutError("over 60 s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(60)
    try:
        f = O.cox(start, stop, event, x)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
    assert np.allclose(f["coef"], [0.5, -0.25], atol=0.02) and 0.6 < f["concordance"] < 0.75
