"""Model fits on small, already aggregated curves; each group is one task."""

from __future__ import annotations

from math import erf, erfc, exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillmark.sources.session import ship


def saturating(t, k, r):
    return k * (1 - np.exp(-r * t))


def growth_richards(t, k, r, t0, nu):
    return k / (1 + nu * np.exp(-r * (t - t0))) ** (1 / nu)


def richards(t, k, r, t0, nu):
    """A Richards curve that begins at 0."""
    return growth_richards(t, k, r, t0, nu) - growth_richards(0.0, k, r, t0, nu)


def quadratic(t, a, b):
    return a * t + b * t * t


def power_law(t, a, b):
    return a * np.maximum(t, 1e-9) ** b


def logistic(t, k, r, t0):
    return k / (1 + np.exp(-r * (t - t0)))


#: Curve, starting values from the times and values to fit, and bounds of the parameters; without bounds they stay positive.
CURVES = {
    "saturating": (saturating, lambda t, v: (2 * v.max(), 1 / t.mean()), None),
    "richards": (richards, lambda t, v: (1.5 * v.max(), 4 / t.max(), t.mean(), 1.0), None),
    "quadratic": (quadratic, lambda t, v: (v.max() / t.max(), 0.1 * v.max() / t.max() ** 2), None),
    "power": (power_law, lambda t, v: (v.max() / t.max(), 1.0), None),
}
# Bounds of the growth curves, by the last value; a Richards curve passes at least through that.
GROWTH = {
    "power": (power_law, lambda t, v: (10.0, 1.5), None),
    "logistic": (logistic, lambda t, v: (1.5 * v[-1], 0.5, t[-1] / 2), lambda v: ((0.5 * v[-1], 0.01, 0.0), (5 * v[-1], 5.0, 50.0))),
    "richards": (growth_richards, lambda t, v: (1.5 * v[-1], 0.5, t[-1] / 2, 1.0), lambda v: ((v[-1], 0.01, 0.0, 0.1), (5 * v[-1], 5.0, 50.0, 20.0))),
}


def least_squares(curve, start, t: np.ndarray, v: np.ndarray, rounds: int = 200, bounds=None) -> tuple[np.ndarray, float]:
    """Levenberg-Marquardt on logs of the parameters, or on logits of their places between bounds; (parameters, mean squared error)."""
    if bounds is None:
        values = lambda q: np.exp(np.clip(q, -30, 30))
        p = np.log(np.maximum(np.array(start, float), 1e-9))
    else:
        low, high = (np.array(x, float) for x in bounds)
        values = lambda q: low + (high - low) / (1 + np.exp(-np.clip(q, -30, 30)))
        share = np.clip((np.array(start, float) - low) / (high - low), 1e-6, 1 - 1e-6)
        p = np.log(share / (1 - share))
    damp = 1e-2
    error = lambda q: curve(t, *values(q)) - v
    e = error(p)
    for _ in range(rounds):
        jac = np.stack([(error(p + h) - e) / 1e-6 for h in np.eye(len(p)) * 1e-6], axis=1)
        a, g = jac.T @ jac, jac.T @ e
        if not np.isfinite(a).all():
            break
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
        new = error(p + step)
        if np.isfinite(new).all() and new @ new < e @ e:
            gain = 1 - (new @ new) / max(e @ e, 1e-300)
            p, e, damp = p + step, new, max(damp / 3, 1e-9)
            if gain < 1e-10:
                break
        else:
            damp *= 4
            if damp > 1e9:
                break
    return values(p), float(e @ e / len(v))


def fit_curve(t: np.ndarray, v: np.ndarray, model: str = "auto", curves: dict = CURVES) -> tuple[str, np.ndarray, float]:
    """(model, parameters, BIC); auto takes the least BIC. Under three points, or where no fit is finite, a line through 0."""
    best = None
    for name, (curve, start, bounds) in curves.items() if len(t) >= 3 else ():
        if model in ("auto", name):
            with np.errstate(all="ignore"):
                p, mse = least_squares(curve, start(t, v), t, v, bounds=bounds and bounds(v))
            bic = len(t) * log(max(mse, 1e-300)) + len(p) * log(len(t)) if np.isfinite(mse) else float("inf")
            if np.isfinite(p).all() and bic < (best[2] if best else float("inf")):
                best = (name, p, bic)
    if best is None:
        return "power", np.array([float((t @ v) / max(t @ t, 1e-12)), 1.0]), float("nan")
    return best


def fitted(curve: DataFrame, group: str, t: str, v: str, model: str = "auto", growth: bool = False) -> DataFrame:
    """(group, model, parameters, bic) of each group's curve, which is given in points already summed up."""
    ship(curve.sparkSession)
    kind, curves = curve.schema[group].dataType.simpleString(), GROWTH if growth else CURVES

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g[g[t] > 0].sort_values(t) if growth else g.sort_values(t)
        name, p, bic = fit_curve(g[t].to_numpy(float), g[v].to_numpy(float), model, curves)
        return pd.DataFrame({group: [key[0]], "model": [name], "parameters": [p.tolist()], "bic": [bic]})

    return curve.select(group, t, v).groupBy(group).applyInPandas(run, f"{group} {kind}, model string, parameters array<double>, bic double")


def cox(start: np.ndarray, stop: np.ndarray, event: np.ndarray, x: np.ndarray, rounds: int = 50) -> dict[str, np.ndarray | float]:
    """Andersen-Gill regression with left truncation and Efron ties, by Newton steps.

    Columns without variance get coefficient 0. Sums over the rows at risk run
    back from the last time, so a step takes time with the rows.
    """
    live = x.std(axis=0) > 0
    z = (x - x.mean(axis=0))[:, live]
    b, info, value = np.zeros(z.shape[1]), np.zeros((z.shape[1],) * 2), 0.0
    dead = np.flatnonzero(event == 1)
    dead = dead[np.argsort(stop[dead], kind="stable")]
    times, first_dead, of, ties = np.unique(stop[dead], return_index=True, return_inverse=True, return_counts=True)
    begin, end = at_risk(start, stop, times)
    share = (np.arange(len(dead)) - first_dead[of]) / ties[of]  # of the dead at a time, those taken out before

    def left(values: np.ndarray) -> np.ndarray:
        """For each event the sum over those at risk, less the share of that over the dead of its time."""
        change = np.bincount(end, values, len(times) + 1) - np.bincount(begin, values, len(times) + 1)
        risk = np.cumsum(change[:0:-1])[::-1]
        return risk[of] - share * np.bincount(of, values[dead], len(times))[of]

    for _ in range(rounds):
        eta = z @ b
        w = np.exp(np.clip(eta, -50, 50))
        a0 = left(w)
        mean = [left(w * c) / a0 for c in z.T]
        grad = np.array([z[dead, i].sum() - m.sum() for i, m in enumerate(mean)])
        value = float(eta[dead].sum() - np.log(a0).sum())
        for i in range(len(b)):
            for j in range(i + 1):
                info[i, j] = info[j, i] = (left(w * z[:, i] * z[:, j]) / a0 - mean[i] * mean[j]).sum()
        step = np.linalg.lstsq(info, grad, rcond=None)[0]
        b = b + step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0)) if len(b) else np.zeros(0)
    full, full_se = np.zeros(x.shape[1]), np.full(x.shape[1], np.nan)
    full[live], full_se[live] = b, se
    stat = full / full_se
    p = np.array([2 * (1 - 0.5 * (1 + erf(abs(s) / sqrt(2)))) if s == s else np.nan for s in stat])
    score = np.zeros(len(x))
    for i, c in enumerate(full):  # column by column, so that equal rows have equal scores
        score += c * x[:, i]
    return {"coef": full, "hazard_ratio": np.exp(full), "se": full_se, "z": stat, "p": p, "log_likelihood": value, "concordance": concordance(start, stop, event, score)}


def at_risk(start: np.ndarray, stop: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the sorted times after each start, and the first after each stop; the times between them see the row at risk."""
    begin, end = np.searchsorted(times, start, "right"), np.searchsorted(times, stop, "right")
    return np.minimum(begin, end), end


def concordance(start: np.ndarray, stop: np.ndarray, event: np.ndarray, score: np.ndarray) -> float:
    """Of pairs of an event and another interval at risk then, the share with the higher score at the event."""
    dead = np.flatnonzero(event == 1)
    times, of = np.unique(stop[dead], return_inverse=True)
    begin, end = at_risk(start, stop, times)
    kinds, rank = np.unique(score, return_inverse=True)
    mine, width = rank[dead], len(kinds) + 1
    # those that began up to the time, less those that ended before it, less the dead of the time
    gone = dead[start[dead] < stop[dead]]
    together = np.sort(np.searchsorted(times, stop[gone]) * width + rank[gone])
    dead_below = lambda limit: np.searchsorted(together, of * width + limit)
    sides = [(np.sort(side), rank[np.argsort(side, kind="stable")]) for side in (begin, end)]
    seen = [np.searchsorted(side, of, "right") for side, _ in sides]

    def below(limit: np.ndarray) -> np.ndarray:
        came, went = (count_below(ranks, n, limit) for n, (_, ranks) in zip(seen, sides))
        return came - went - dead_below(limit) + dead_below(np.zeros_like(limit))

    right, up_to = below(mine), below(mine + 1)
    n = int((seen[0] - seen[1] - dead_below(np.full_like(mine, len(kinds))) + dead_below(np.zeros_like(mine))).sum())
    return (int(right.sum()) + 0.5 * int((up_to - right).sum())) / n if n else 0.5


def count_below(values: np.ndarray, n: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of the first n[i] values, whole numbers from 0, are below limit[i]; bit by bit, from the highest."""
    low, high, out = np.zeros_like(n), n, np.zeros(len(n), np.int64)
    for bit in reversed(range(int(max(values.max(initial=0), limit.max(initial=0))).bit_length())):
        one = values >> bit & 1 == 1
        ones = np.concatenate([[0], np.cumsum(one)])
        up, low1, high1 = limit >> bit & 1 == 1, ones[low], ones[high]
        zeros = len(values) - ones[-1]
        out += np.where(up, (high - high1) - (low - low1), 0)
        low, high = np.where(up, zeros + low1, low - low1), np.where(up, zeros + high1, high - high1)
        values = np.concatenate([values[~one], values[one]])
    return out


def chi_square_quantile(p: float, df: float) -> float:
    """By bisection on the regularised lower incomplete gamma function."""
    lo, hi = 0.0, max(20.0, 10 * df)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_lower(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


def gamma_lower(a: float, x: float) -> float:
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
        if k > a + 100_000:
            break
    return min(1.0, total * exp(-x + a * log(x) - lgamma(a)))


def poisson_interval(k: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact bounds of a Poisson mean after k events."""
    low = 0.0 if k == 0 else chi_square_quantile(alpha / 2, 2 * k) / 2
    return low, chi_square_quantile(1 - alpha / 2, 2 * (k + 1)) / 2


def count_fits(counts: dict[int, int]) -> dict[str, float]:
    """Poisson and negative binomial against a histogram of counts: dispersion test, likelihoods, BIC, expected zeros."""
    k, n = np.array(list(counts), float), np.array(list(counts.values()), float)
    total, first = n.sum(), float((k * n).sum())
    mean = first / total
    excess = total * float((k * k * n).sum()) - first * first
    var = excess / (total * total)
    if not mean:
        return {"mean": 0.0, "variance": 0.0}
    poisson = float((n * (k * log(mean) - mean - np.array([lgamma(x + 1) for x in k]))).sum())
    # of the dispersion test: the mean of ((y - m)^2 - y) / m against 0, by its deviation over the population
    aux = ((k - mean) ** 2 - k) / mean
    aux_mean = float((n * aux).sum() / total)
    aux_sd = sqrt(float((n * (aux - aux_mean) ** 2).sum() / total))
    out = {"mean": mean, "variance": var, "poisson": poisson, "poisson_bic": -2 * poisson + log(total), "alpha": aux_mean / mean, "poisson_zeros": total * exp(-mean)}
    if aux_sd > 1e-9:
        out["dispersion_t"] = aux_mean / (aux_sd / sqrt(total))
    if excess > total * first:
        r, p = mean**2 / (var - mean), mean / var
        nb = float((n * np.array([lgamma(x + r) - lgamma(r) - lgamma(x + 1) + r * log(p) + x * log(1 - p) for x in k])).sum())
        lrt = 2 * (nb - poisson)
        out |= {"r": r, "p": p, "nb": nb, "nb_bic": -2 * nb + 2 * log(total), "lrt": lrt, "lrt_p": erfc(sqrt(max(lrt, 0) / 2)), "nb_zeros": total * p**r}
    return out


def bootstrap_curve(delays: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], at: np.ndarray, times: int = 200, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the cumulative function at places, (times, how many) of events and of ends being drawn again independently.

    Counts are drawn for the distinct times, so work does not grow with the
    number of subjects. A drawn curve is joined by lines between its events.
    """
    rng, rows = np.random.default_rng(seed), []
    (t, d), (e, k) = ((x[0][np.argsort(x[0])], x[1][np.argsort(x[0])].astype(np.int64)) for x in (delays, ends))
    for _ in range(times):
        drawn, stay = (rng.multinomial(n.sum(), n / n.sum()) for n in (d, k))
        risk = np.concatenate([np.cumsum(stay[::-1])[::-1], [0]])[np.searchsorted(e, t, "left")]
        live = (drawn > 0) & (np.cumsum(risk == 0) == 0)
        curve = np.cumsum(drawn[live] / risk[live])
        rows.append(np.interp(at, np.concatenate([[0.0], t[live]]), np.concatenate([[0.0], curve])))
    return np.percentile(rows, 2.5, axis=0), np.percentile(rows, 97.5, axis=0)


def bootstrap_nb(counts: dict[int, int], times: int = 2000, seed: int = 42) -> dict[str, tuple[float, float]]:
    """Bounds of the negative binomial's mean and r over draws whose variance exceeds the mean, from a histogram of counts."""
    k, n = np.array(list(counts), float), np.array(list(counts.values()), np.int64)
    draws = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), times)
    m = draws @ k / n.sum()
    v = draws @ (k * k) / n.sum() - m * m
    over = (v > m + 1e-12) & (m > 0)
    if not over.any():
        return {"mean": (float("nan"),) * 2, "r": (float("nan"),) * 2}
    m, v = m[over], v[over]
    return {"mean": tuple(np.percentile(m, [2.5, 97.5])), "r": tuple(np.percentile(m**2 / (v - m), [2.5, 97.5]))}
