"""Statistics finished on the driver from small aggregates, or run in a group by numpy."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

import numpy as np

_Z = NormalDist()


# distributions: continued fraction of the incomplete beta function


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def t_cdf(t: float, df: float) -> float:
    tail = beta_cdf(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: int) -> float:
    """Upper tail by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


# resampling


def percentile_ci(values: Sequence[float], statistic: Callable = np.mean, n: int = 2000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    x, rng = np.asarray(values, float), np.random.default_rng(seed)
    got = np.array([statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n)])
    a = (1 - confidence) / 2
    return float(statistic(x)), *map(float, np.quantile(got, [a, 1 - a]))


def bca_ci(values: Sequence[float], statistic: Callable = np.mean, n: int = 2000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Percentile interval corrected for bias and, by the jackknife, for acceleration."""
    x, rng = np.asarray(values, float), np.random.default_rng(seed)
    point = float(statistic(x))
    got = np.array([statistic(x[rng.integers(0, len(x), len(x))]) for _ in range(n)])
    share = min(max(float((got < point).mean()), 1 / (n + 1)), n / (n + 1))
    z0 = _Z.inv_cdf(share)
    left = np.array([statistic(np.delete(x, i)) for i in range(len(x))])
    dev = left.mean() - left
    den = 6 * float((dev**2).sum()) ** 1.5
    acc = float((dev**3).sum()) / den if den else 0.0
    ends = []
    for p in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = z0 + _Z.inv_cdf(p)
        ends.append(float(np.quantile(got, _Z.cdf(z0 + z / (1 - acc * z)))))
    return point, ends[0], ends[1]


def cluster_ci(values: Sequence[float], clusters: Sequence, statistic: Callable = np.mean, n: int = 2000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Whole clusters are drawn."""
    x, c, rng = np.asarray(values, float), np.asarray(clusters), np.random.default_rng(seed)
    names = np.unique(c)
    own = [x[c == k] for k in names]
    got = np.array([statistic(np.concatenate([own[i] for i in rng.integers(0, len(names), len(names))])) for _ in range(n)])
    a = (1 - confidence) / 2
    return float(statistic(x)), *map(float, np.quantile(got, [a, 1 - a]))


def studentized_ci(values: Sequence[float], n: int = 2000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """Bootstrap-t interval of a mean."""
    x, rng = np.asarray(values, float), np.random.default_rng(seed)
    m, se = float(x.mean()), float(x.std(ddof=1)) / math.sqrt(len(x))
    draws = (x[rng.integers(0, len(x), len(x))] for _ in range(n))  # one at a time, whatever the group's size
    means, ses = np.array([(d.mean(), d.std(ddof=1) / math.sqrt(len(x))) for d in draws]).T
    t = (means - m) / np.where(ses > 0, ses, se or 1.0)
    a = (1 - confidence) / 2
    low, high = np.quantile(t, [a, 1 - a])
    return m, float(m - high * se), float(m - low * se)


def subsampling_ci(values: Sequence[float], n: int = 2000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    x, rng = np.asarray(values, float), np.random.default_rng(seed)
    b, m = max(2, math.isqrt(len(x))), float(x.mean())
    d = np.array([math.sqrt(b) * (x[rng.choice(len(x), b, replace=False)].mean() - m) for _ in range(n)])
    a = (1 - confidence) / 2
    low, high = np.quantile(d, [a, 1 - a]) / math.sqrt(len(x))
    return m, float(m - high), float(m - low)


def paired_permutation(a: Sequence[float], b: Sequence[float], n: int = 10_000, seed: int = 0) -> float:
    d, rng = np.asarray(a, float) - np.asarray(b, float), np.random.default_rng(seed)
    seen = abs(d.mean())
    hits = sum(int((np.abs((rng.choice([-1.0, 1.0], (500, len(d))) * d).mean(axis=1)) >= seen - 1e-12).sum()) for _ in range(n // 500))
    return (1 + hits) / (1 + n // 500 * 500)


def average_ranks(x: Sequence[float]) -> np.ndarray:
    x = np.asarray(x, float)
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[at]


def wilcoxon(a: Sequence[float], b: Sequence[float]) -> tuple[float, float]:
    """Signed-rank statistic and two-sided p: exact up to 25 differences without ties, else normal with tie correction."""
    d = np.asarray(a, float) - np.asarray(b, float)
    d = d[d != 0]
    if not len(d):
        return 0.0, 1.0
    r = average_ranks(np.abs(d))
    w = float(min(r[d > 0].sum(), r[d < 0].sum()))
    n = len(d)
    if n <= 25 and len(set(np.abs(d))) == n:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return w, min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    ties = np.unique(np.abs(d), return_counts=True)[1]
    var = n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48
    return w, min(1.0, 2 * _Z.cdf((w - n * (n + 1) / 4) / math.sqrt(var))) if var > 0 else 1.0


def mcnemar(b: int, c: int) -> float:
    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def friedman(scores: np.ndarray) -> tuple[float, float]:
    """scores: blocks by treatments; tie-corrected statistic and p."""
    n, k = scores.shape
    r = np.array([average_ranks(row) for row in scores])
    ties = sum(float((t**3 - t).sum()) for t in (np.unique(row, return_counts=True)[1] for row in scores))
    c = 1 - ties / (n * (k**3 - k))
    if c == 0:
        return 0.0, 1.0
    q = (12 / (n * k * (k + 1)) * float((r.sum(axis=0) ** 2).sum()) - 3 * n * (k + 1)) / c
    return q, chi2_sf(q, k - 1)


# regression, isotonic fits, Bayes, power


def isotonic(y: Sequence[float], w: Sequence[float] | None = None, rising: bool = True) -> list[float]:
    """Weighted least squares under order, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, m in zip(y, w or [1.0] * len(y)):
        blocks.append([v if rising else -v, m, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            v2, m2, n2 = blocks.pop()
            v1, m1, n1 = blocks.pop()
            blocks.append([(v1 * m1 + v2 * m2) / (m1 + m2), m1 + m2, n1 + n2])
    out = [b[0] for b in blocks for _ in range(int(b[2]))]
    return out if rising else [-v for v in out]


def quantile_line(x: Sequence[float], y: Sequence[float], tau: float) -> tuple[float, float]:
    """Intercept and slope of the line of least tilted loss: some optimum passes through two points."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    best = None
    for i in range(len(x)):
        for j in range(i):
            if x[i] == x[j]:
                continue
            s = (y[i] - y[j]) / (x[i] - x[j])
            a = y[i] - s * x[i]
            r = y - a - s * x
            loss = float(np.maximum(tau * r, (tau - 1) * r).sum())
            if best is None or loss < best[0] - 1e-12:
                best = (loss, a, s)
    if best is None:
        raise ValueError("the covariate does not vary")
    return float(best[1]), float(best[2])


def logit(design: np.ndarray, y: np.ndarray, weights: np.ndarray, clusters: np.ndarray | None = None, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and p values (cluster-robust if clusters are given) of a logistic model on grouped rows."""
    b = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-design @ b))
        h = design.T @ (design * (weights * p * (1 - p))[:, None])
        step = np.linalg.solve(h, design.T @ (weights * (y - p)))
        b = b + step
        if np.abs(step).max() < 1e-10:
            break
    inv = np.linalg.inv(h)
    cov = inv
    if clusters is not None:
        score = design * (weights * (y - p))[:, None]
        names = np.unique(clusters)
        g = np.array([score[clusters == c].sum(axis=0) for c in names])
        cov = inv @ (g.T @ g) @ inv * len(names) / max(1, len(names) - 1)
    z = b / np.sqrt(np.diag(cov))
    return b, np.array([2 * (1 - _Z.cdf(abs(v))) for v in z])


def posterior(hits: int, n: int, a: float = 0.5, b: float = 0.5, level: float = 0.95) -> tuple[float, float, float]:
    a, b = a + hits, b + n - hits
    return a / (a + b), beta_quantile((1 - level) / 2, a, b), beta_quantile((1 + level) / 2, a, b)


def log_bayes_factor(hits: int, n: int, p0: float = 0.5, a: float = 1.0, b: float = 1.0) -> float:
    ln_beta = lambda u, v: math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v)
    null = (hits * math.log(p0) if hits else 0) + ((n - hits) * math.log1p(-p0) if n > hits else 0)
    return ln_beta(hits + a, n - hits + b) - ln_beta(a, b) - null


def bayes_factor(hits: int, n: int, p0: float = 0.5, a: float = 1.0, b: float = 1.0) -> float:
    return math.exp(log_bayes_factor(hits, n, p0, a, b))


def two_proportion_power(p1: float, p2: float, n: int, alpha: float = 0.05) -> float:
    if p1 == p2:
        return alpha
    se = math.sqrt(p1 * (1 - p1) / n + p2 * (1 - p2) / n)
    pooled = (p1 + p2) / 2
    se0 = math.sqrt(2 * pooled * (1 - pooled) / n)
    if se == 0:
        return 1.0
    return _Z.cdf((abs(p1 - p2) - _Z.inv_cdf(1 - alpha / 2) * se0) / se)


def required_sample(p1: float, p2: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """Rows a group; the variance is pooled under equality, as in two_proportion_power."""
    if p1 == p2 or not 0 < power < 1:
        raise ValueError("the shares must differ and the power lie in (0, 1)")
    pooled = (p1 + p2) / 2
    spread = _Z.inv_cdf(1 - alpha / 2) * math.sqrt(2 * pooled * (1 - pooled)) + _Z.inv_cdf(power) * math.sqrt(p1 * (1 - p1) + p2 * (1 - p2))
    return math.ceil((spread / abs(p1 - p2)) ** 2)


def least_effect(p: float, n: int, alpha: float = 0.05, power: float = 0.8) -> float:
    """The smallest difference from share p that n rows a group show, by p's own variance."""
    return (_Z.inv_cdf(1 - alpha / 2) + _Z.inv_cdf(power)) * math.sqrt(2 * p * (1 - p) / n)


def chance_above(a: tuple[int, int], b: tuple[int, int], n: int = 200_000, seed: int = 0) -> float:
    """How often a draw from the posterior of share a = (hits, rows) exceeds one from that of share b."""
    draw = lambda x, s: np.random.RandomState(s).beta(0.5 + x[0], 0.5 + x[1] - x[0], n)
    return float(np.mean(draw(a, seed) > draw(b, seed + 1)))


def aligned_rank_f(y: np.ndarray) -> float:
    """F of the first factor for y of shape (levels, levels, repeats): other effects are taken out before ranking."""
    cell, a, b, m = y.mean(axis=2), y.mean(axis=(1, 2)), y.mean(axis=(0, 2)), y.mean()
    aligned = np.round(y - cell[:, :, None] + (a - m)[:, None, None], 12)
    r = average_ranks(aligned.reshape(-1)).reshape(y.shape)
    na, nb, n = y.shape
    rc = r.mean(axis=2)
    ss = nb * n * float(((r.mean(axis=(1, 2)) - r.mean()) ** 2).sum()) / (na - 1)
    err = float(((r - rc[:, :, None]) ** 2).sum()) / (na * nb * (n - 1))
    return math.inf if err == 0 else ss / err


def logistic_curve(x: Sequence[float], y: Sequence[float], steps: int = 200) -> tuple[float, float, float, float]:
    """Lower, upper, midpoint, rate of a logistic curve, by damped least squares."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    p = np.array([y.min(), y.max(), float(np.median(x)), -1.0 if y[0] > y[-1] else 1.0])
    model = lambda q: q[0] + (q[1] - q[0]) / (1 + np.exp(-np.clip(q[3] * (x - q[2]), -50, 50)))
    damp, loss = 1e-2, float(((model(p) - y) ** 2).sum())
    for _ in range(steps):
        j = np.array([(model(p + e) - model(p - e)) / 2e-6 for e in np.eye(4) * 1e-6]).T
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-9), j.T @ (y - model(p)))
        new = float(((model(p + step) - y) ** 2).sum())
        p, loss, damp = (p + step, new, damp / 3) if new < loss else (p, loss, damp * 4)
        if damp > 1e12:
            break
    return tuple(map(float, p))
