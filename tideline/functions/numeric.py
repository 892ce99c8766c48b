"""Numeric routines without a relational form: plain numpy, applied to one series or one query's hits at a time."""

from __future__ import annotations

import math

import numpy as np


def plug_in(x: np.ndarray) -> float:
    """The direct plug-in bandwidth of Sheather and Jones: the curvature of the density is estimated with bandwidths for its fourth and sixth derivatives.

    All pairs of values are summed, a row at a time. Silverman's rule where the values are few or mostly alike.
    """
    n = len(x)
    spread = min(v for v in (x.std(ddof=1), np.subtract(*np.percentile(x, [75, 25])) / 1.349) if v > 0) if n > 2 and x.std() > 0 else 0.0
    if not spread:
        return bandwidth(x)

    def curvature(h: float, order: int) -> float:
        total = 0.0
        for v in x:
            d = ((x - v) / h) ** 2
            poly = d * d - 6 * d + 3 if order == 4 else d**3 - 15 * d * d + 45 * d - 15
            total += float((np.exp(-0.5 * d) * poly).sum())
        return total / (n * (n - 1) * h ** (order + 1) * math.sqrt(2 * math.pi))

    sixth = -curvature(1.23 * spread * n ** (-1 / 9), 6)
    if sixth <= 0:
        return bandwidth(x)
    fourth = curvature((2.394 / (n * sixth)) ** (1 / 7), 4)
    return (1 / (2 * math.sqrt(math.pi) * n * fourth)) ** 0.2 if fourth > 0 else bandwidth(x)


def bandwidth(x: np.ndarray) -> float:
    """Silverman's rule of thumb."""
    spread = x.std(ddof=1) if len(x) > 1 else 0.0
    q = np.subtract(*np.percentile(x, [75, 25])) / 1.34 if len(x) > 1 else 0.0
    low = min(v for v in (spread, q) if v > 0) if max(spread, q) > 0 else 1.0
    return 0.9 * low * len(x) ** -0.2


def density(x: np.ndarray, weights: np.ndarray | None = None, h: float | None = None, points: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Weighted Gaussian kernel density on a regular grid that reaches three bandwidths beyond the data."""
    w = np.full(len(x), 1 / len(x)) if weights is None else weights / weights.sum()
    h = h or bandwidth(x)
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, points)
    y = (w * np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2)).sum(1) / (h * math.sqrt(2 * math.pi))
    return grid, y


def nearest(grid: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The density at the grid point nearest to each value."""
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    return y[np.clip(np.rint((at - grid[0]) / step), 0, len(grid) - 1).astype(int)]


def extrema(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of local maxima and minima: where the sign of the difference turns."""
    turn = np.diff(np.sign(np.diff(y)))
    return np.flatnonzero(turn == -2) + 1, np.flatnonzero(turn == 2) + 1


def changepoints(x: np.ndarray, most: int = 5) -> list[int]:
    """Changes of the mean by binary segmentation; a split must lower the squared error by 2 ln n times the variance."""
    penalty, found, parts = 2 * math.log(max(len(x), 2)) * x.var(), [], [(0, len(x))]

    def gain(a: int, b: int) -> tuple[float, int]:
        s, n = x[a:b], b - a
        if n < 2:
            return 0.0, a
        left = np.cumsum(s)[:-1]
        k = np.arange(1, n)
        g = left**2 / k + (s.sum() - left) ** 2 / (n - k) - s.sum() ** 2 / n
        return float(g.max()), a + 1 + int(g.argmax())

    while len(found) < most:
        (best, at), part = max(((gain(*p), p) for p in parts), key=lambda z: z[0][0])
        if best <= penalty or best <= 0:
            break
        found.append(at)
        parts.remove(part)
        parts += [(part[0], at), (at, part[1])]
    return sorted(found)


def bursts(x: np.ndarray, total: np.ndarray, s: float = 2.0, gamma: float = 1.0) -> np.ndarray:
    """State of each bin (1: burst) of the two-state automaton over x of total, by Viterbi search."""
    total = np.maximum(total, 1e-9)
    p0 = min(max(x.sum() / total.sum(), 1e-9), 0.9999)
    p = np.array([p0, min(p0 * s, 0.9999)])
    cost = -(x[:, None] * np.log(p) + np.maximum(total - x, 0)[:, None] * np.log(1 - p))
    up = gamma * math.log(max(len(x), 2))
    score, back = np.array([cost[0, 0], cost[0, 1] + up]), []
    for c in cost[1:]:
        to = np.array([[score[0], score[1]], [score[0] + up, score[1]]])
        back.append(to.argmin(1))
        score = to.min(1) + c
    state = [int(score.argmin())]
    for b in reversed(back):
        state.append(int(b[state[-1]]))
    return np.array(state[::-1])


def multimodality(x: np.ndarray, modes: int = 1, draws: int = 200, seed: int = 1) -> float:
    """Silverman's test: the share of smoothed bootstrap samples with more than `modes` modes at the critical bandwidth."""
    if len(x) < 3 or x.std() == 0:
        return 1.0

    def count(v: np.ndarray, h: float) -> int:
        return len(extrema(density(v, h=h, points=256)[1])[0])

    low, high = 1e-3 * x.std(), 4 * x.std()
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (low, mid) if count(x, mid) <= modes else (mid, high)
    rng, h = np.random.default_rng(seed), high
    shrink = 1 / math.sqrt(1 + h * h / x.var())
    more = 0
    for _ in range(draws):
        y = rng.choice(x, len(x))
        y = y.mean() + (y - y.mean() + h * rng.standard_normal(len(x))) * shrink
        more += count(y, h) > modes
    return more / draws


def mixture(points: np.ndarray, most: int = 4, steps: int = 100) -> np.ndarray:
    """Labels of a Gaussian mixture with diagonal variances; the number of parts by the Bayesian criterion. Starts from quantiles of the first axis."""
    n, d = points.shape
    x = (points - points.mean(0)) / np.where(points.std(0) > 0, points.std(0), 1)
    best, labels = np.inf, np.zeros(n, int)
    for k in range(1, min(most, n) + 1):
        order = np.argsort(x[:, 0], kind="stable")
        r = np.zeros((n, k))
        r[order, np.arange(n) * k // n] = 1
        for _ in range(steps):
            w = r.sum(0) + 1e-9
            m = r.T @ x / w[:, None]
            v = np.stack([(r[:, [j]] * (x - m[j]) ** 2).sum(0) / w[j] for j in range(k)]) + 1e-3
            lp = np.log(w / n) - 0.5 * (((x[:, None] - m) ** 2 / v) + np.log(2 * np.pi * v)).sum(2)
            top = lp.max(1, keepdims=True)
            ll = float((top[:, 0] + np.log(np.exp(lp - top).sum(1))).sum())
            r = np.exp(lp - top)
            r /= r.sum(1, keepdims=True)
        bic = -2 * ll + (2 * k * d + k - 1) * math.log(n)
        if bic < best - 1e-9:
            best, labels = bic, r.argmax(1)
    return labels


def against_background(counts: np.ndarray, background: np.ndarray, weight: float = 0.5, most: int = 50, change: float = 1e-6) -> np.ndarray:
    """Term probabilities of a bin's own part of the mixture weight * own + (1 - weight) * background, by expectation maximisation from a uniform start."""
    p = np.full(len(counts), 1 / len(counts))
    last = -np.inf
    for _ in range(most):
        mixed = weight * p + (1 - weight) * background
        own = counts * weight * p / mixed
        p = own / own.sum()
        ll = float((counts * np.log(weight * p + (1 - weight) * background + 1e-300)).sum())
        if abs(ll - last) < change * abs(ll):
            break
        last = ll
    return p


def student_below(t: float, df: float) -> float:
    """P(T <= t), by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d or 1e-30)
        h = d
        for m in range(1, 200):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or 1e-30)
                c = (1 + num / c) or 1e-30
                h *= d * c
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0
    beta = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return 1 - beta / 2 if t > 0 else beta / 2


def chi_square_p(x: float) -> float:
    """Of one degree of freedom."""
    return math.erfc(math.sqrt(max(x, 0) / 2))
