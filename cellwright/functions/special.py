"""Distribution functions from numpy and the standard library alone."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def _invert(cdf, p: float, lo: float, hi: float) -> float:
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def beta_quantile(p: float, a: float, b: float) -> float:
    return _invert(lambda x: beta_cdf(x, a, b), p, 0.0, 1.0)


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    if p < 0.5:
        return -t_quantile(1 - p, df)
    hi = 1.0
    while t_cdf(hi, df) < p:
        hi *= 2
    return _invert(lambda t: t_cdf(t, df), p, 0.0, hi)


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_cdf(x / 2, df / 2)


def binomial_cdf(k: int, n: int, p: float) -> float:
    return 1.0 if k >= n else 0.0 if k < 0 else 1 - beta_cdf(p, k + 1, n - k)


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    a = (1 - confidence) / 2
    return (beta_quantile(a, k, n - k + 1) if k else 0.0, beta_quantile(1 - a, k + 1, n - k) if k < n else 1.0)


def weibull_quantile(x: np.ndarray, p: float) -> float:
    """Type 6: position p (n + 1)."""
    return float(np.quantile(np.asarray(x, dtype=float), p, method="weibull"))


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(n)
    return (last - (n - 1) / 2)[at]


def mann_whitney(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """U of x and the two-sided p-value with ties and continuity corrected."""
    n, m = len(x), len(y)
    both = np.concatenate([x, y])
    u = average_ranks(both)[:n].sum() - n * (n + 1) / 2
    _, t = np.unique(both, return_counts=True)
    var = n * m / 12 * (n + m + 1 - (t**3 - t).sum() / ((n + m) * (n + m - 1)))
    z = (abs(u - n * m / 2) - 0.5) / math.sqrt(var) if var > 0 else 0.0
    return float(u), min(1.0, 2 * (1 - normal_cdf(max(z, 0.0))))


def welch(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """t, degrees of freedom, two-sided p."""
    a, b = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    t = (x.mean() - y.mean()) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (len(x) - 1) + b * b / (len(y) - 1))
    return float(t), float(df), 2 * (1 - t_cdf(abs(t), df))


def kruskal(groups: list[np.ndarray]) -> tuple[float, float]:
    both = np.concatenate(groups)
    r, n, at, h = average_ranks(both), len(both), 0, 0.0
    for g in groups:
        h += r[at : at + len(g)].sum() ** 2 / len(g)
        at += len(g)
    h = 12 / (n * (n + 1)) * h - 3 * (n + 1)
    _, t = np.unique(both, return_counts=True)
    h /= 1 - (t**3 - t).sum() / (n**3 - n)
    return float(h), chi2_sf(h, len(groups) - 1)


def ks_two_sample(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    x, y = np.sort(x), np.sort(y)
    both = np.concatenate([x, y])
    d = float(np.abs(np.searchsorted(x, both, side="right") / len(x) - np.searchsorted(y, both, side="right") / len(y)).max())
    n = math.sqrt(len(x) * len(y) / (len(x) + len(y)))
    s = (n + 0.12 + 0.11 / n) * d
    p = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * s * s) for k in range(1, 101))
    return d, min(1.0, max(0.0, p))


def lilliefors_fit(x: np.ndarray) -> tuple[float, float]:
    """Distance to the fitted normal, and the p-value of Dallal and Wilkinson (at most 0.1 is exact)."""
    x = np.sort(x)
    n = len(x)
    z = np.asarray([normal_cdf(v) for v in (x - x.mean()) / x.std(ddof=1)])
    d = float(max((np.arange(1, n + 1) / n - z).max(), (z - np.arange(n) / n).max()))
    k, m = (d, n) if n <= 100 else (d * (n / 100) ** 0.49, 100)
    p = math.exp(-7.01256 * k * k * (m + 2.78019) + 2.99587 * k * math.sqrt(m + 2.78019) - 0.122119 + 0.974598 / math.sqrt(m) + 1.67997 / m)
    return d, min(1.0, p)


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """Royston's approximation for 12 <= n <= 5000."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    m = np.asarray([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(mm)
    an = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
    an1 = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
    w = m / math.sqrt(phi)
    w[-1], w[-2], w[0], w[1] = an, an1, -an, -an1
    stat = float((w @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    ln = math.log(n)
    mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return stat, 1 - normal_cdf((math.log(1 - stat) - mu) / sigma)


def box_cox(x: np.ndarray, lam: float) -> np.ndarray:
    return np.log(x) if abs(lam) < 1e-12 else (x**lam - 1) / lam


def box_cox_loss(x: np.ndarray, lam: float) -> float:
    """Negative profile log-likelihood of an exponent, up to a constant."""
    with np.errstate(all="ignore"):
        var = float(box_cox(x, lam).var())
    return len(x) / 2 * math.log(var) - (lam - 1) * float(np.log(x).sum()) if var > 0 and math.isfinite(var) else math.inf


def _least(loss, lo: float, hi: float, width: float = 1e-9) -> float:
    """Golden-section search."""
    g = (math.sqrt(5) - 1) / 2
    while hi - lo > width:
        c, d = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, d) if loss(c) < loss(d) else (c, hi)
    return (lo + hi) / 2


def box_cox_lambda(x: np.ndarray, lo: float = -5.0, hi: float = 5.0) -> float:
    """Maximum-likelihood exponent."""
    return _least(lambda lam: box_cox_loss(x, lam), lo, hi)


def box_cox_lambda_on(x: np.ndarray, grid: np.ndarray) -> float:
    """The likeliest exponent of a grid."""
    return float(min(grid, key=lambda lam: box_cox_loss(x, float(lam))))


def shifted_box_cox(x: np.ndarray, gaps: tuple[float, float] = (0.01, 10.0), steps: int = 25) -> tuple[float, float, float]:
    """(origin, exponent, unit) of the likeliest Box-Cox scale of (x - origin) / unit; unit is the range.

    The origin lies between ``gaps`` ranges below the smallest value, as the likelihood has no bound at that value itself.  A grid of
    gaps, equal on a log scale, finds the valley, a golden-section search its floor.
    """
    unit = float(np.ptp(x))
    if not unit > 0:
        raise ValueError("values must differ")
    z = (np.asarray(x, dtype=float) - x.min()) / unit

    def loss(log_gap: float) -> float:
        y = z + math.exp(log_gap)
        return box_cox_loss(y, _least(lambda lam: box_cox_loss(y, lam), -5.0, 5.0, 1e-7))

    grid = np.linspace(math.log(gaps[0]), math.log(gaps[1]), steps)
    at = int(np.argmin([loss(v) for v in grid]))
    best = _least(loss, grid[max(0, at - 1)], grid[min(steps - 1, at + 1)], 1e-6)
    gap = math.exp(min((best, float(grid[at])), key=loss))
    return float(x.min()) - unit * gap, box_cox_lambda(z + gap), unit
