"""Distribution functions, with numpy arrays in and out or plain floats."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + part * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + part / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_cdf(x: float, a: float) -> float:
    """Lower regularised incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    return 1 - gamma_tail(x, a)


def gamma_tail(x: float, a: float) -> float:
    if x < a + 1:
        return 1 - gamma_cdf(x, a)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _elementwise(f):
    def wrapped(*args):
        arrays = np.broadcast_arrays(*[np.asarray(x, float) for x in args])
        flat = [math.nan if any(math.isnan(v) for v in row) else f(*row) for row in zip(*[x.ravel() for x in arrays], strict=True)]
        out = np.array(flat, float).reshape(arrays[0].shape)
        return float(out) if out.ndim == 0 else out

    return wrapped


def _t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return 2 * normal_tail(abs(t)) if math.isinf(df) else beta_cdf(df / (df + t * t), df / 2, 0.5)


def _t_quantile(p: float, df: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(400):
        mid = (lo + hi) / 2
        tail = _t_two_sided(mid, df) / 2
        lo, hi = (mid, hi) if (1 - tail if mid > 0 else tail) < p else (lo, mid)
    return (lo + hi) / 2


def _f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


t_two_sided = _elementwise(_t_two_sided)
t_quantile = _elementwise(_t_quantile)
f_tail = _elementwise(_f_tail)
chi2_tail = _elementwise(lambda x, k: 1.0 if x <= 0 else gamma_tail(x / 2, k / 2))
normal_two_sided = _elementwise(lambda z: 2 * normal_tail(abs(z)))


def benjamini_hochberg(p: np.ndarray) -> np.ndarray:
    """Adjusted p values; missing ones stay missing and do not count."""
    p = np.asarray(p, float)
    out = np.full(p.shape, np.nan)
    have = np.flatnonzero(~np.isnan(p))
    order = have[np.argsort(-p[have], kind="stable")]
    n = len(order)
    out[order] = np.minimum(1, np.minimum.accumulate(p[order] * n / np.arange(n, 0, -1)))
    return out
