"""Regression solvers for tables that have already been summed up: least squares, GLMs, mixed and penalised models."""

from __future__ import annotations

import math

import numpy as np

from .special import chi2_tail, f_tail, normal_two_sided, t_two_sided


def ols(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> dict[str, np.ndarray | float]:
    w = np.ones(len(y)) if w is None else w
    xw = x * w[:, None]
    inverse = np.linalg.pinv(x.T @ xw)
    beta = inverse @ (xw.T @ y)
    rest = y - x @ beta
    df = len(y) - np.linalg.matrix_rank(x)
    s2 = float((w * rest**2).sum() / df) if df > 0 else math.nan
    se = np.sqrt(np.maximum(np.diag(inverse) * s2, 0))
    t = np.divide(beta, se, out=np.full_like(beta, np.nan), where=se > 0)
    return {"beta": beta, "se": se, "df": df, "s2": s2, "stat": t, "p": np.array([t_two_sided(v, df) if df > 0 else math.nan for v in t]), "inverse": inverse}


def binomial_glm(x: np.ndarray, y: np.ndarray, total: np.ndarray, rounds: int = 50, offset: np.ndarray | None = None) -> dict[str, np.ndarray | float]:
    """Logistic regression of shares y of totals, by iterated weighted least squares."""
    offset = np.zeros(len(y)) if offset is None else offset
    beta = np.zeros(x.shape[1])
    mu = (y * total + 0.5) / (total + 1)
    eta = np.log(mu / (1 - mu))
    for _ in range(rounds):
        w = np.maximum(total * mu * (1 - mu), 1e-12)
        z = eta - offset + (y - mu) / np.maximum(mu * (1 - mu), 1e-12)
        xw = x * w[:, None]
        new = np.linalg.pinv(x.T @ xw) @ (xw.T @ z)
        eta = np.clip(x @ new + offset, -30, 30)
        mu = 1 / (1 + np.exp(-eta))
        done = np.allclose(new, beta, atol=1e-10)
        beta = new
        if done:
            break
    w = total * mu * (1 - mu)
    inverse = np.linalg.pinv(x.T @ (x * w[:, None]))
    se = np.sqrt(np.maximum(np.diag(inverse), 0))
    z = np.divide(beta, se, out=np.full_like(beta, np.nan), where=se > 0)
    return {"beta": beta, "se": se, "stat": z, "p": np.atleast_1d(normal_two_sided(z)), "inverse": inverse, "mu": mu}


class _Crossed:
    """Z'WZ + ridge for the indicators Z of grouping factors, the ridge one number for each: solved without a matrix of samples.

    The factor with the most levels is a diagonal; the others are solved in what is left of them beside it.
    """

    def __init__(self, groups: list[np.ndarray]) -> None:
        codes = [np.unique(g, return_inverse=True)[1] for g in groups]
        self.sizes = [int(c.max()) + 1 if len(c) else 0 for c in codes]
        self.most = [int(np.bincount(c).max(initial=1)) for c in codes]
        ends = np.cumsum([0, *self.sizes])
        self.n_levels = int(ends[-1])
        self.first = int(np.argmax(self.sizes))
        self.big, self.n_big = codes[self.first], self.sizes[self.first]
        others = [k for k in range(len(codes)) if k != self.first]
        self.rest = [codes[k] + sum(self.sizes[j] for j in others[:i]) for i, k in enumerate(others)]
        self.n_rest = sum(self.sizes[k] for k in others)
        self.others = others
        # Where the levels of the factors, in their given order, stand: those of the largest first.
        self.order = np.concatenate([np.arange(ends[k], ends[k + 1]) for k in [self.first, *others]])

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Z'v, by levels in the order of the factors."""
        out = np.empty((self.n_levels, *v.shape[1:]))
        flat = v.reshape(len(v), -1)
        for j in range(flat.shape[1]):
            got = [np.bincount(self.big, flat[:, j], self.n_big)]
            if self.rest:
                got.append(sum(np.bincount(c, flat[:, j], self.n_rest) for c in self.rest))
            out.reshape(self.n_levels, -1)[self.order, j] = np.concatenate(got)
        return out

    def spread(self, u: np.ndarray) -> np.ndarray:
        """Zu, for each sample."""
        u = u[self.order]
        return u[self.big] + sum(u[self.n_big + c] for c in self.rest)

    def prepare(self, w: np.ndarray, ridge: np.ndarray) -> None:
        """ridge: a number for each factor."""
        mass = np.bincount(self.big, w, self.n_big)
        self.d = mass + ridge[self.first]
        # The logarithm of the determinant over that of the ridge alone.
        self.log_ratio = float(np.log(np.abs(1 + mass / ridge[self.first])).sum())
        if self.rest:
            own = np.repeat(ridge[self.others], [self.sizes[k] for k in self.others])
            self.b = np.zeros((self.n_big, self.n_rest))
            c = np.diag(own.astype(float))
            for x in self.rest:
                np.add.at(self.b, (self.big, x), w)
                for y in self.rest:
                    np.add.at(c, (x, y), w)
            self.schur = c - self.b.T @ (self.b / self.d[:, None])
            self.log_ratio += float(np.linalg.slogdet(self.schur)[1] - np.log(np.abs(own)).sum())

    def solve(self, m: np.ndarray) -> np.ndarray:
        m = m[self.order]
        scale = self.d.reshape(-1, *[1] * (m.ndim - 1))
        top, out = m[: self.n_big], np.empty_like(m)
        if self.rest:
            low = np.linalg.solve(self.schur, m[self.n_big :] - self.b.T @ (top / scale))
            out[self.order] = np.concatenate(((top - self.b @ low) / scale, low))
        else:
            out[self.order] = top / scale
        return out


def _golden(f, lo: float, hi: float, rounds: int = 60) -> float:
    r = (math.sqrt(5) - 1) / 2
    a, b = hi - r * (hi - lo), lo + r * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa < fb:
            hi, b, fb = b, a, fa
            a = hi - r * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + r * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def lmm(x: np.ndarray, y: np.ndarray, groups: list[np.ndarray]) -> dict[str, np.ndarray | float]:
    """Random intercepts by restricted maximum likelihood, one variance ratio for each factor; Satterthwaite degrees of freedom."""
    n, p = x.shape
    z, ones = _Crossed(groups), np.ones(n)
    zx, zy = z.sums(x), z.sums(y)

    def solved(th: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """X'V^-1X, the coefficients, r'V^-1r and log |V|, where V is th[0] I plus th[k] for two samples of one level of factor k."""
        ratio = th[1:] / th[0]
        z.prepare(ones, 1 / np.where(np.abs(ratio) < 1e-14, 1e-14, ratio))
        xtx = (x.T @ x - zx.T @ z.solve(zx)) / th[0]
        beta = np.linalg.pinv(xtx) @ ((x.T @ y - zx.T @ z.solve(zy)) / th[0])
        r = y - x @ beta
        zr = z.sums(r)
        return xtx, beta, float(r @ r - zr @ z.solve(zr)) / th[0], n * math.log(th[0]) + z.log_ratio

    def profile(logs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        xtx, beta, square, size = solved(np.concatenate(([1.0], np.exp(logs))))
        s2 = max(square / max(1, n - p), 1e-300)
        return (n - p) * math.log(s2) + size + np.linalg.slogdet(xtx)[1], beta, np.linalg.pinv(xtx), s2

    logs = np.full(len(groups), -1.0)
    for _ in range(6):  # one ratio after the other
        for k in range(len(logs)):
            logs[k] = _golden(lambda t, k=k: profile(np.where(np.arange(len(logs)) == k, t, logs))[0], -18, 8)
        if len(logs) == 1:
            break
    _, beta, inverse, s2 = profile(logs)
    se = np.sqrt(np.maximum(np.diag(inverse) * s2, 0))

    # Satterthwaite: twice the squared variance over the variance of the variance, from the Hessian in (s2, ratios * s2).
    theta = np.concatenate(([s2], s2 * np.exp(logs)))

    def deviance(th: np.ndarray) -> float:
        xtx, _, square, size = solved(th)
        return size + np.linalg.slogdet(xtx)[1] + square

    def variance(th: np.ndarray) -> np.ndarray:
        return np.diag(np.linalg.pinv(solved(th)[0]))

    m = len(theta)
    # Steps so large that they stand out of rounding where a factor explains nothing, so small that V stays a variance below that.
    h = np.maximum(theta * 1e-3, 1e-3 * max(s2, 1e-12) / np.array([1.0, *[z.most[k] for k in range(m - 1)]]))
    hess, grad = np.zeros((m, m)), np.zeros((m, p))
    for i in range(m):
        ei = np.eye(m)[i] * h[i]
        grad[i] = (variance(theta + ei) - variance(theta - ei)) / (2 * h[i])
        for j in range(i + 1):
            ej = np.eye(m)[j] * h[j]
            hess[i, j] = hess[j, i] = (deviance(theta + ei + ej) - deviance(theta + ei - ej) - deviance(theta - ei + ej) + deviance(theta - ei - ej)) / (4 * h[i] * h[j])
    cov = 2 * np.linalg.pinv(hess)
    spread = np.einsum("ip,ij,jp->p", grad, cov, grad)
    df = np.where(spread > 0, 2 * (se**4) / np.maximum(spread, 1e-300), n - p)
    df = np.clip(df, 1, n - p if n > p else 1)
    t = np.divide(beta, se, out=np.full_like(beta, np.nan), where=se > 0)
    return {"beta": beta, "se": se, "df": df, "stat": t, "p": np.atleast_1d(t_two_sided(t, df)), "s2": s2, "ratios": np.exp(logs)}


def glmm(x: np.ndarray, y: np.ndarray, total: np.ndarray, groups: list[np.ndarray]) -> dict[str, np.ndarray | float]:
    """Binomial model with random intercepts, by the Laplace approximation; Wald z."""
    z, p = _Crossed(groups), x.shape[1]

    def mode(logs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        ridge = np.exp(-np.asarray(logs))
        each = np.repeat(ridge, z.sizes)
        b, u = np.zeros(p), np.zeros(z.n_levels)

        def weights() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            eta = np.clip(x @ b + z.spread(u), -30, 30)
            mu = 1 / (1 + np.exp(-eta))
            w = np.maximum(total * mu * (1 - mu), 1e-10)
            z.prepare(w, ridge)
            return eta, mu, w

        def left(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """X'WX less what the levels explain, inverted; Z'WX; the levels' solution of it."""
            zx = z.sums(x * w[:, None])
            by = z.solve(zx)
            return np.linalg.pinv(x.T @ (x * w[:, None]) - zx.T @ by), zx, by

        for _ in range(60):
            eta, mu, w = weights()
            inverse, zx, by = left(w)
            rest = total * (y - mu)
            of_u = z.sums(rest) - each * u
            step = inverse @ (x.T @ rest - by.T @ of_u)
            step_u = z.solve(of_u - zx @ step)
            b, u = b + np.clip(step, -5, 5), u + np.clip(step_u, -5, 5)
            if max(np.abs(step).max(), np.abs(step_u).max()) < 1e-9:
                break
        eta, mu, w = weights()
        like = (total * (y * eta - np.log1p(np.exp(eta)))).sum()
        dev = -2 * like + (each * u**2).sum() + z.log_ratio
        return float(dev), b, left(w)[0]

    logs = np.full(len(groups), -2.0)
    for _ in range(4):
        for k in range(len(logs)):
            logs[k] = _golden(lambda t, k=k: mode(np.where(np.arange(len(logs)) == k, t, logs))[0], -14, 5, 40)
        if len(logs) == 1:
            break
    _, b, inverse = mode(logs)
    beta, se = b, np.sqrt(np.maximum(np.diag(inverse), 0))
    stat = np.divide(beta, se, out=np.full(p, np.nan), where=se > 0)
    return {"beta": beta, "se": se, "stat": stat, "p": np.atleast_1d(normal_two_sided(stat)), "variances": np.exp(logs)}


def _trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 8).any():
        small = x < 8
        out[small] += 1 / x[small] ** 2
        x[small] += 1
    i = 1 / x
    return out + i + i**2 / 2 + i**3 / 6 - i**5 / 30 + i**7 / 42


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 8).any():
        small = x < 8
        out[small] -= 1 / x[small]
        x[small] += 1
    i2 = 1 / x**2
    return out + np.log(x) - 1 / (2 * x) - i2 * (1 / 12 - i2 * (1 / 120 - i2 / 252))


def _trigamma_inverse(y: float) -> float:
    lo, hi = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if float(_trigamma(np.array([mid]))[0]) > y else (lo, mid)
    return math.sqrt(lo * hi)


def moderated(s2: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, float]:
    """Variances drawn to a common prior by empirical Bayes, and the prior's degrees of freedom."""
    good = (s2 > 0) & (df > 0)
    if good.sum() < 2:
        return s2, 0.0
    z = np.log(s2[good])
    e = z - _digamma(df[good] / 2) + np.log(df[good] / 2)
    extra = e.var(ddof=1) - _trigamma(df[good] / 2).mean()
    if extra > 0:
        d0 = 2 * _trigamma_inverse(extra)
        prior = math.exp(e.mean() + float(_digamma(np.array([d0 / 2]))[0]) - math.log(d0 / 2))
    else:
        d0, prior = math.inf, math.exp(e.mean())
    if math.isinf(d0):
        return np.full_like(s2, prior), d0
    return (d0 * prior + df * s2) / (d0 + df), d0


def limma(values: np.ndarray, x: np.ndarray, contrasts: list[np.ndarray], weights: np.ndarray | None = None) -> list[dict[str, np.ndarray]]:
    """Moderated tests of each row of values (features x samples) for each contrast matrix (one column: t, more: F)."""
    fits = [ols(x[ok], y[ok], None if weights is None else weights[i][ok]) for i, y in enumerate(values) if (ok := ~np.isnan(y)) is not None]
    df = np.array([f["df"] for f in fits], float)
    s2 = np.array([f["s2"] for f in fits], float)
    post, d0 = moderated(np.nan_to_num(s2), df)
    out = []
    for c in contrasts:
        effect = np.array([c.T @ f["beta"] for f in fits])
        total = np.minimum(df + d0, df.sum() if np.isfinite(df.sum()) else np.inf)
        if c.shape[1] == 1:
            var = np.array([float((c.T @ f["inverse"] @ c)[0, 0]) for f in fits]) * post
            stat = np.divide(effect[:, 0], np.sqrt(var), out=np.full(len(fits), np.nan), where=var > 0)
            p = t_two_sided(stat, total)
        else:
            stat = np.array([float(e @ np.linalg.pinv(c.T @ f["inverse"] @ c) @ e) / c.shape[1] for e, f in zip(effect, fits, strict=True)]) / post
            p = f_tail(stat, float(c.shape[1]), total)
        out.append({"effect": effect[:, 0], "stat": stat, "p": np.atleast_1d(p)})
    return out


def lowess(x: np.ndarray, y: np.ndarray, share: float = 0.5, rounds: int = 3) -> np.ndarray:
    """Locally weighted straight lines through (x, y), x ascending: tricube weights over a share of the points, then bisquare ones against outliers."""
    n = len(x)
    k = min(n, max(2, int(share * n + 1e-10)))
    robust, fitted = np.ones(n), y.astype(float).copy()
    far = np.sort(np.abs(x[:, None] - x[None]), axis=1)[:, k - 1]
    for _ in range(rounds + 1):
        for i in range(n):
            gap = np.abs(x - x[i])
            h = max(far[i], 1e-12)
            w = np.where(gap <= 0.001 * h, 1.0, np.where(gap < 0.999 * h, (1 - (gap / h) ** 3) ** 3, 0.0)) * robust
            if w.sum() <= 0:
                continue
            w = w / w.sum()
            middle = (w * x).sum()
            spread = (w * (x - middle) ** 2).sum()
            slope = (w * (x - middle) * y).sum() / spread if spread > (0.001 * (x[-1] - x[0])) ** 2 else 0.0
            fitted[i] = (w * y).sum() + slope * (x[i] - middle)
        off = np.abs(y - fitted)
        scale = 6 * np.median(off)
        if scale < 1e-7 * off.mean() or scale == 0:
            break
        robust = np.where(off <= 0.001 * scale, 1.0, np.where(off < 0.999 * scale, (1 - (off / scale) ** 2) ** 2, 0.0))
    return fitted


def voom(counts: np.ndarray, totals: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log counts per million and precision weights from the trend of their spread."""
    y = np.log2((counts + 0.5) / (totals + 1) * 1e6)
    fits = [ols(x, r) for r in y]
    level = y.mean(1) + np.mean(np.log2(totals + 1)) - math.log2(1e6)
    spread = np.sqrt(np.sqrt(np.maximum([f["s2"] for f in fits], 1e-12)))
    order = np.argsort(level, kind="stable")
    if len(level) > 2:
        smooth = lowess(level[order], spread[order])
        trend = lambda v: np.maximum(np.interp(v, level[order], smooth), 1e-3)
    else:
        trend = lambda v: np.full_like(v, max(spread.mean(), 1e-3))
    fitted = np.array([x @ f["beta"] for f in fits]) + np.log2(totals + 1)[None] - math.log2(1e6)
    return y, 1 / trend(fitted) ** 4


def negative_binomial(counts: np.ndarray, totals: np.ndarray, x: np.ndarray, contrasts: list[np.ndarray], prior_df: float = 10.0) -> list[dict[str, np.ndarray]]:
    """Likelihood ratio tests with a dispersion for each row, log totals as offset.

    A row's dispersion maximises its adjusted profile likelihood plus that of all rows on average, which
    counts as prior_df degrees of freedom: rows with few samples are drawn to what all have in common.
    """
    offset = np.log(np.maximum(totals, 1))

    def fit(y: np.ndarray, d: np.ndarray, phi: float) -> tuple[np.ndarray, float]:
        b = np.linalg.pinv(d) @ (np.log(y + 0.5) - offset)
        for _ in range(50):
            mu = np.exp(np.clip(d @ b + offset, -30, 30))
            w = mu / (1 + phi * mu)
            step = np.linalg.pinv(d.T @ (d * w[:, None])) @ (d.T @ ((y - mu) / (1 + phi * mu)))
            b = b + np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-9:
                break
        mu = np.exp(np.clip(d @ b + offset, -30, 30))
        r = 1 / phi
        like = sum(math.lgamma(v + r) - math.lgamma(r) for v in y) + (y * np.log(mu / (mu + r)) - r * np.log1p(mu / r)).sum()
        return b, float(like)

    def profile(y: np.ndarray, log_phi: float) -> float:
        phi = math.exp(log_phi)
        b, like = fit(y, x, phi)
        mu = np.exp(np.clip(x @ b + offset, -30, 30))
        return like - 0.5 * np.linalg.slogdet(x.T @ (x * (mu / (1 + phi * mu))[:, None]) + 1e-9 * np.eye(x.shape[1]))[1]

    grid = np.linspace(-9, 2, 34)
    own = np.array([[profile(y, g) for g in grid] for y in counts]).reshape(len(counts), len(grid))
    prior = prior_df / max(1, x.shape[0] - x.shape[1])
    phis = [math.exp(_peak(grid, row + prior * own.mean(0))) for row in own]
    out = []
    for c in contrasts:
        # The null model's columns span what the contrast leaves free.
        u = np.linalg.svd(c, full_matrices=True)[0]
        null = x @ u[:, c.shape[1] :]
        rows = [(fit(y, x, phi), fit(y, null, phi)) for y, phi in zip(counts, phis, strict=True)]
        stat = np.maximum([2 * (a[1] - b[1]) for a, b in rows], 0)
        out.append({"effect": np.array([float((c.T @ a[0])[0]) for a, _ in rows]) / math.log(2), "stat": stat, "p": np.atleast_1d(chi2_tail(stat, float(c.shape[1])))})
    return out


def _peak(at: np.ndarray, value: np.ndarray) -> float:
    """Where a curve given at equal steps is highest: the top of the parabola through the highest point and its neighbours."""
    i = int(np.argmax(value))
    if i in (0, len(at) - 1):
        return float(at[i])
    low, mid, high = value[i - 1 : i + 2]
    bend = low - 2 * mid + high
    return float(at[i] + (0.5 * (low - high) / bend if bend < 0 else 0.0) * (at[1] - at[0]))


def design(levels: list[tuple[str, np.ndarray]]) -> tuple[np.ndarray, list[str]]:
    """Intercept and a column for each further level of each factor, in sorted order."""
    n = len(levels[0][1])
    cols, names = [np.ones(n)], ["(Intercept)"]
    for name, values in levels:
        if np.issubdtype(np.asarray(values).dtype, np.number):
            cols.append(np.asarray(values, float))
            names.append(name)
        else:
            for level in sorted(set(values))[1:]:
                cols.append((np.asarray(values) == level).astype(float))
                names.append(f"{name}{level}")
    return np.column_stack(cols), names
