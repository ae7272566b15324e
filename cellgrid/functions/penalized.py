"""Elastic nets by coordinate descent: linear, logistic, multinomial and Cox models of samples' features."""

from __future__ import annotations

import numpy as np

FAMILIES = {"linear": "gaussian", "two-class": "binomial", "multiclass": "multinomial", "survival": "cox"}


def _descend(x: np.ndarray, z: np.ndarray, w: np.ndarray, beta: np.ndarray, b0: float, lam: float, mix: float, intercept: bool, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Minimises half the weighted mean square of z - x beta plus the penalty; w adds up to 1 (or a curvature)."""
    # Few columns: everything but the coefficients is summed up once.
    if len(x) > x.shape[1]:
        return _descend_sums(*_sums(x, z, w), beta, b0, lam, mix, intercept, rounds)
    r = z - x @ beta - b0
    curve = (w[:, None] * x * x).sum(0)
    total = w.sum()
    for _ in range(rounds):
        most = 0.0
        for j in range(x.shape[1]):
            if curve[j] <= 0:
                continue
            old = beta[j]
            g = (w * x[:, j]) @ r + curve[j] * old
            new = np.sign(g) * max(abs(g) - lam * mix, 0) / (curve[j] + lam * (1 - mix))
            if new != old:
                r -= x[:, j] * (new - old)
                beta[j] = new
                most = max(most, abs(new - old) * np.sqrt(curve[j]))
        if intercept and total > 0:
            step = (w @ r) / total
            b0 += step
            r -= step
            most = max(most, abs(step))
        if most < 1e-9:
            break
    return beta, b0


def _sums(x: np.ndarray, z: np.ndarray, w: np.ndarray, rows: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Weighted sums of products: of columns, of columns and z, of columns, of z, of weights."""
    p = x.shape[1]
    gram, with_z = np.zeros((p, p)), np.zeros(p)
    for i in range(0, len(x), rows):
        xw = x[i : i + rows] * w[i : i + rows, None]
        gram += xw.T @ x[i : i + rows]
        with_z += xw.T @ z[i : i + rows]
    return gram, with_z, x.T @ w, float(w @ z), float(w.sum())


def _descend_sums(gram: np.ndarray, with_z: np.ndarray, sums: np.ndarray, of_z: float, total: float, beta: np.ndarray, b0: float, lam: float, mix: float, intercept: bool, rounds: int) -> tuple[np.ndarray, float]:
    curve = np.diag(gram)
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(curve > 0):
            old = beta[j]
            g = with_z[j] - gram[j] @ beta - sums[j] * b0 + curve[j] * old
            new = np.sign(g) * max(abs(g) - lam * mix, 0) / (curve[j] + lam * (1 - mix))
            beta[j] = new
            most = max(most, abs(new - old) * np.sqrt(curve[j]))
        if intercept and total > 0:
            step = (of_z - sums @ beta) / total - b0
            b0 += step
            most = max(most, abs(step))
        if most < 1e-9:
            break
    return beta, b0


def fit_gaussian(x: np.ndarray, y: np.ndarray, lam: float, mix: float) -> tuple[np.ndarray, float]:
    return _descend(x, y, np.full(len(y), 1 / len(y)), np.zeros(x.shape[1]), float(y.mean()), lam, mix, True)


def fit_binomial(x: np.ndarray, y: np.ndarray, lam: float, mix: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    beta, n = np.zeros(x.shape[1]), len(y)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    b0 = float(np.log(share / (1 - share)))
    for _ in range(rounds):
        eta = np.clip(x @ beta + b0, -30, 30)
        mu = 1 / (1 + np.exp(-eta))
        w = np.maximum(mu * (1 - mu), 1e-5)
        new, c = _descend(x, eta + (y - mu) / w, w / n, beta.copy(), b0, lam, mix, True, 50)
        done = max(np.abs(new - beta).max(initial=0), abs(c - b0)) < 1e-7
        beta, b0 = np.clip(new, -50, 50), float(np.clip(c, -50, 50))
        if done:
            break
    return beta, b0


def fit_multinomial(x: np.ndarray, y: np.ndarray, classes: int, lam: float, mix: float, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    n = len(y)
    beta, b0 = np.zeros((classes, x.shape[1])), np.log(np.maximum(np.bincount(y, minlength=classes), 0.5) / n)
    for _ in range(rounds):
        last = beta.copy()
        for k in range(classes):
            eta = np.clip(x @ beta.T + b0, -30, 30)
            p = np.exp(eta - eta.max(1, keepdims=True))
            p = (p / p.sum(1, keepdims=True))[:, k]
            w = np.maximum(p * (1 - p), 1e-5)
            beta[k], b0[k] = _descend(x, eta[:, k] + ((y == k) - p) / w, w / n, beta[k], b0[k], lam, mix, True, 20)
        if np.abs(beta - last).max(initial=0) < 1e-6:
            break
    return beta, b0 - b0.mean()


def fit_cox(x: np.ndarray, time: np.ndarray, event: np.ndarray, lam: float, mix: float, rounds: int = 50) -> np.ndarray:
    """Breslow's partial likelihood."""
    n = len(time)
    beta = np.zeros(x.shape[1])
    order = np.argsort(time, kind="stable")
    x, time, event = x[order], time[order], event[order].astype(float)
    first = np.searchsorted(time, time)
    last = np.searchsorted(time, time, side="right") - 1
    for _ in range(rounds):
        eta = np.clip(x @ beta, -30, 30)
        e = np.exp(eta)
        risk = np.cumsum(e[::-1])[::-1][first]
        a = np.cumsum(event / risk)[last]
        b = np.cumsum(event / risk**2)[last]
        grad = event - e * a
        w = np.maximum(e * a - e**2 * b, 1e-6)
        new, _ = _descend(x, eta + grad / w, w / n, beta.copy(), 0.0, lam, mix, False, 50)
        new = np.clip(new, -50, 50)
        done = np.abs(new - beta).max(initial=0) < 1e-7
        beta = new
        if done:
            break
    return beta


def breslow(risk: np.ndarray, time: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Event times and the baseline's cumulative hazard at them; risk is exp(x beta)."""
    order = np.argsort(time, kind="stable")
    ordered, later = time[order], np.cumsum(risk[order][::-1])[::-1]
    at, place = np.unique(time[event.astype(bool)], return_inverse=True)
    died = np.bincount(place, event[event.astype(bool)], len(at))
    return at, np.cumsum(died / later[np.searchsorted(ordered, at)]) if len(at) else np.empty(0)


def partial_likelihood(eta: np.ndarray, time: np.ndarray, event: np.ndarray) -> float:
    order = np.argsort(time, kind="stable")
    eta, time, event = eta[order] - eta.max(), time[order], event[order]
    later = np.cumsum(np.exp(eta)[::-1])[::-1]
    on = np.flatnonzero(event)
    return float((eta[on] - np.log(later[np.searchsorted(time, time[on])])).sum())


def below(values: np.ndarray, prefix: np.ndarray, bound: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """How many of the first `prefix` values (from 0, whole) are less than `bound`, for each of these pairs; with weights, their sum.

    Bit by bit from the highest, values with a 0 go before those with a 1, in their order (a wavelet matrix).
    """
    weight = np.ones(len(values)) if weight is None else weight
    low, high, out = np.zeros(len(prefix), np.int64), prefix.astype(np.int64), np.zeros(len(prefix))
    for b in range(int(max(values.max(initial=0), bound.max(initial=0))).bit_length() - 1, -1, -1):
        one = (values >> b) & 1 == 1
        zeros = np.concatenate(([0], np.cumsum(~one)))
        total = np.concatenate(([0.0], np.cumsum(np.where(one, 0, weight))))
        up = (bound >> b) & 1 == 1
        out += np.where(up, total[high] - total[low], 0)
        low, high = (np.where(up, zeros[-1] + x - zeros[x], zeros[x]) for x in (low, high))
        order = np.concatenate((np.flatnonzero(~one), np.flatnonzero(one)))
        values, weight = values[order], weight[order]
    return out


def concordance(eta: np.ndarray, time: np.ndarray, event: np.ndarray) -> float:
    """The share of pairs, one of them known to live longer, in which the other has the higher eta; ties count half."""
    dies = event.astype(bool)
    # At one time those who live on come after those who die.
    place = 2 * np.unique(time, return_inverse=True)[1] + ~dies
    order = np.argsort(-place, kind="stable")
    place, dies, rank = -place[order], dies[order], np.unique(eta, return_inverse=True)[1][order]
    longer = np.searchsorted(place, place[dies])
    good = below(rank, longer, rank[dies]) + below(rank, longer, rank[dies] + 1)
    return float(good.sum() / 2 / longer.sum()) if longer.sum() else np.nan


def auc(score: np.ndarray, truth: np.ndarray) -> float:
    """Area under the ROC curve by ranks; NaN with one class."""
    n1 = truth.sum()
    n0 = len(truth) - n1
    if n1 == 0 or n0 == 0:
        return np.nan
    values, at, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[at]
    return float((rank[truth.astype(bool)].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def hand_till(p: np.ndarray, y: np.ndarray) -> float:
    """Mean area over pairs of classes."""
    classes = np.unique(y)
    areas = []
    for i in classes:
        for j in classes:
            if i < j:
                on = (y == i) | (y == j)
                areas.append((auc(p[on, i], y[on] == i) + auc(p[on, j], y[on] == j)) / 2)
    return float(np.mean(areas)) if areas else np.nan
