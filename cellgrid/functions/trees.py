"""Hierarchical, k-means, medoid and consensus clustering of few points, on one machine."""

from __future__ import annotations

import numpy as np


def pairwise(x: np.ndarray, metric: str = "euclidean", p: float = 2.0) -> np.ndarray:
    """Full matrix of distances between rows."""
    gap = lambda: np.abs(x[:, None, :] - x[None, :, :])
    if metric == "euclidean":
        return np.sqrt((gap() ** 2).sum(2))
    if metric == "manhattan":
        return gap().sum(2)
    if metric == "minkowski":
        return (gap() ** p).sum(2) ** (1 / p)
    if metric == "maximum":
        return gap().max(2)
    if metric == "canberra":
        size = np.abs(x[:, None, :] + x[None, :, :])
        used = (size > 0) | (gap() > 0)
        share = np.divide(gap(), size, out=np.zeros_like(size), where=size > 0).sum(2)
        n = used.sum(2)
        return np.divide(share * x.shape[1], n, out=np.zeros_like(share), where=n > 0)
    if metric == "binary":
        on = x != 0
        either = (on[:, None, :] | on[None, :, :]).sum(2)
        differ = (on[:, None, :] ^ on[None, :, :]).sum(2)
        return np.divide(differ, either, out=np.zeros(either.shape), where=either > 0)
    if metric in ("pearson", "spearman"):
        y = x.argsort(1).argsort(1).astype(float) if metric == "spearman" else x
        y = y - y.mean(1, keepdims=True)
        size = np.linalg.norm(y, axis=1, keepdims=True)
        y = np.divide(y, size, out=np.zeros_like(y), where=size > 0)
        return 1 - y @ y.T
    raise ValueError(f"unknown metric {metric}")


LINKAGES = ("complete", "single", "average", "mcquitty", "median", "centroid", "ward.D", "ward.D2")


def linkage_labels(d: np.ndarray, k: int, linkage: str = "complete") -> np.ndarray:
    """Labels from 0, by first appearance, of k clusters merged by the Lance-Williams recurrence."""
    k = max(1, min(k, len(d)))
    return linkage_levels(d, k, k, linkage)[0]


def linkage_levels(d: np.ndarray, least: int, most: int, linkage: str = "complete") -> list[np.ndarray]:
    """linkage_labels of least up to most clusters, from one run of merges."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    n, found = len(d), []
    squared = linkage in ("ward.D2",)
    d = (d**2 if squared else d).astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for k in range(n, least - 1, -1):
        if k <= most:
            found.append(by_appearance(label))
        if k == least:
            break
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        a, b, c, both = size[i], size[j], size, d[i, j]
        di, dj = d[i], d[j]
        if linkage == "complete":
            new = np.maximum(di, dj)
        elif linkage == "single":
            new = np.minimum(di, dj)
        elif linkage == "average":
            new = (a * di + b * dj) / (a + b)
        elif linkage == "mcquitty":
            new = (di + dj) / 2
        elif linkage == "median":
            new = (di + dj) / 2 - both / 4
        elif linkage == "centroid":
            new = (a * di + b * dj) / (a + b) - a * b * both / (a + b) ** 2
        else:
            new = ((a + c) * di + (b + c) * dj - c * both) / (a + b + c)
        alive[j] = False
        new = np.where(alive, new, np.inf)
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        label[label == label[j]] = label[i]
    return found[::-1]


def by_appearance(label: np.ndarray) -> np.ndarray:
    _, first, at = np.unique(label, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[at]


def kmeans_labels(x: np.ndarray, k: int, seed: int = 0, starts: int = 10, rounds: int = 100) -> np.ndarray:
    """Lloyd's iterations from k-means++ starts, the best of several."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(np.unique(x, axis=0))))
    best, least = None, np.inf
    for _ in range(starts):
        centers = [x[rng.integers(len(x))]]
        while len(centers) < k:
            d = np.min([((x - c) ** 2).sum(1) for c in centers], axis=0)
            centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
        c = np.array(centers, float)
        for _ in range(rounds):
            label = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        cost = ((x - c[label]) ** 2).sum()
        if cost < least:
            best, least = label, cost
    return by_appearance(best)


def pam_labels(d: np.ndarray, k: int, rounds: int = 100) -> np.ndarray:
    """Medoids chosen greedily, then swapped while that lowers the sum of distances."""
    n = len(d)
    k = max(1, min(k, n))
    medoids = [int(d.sum(1).argmin())]
    while len(medoids) < k:
        now = d[:, medoids].min(1)
        gain = np.maximum(now[:, None] - d, 0).sum(0)
        gain[medoids] = -1
        medoids.append(int(gain.argmax()))
    for _ in range(rounds):
        cost = d[:, medoids].min(1).sum()
        best = (cost - 1e-12, None)
        for i in range(k):
            rest = medoids[:i] + medoids[i + 1 :]
            base = d[:, rest].min(1) if rest else np.full(n, np.inf)
            costs = np.minimum(base[:, None], d).sum(0)
            j = int(costs.argmin())
            if costs[j] < best[0]:
                best = (costs[j], (i, j))
        if best[1] is None:
            break
        medoids[best[1][0]] = best[1][1]
    return by_appearance(d[:, medoids].argmin(1))


def consensus_labels(
    x: np.ndarray, k: int, reps: int = 100, share_rows: float = 0.9, share_cols: float = 1.0, algorithm: str = "hierarchical", metric: str = "euclidean", linkage: str = "average", seed: int = 0,
) -> np.ndarray:
    """Clusters of how often points were together in clusterings of random subsets."""
    n, p = x.shape
    k = min(k, n)
    rng = np.random.default_rng(seed)
    together, met = np.zeros((n, n)), np.zeros((n, n))
    for r in range(reps):
        rows = np.sort(rng.choice(n, max(min(n, k), int(share_rows * n)), replace=False))
        cols = np.sort(rng.choice(p, max(1, int(share_cols * p)), replace=False))
        part = x[np.ix_(rows, cols)]
        if algorithm == "kmeans":
            label = kmeans_labels(part, k, seed=seed + r, starts=1)
        else:
            d = pairwise(part, metric)
            label = pam_labels(d, k) if algorithm == "pam" else linkage_labels(d, k, linkage)
        same = label[:, None] == label[None, :]
        together[np.ix_(rows, rows)] += same
        met[np.ix_(rows, rows)] += 1
    agree = np.divide(together, met, out=np.zeros_like(met), where=met > 0)
    np.fill_diagonal(agree, 1)
    return linkage_labels(1 - agree, k, "average")


def elbow(sse: np.ndarray) -> int:
    """How many clusters: where two lines through the smoothed curve of errors meet best; sse[0] is of one cluster."""
    s = np.asarray(sse, float).copy()
    for i in range(1, len(s) - 1):
        s[i] = 0.8 * s[i] + 0.1 * s[i - 1] + 0.1 * s[i + 1]
    best, least = 1, np.inf
    for i in range(2, len(s)):
        miss = 0.0
        for part in (np.arange(i - 1), np.arange(i - 1, len(s))):
            fit = np.polyfit(part, s[part], 1) if len(part) > 1 else np.array([0.0, s[part[0]]])
            miss += np.abs(np.polyval(fit, part) - s[part]).sum()
        if miss < least:
            best, least = i, miss
    return best


def within_squares(x: np.ndarray, label: np.ndarray) -> float:
    return float(sum(((x[label == g] - x[label == g].mean(0)) ** 2).sum() for g in np.unique(label)))
