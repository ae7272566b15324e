"""Dimensionality reduction."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..table import Selector, columns, is_numeric, q
from .neighbors import _vectors, find_knn

#: Bytes of the dense matrices of exact t-SNE, beyond which neighbours and a grid stand for them; entries that a layout works on at a time.
MAX_DENSE, CHUNK = 512 << 20, 1 << 20


class PcaFit:
    """Means, scales and loadings; applies as expressions."""

    def __init__(self, names: list[str], mean: np.ndarray, scale: np.ndarray, loadings: np.ndarray, variances: np.ndarray) -> None:
        self.names, self.mean, self.scale, self.loadings, self.variances = names, mean, scale, loadings, variances

    def column_names(self) -> list[str]:
        k = self.loadings.shape[1]
        width = len(str(k))
        return [f".pc{i + 1:0{width}d}" for i in range(k)]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for i, name in enumerate(self.column_names()):
            terms = [(q(c) - float(m)) * float(w / s) for c, m, s, w in zip(self.names, self.mean, self.scale, self.loadings[:, i], strict=True)]
            new[name] = sum(terms[1:], terms[0])
        return df.withColumns(new)


def fit_pca(df: DataFrame, cols: Selector = None, num_comp: int = 5, threshold: float | None = None, center: bool = True, scale: bool = True) -> PcaFit:
    """Principal components from one aggregation of means and covariances; constant columns go.

    Each component's largest loading is positive. threshold: as many components as explain that share.
    """
    names = columns(df, cols, is_numeric)
    x = [q(c).cast("double") for c in names]
    cells = {(i, j): F.covar_samp(x[i], x[j]) for i in range(len(x)) for j in range(i + 1)}
    got = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[v.alias(f"v{i}_{j}") for (i, j), v in cells.items()]).first()
    cov = np.zeros((len(x), len(x)))
    for i, j in cells:
        cov[i, j] = cov[j, i] = got[f"v{i}_{j}"] or 0.0
    mean = np.array([got[f"m{i}"] or 0.0 for i in range(len(x))])
    keep = np.flatnonzero(np.diag(cov) > 1e-12)
    cov, mean, names = cov[np.ix_(keep, keep)], mean[keep], [names[i] for i in keep]
    sd = np.sqrt(np.diag(cov)) if scale else np.ones(len(keep))
    value, vector = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(-value)
    value, vector = np.maximum(value[order], 0), vector[:, order]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(vector.shape[1])])
    k = int(np.searchsorted(np.cumsum(value) / value.sum(), threshold - 1e-12) + 1) if threshold is not None else num_comp
    k = min(k, len(value))
    return PcaFit(names, mean if center else np.zeros(len(keep)), sd, vector[:, :k], value)


def reduce_pca(df: DataFrame, cols: Selector = None, num_comp: int = 5, threshold: float | None = None, center: bool = True, scale: bool = True) -> DataFrame:
    return fit_pca(df, cols, num_comp, threshold, center, scale).transform(df)


def _points(df: DataFrame, names: list[str], id_col: str) -> tuple[np.ndarray, np.ndarray]:
    got = _vectors(df, names, id_col).select("id", "v").toArrow().to_pandas().sort_values("id")
    return got["id"].to_numpy(), np.array(got["v"].tolist(), float).reshape(len(got), -1)


def _neighbours(df: DataFrame, names: list[str], k: int, id_col: str, max_cells: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ascending, and for each the places among them of its k nearest cells and their distances."""
    ids = df.select(q(id_col).cast("long").alias("id")).toArrow().column("id").to_numpy()
    ids = np.sort(ids)
    if max_cells is not None and len(ids) > max_cells:
        raise ValueError(f"more than {max_cells} cells: downsample first")
    got = find_knn(df, names, k, id_col=id_col).select("cell_id", "neighbor_id", "rank", "distance").toArrow()
    cell, near, rank, gap = (got.column(c).to_numpy() for c in got.column_names)
    order = np.lexsort((rank, cell))
    k = len(order) // max(1, len(ids))
    return ids, np.searchsorted(ids, near[order]).reshape(len(ids), k), gap[order].reshape(len(ids), k)


def tsne(x: np.ndarray, dims: int = 2, perplexity: float = 30.0, rounds: int = 1000, seed: int = 0, rate: float | None = None) -> np.ndarray:
    """t-SNE with exact gradients."""
    n = len(x)
    if n < 3:
        return np.zeros((n, dims))
    perplexity = min(perplexity, (n - 1) / 3)
    d = np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0)
    lo, hi = np.full(n, 1e-20), np.full(n, 1e20)
    beta = np.ones(n) / max(d.mean(), 1e-12)
    np.fill_diagonal(d, np.inf)
    least = d.min(1, keepdims=True)
    for _ in range(100):
        p = np.exp(-(d - least) * beta[:, None])
        p /= p.sum(1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        high = h > np.log(perplexity)
        lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
        beta = np.where(hi > 1e19, beta * 2, np.where(lo < 1e-19, beta / 2, (lo + hi) / 2))
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y = np.random.default_rng(seed).normal(scale=1e-4, size=(n, dims))
    move, gain = np.zeros_like(y), np.ones_like(y)
    rate = rate or max(n / 48, 50)
    for step in range(rounds):
        k = 1 / (1 + np.maximum((y * y).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(k, 0)
        w = (p * (12 if step < 250 else 1) - np.maximum(k / k.sum(), 1e-12)) * k
        grad = 4 * (w.sum(1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(grad) == np.sign(move), gain * 0.8, gain + 0.2), 0.01)
        move = (0.5 if step < 250 else 0.8) * move - rate * gain * grad
        y = y + move
        y -= y.mean(0)
    return y


def tsne_of_neighbours(near: np.ndarray, dist: np.ndarray, dims: int = 2, perplexity: float = 30.0, rounds: int = 1000, seed: int = 0, rate: float | None = None) -> np.ndarray:
    """t-SNE in which cells attract their nearest ones only, and all repel each other through a grid (convolutions by fast Fourier transforms)."""
    n, k = near.shape
    perplexity = min(perplexity, k / 3)
    d = dist**2
    d -= d.min(1, keepdims=True)
    lo, hi, beta = np.full(n, 1e-20), np.full(n, 1e20), 1 / np.maximum(d.mean(1), 1e-12)
    for _ in range(100):
        p = np.exp(-d * beta[:, None])
        p /= p.sum(1, keepdims=True)
        high = -(p * np.log(np.maximum(p, 1e-300))).sum(1) > np.log(perplexity)
        lo, hi = np.where(high, beta, lo), np.where(high, hi, beta)
        beta = np.where(hi > 1e19, beta * 2, np.where(lo < 1e-19, beta / 2, (lo + hi) / 2))
    # Each link pulls both of its ends by half of its share: that is (p + p') / 2n without a sorted table of both.
    p = (p / (2 * n)).ravel()
    to = near.ravel().astype(np.int32)
    y = np.random.default_rng(seed).normal(scale=1e-4, size=(n, dims))
    move, gain = np.zeros_like(y), np.ones_like(y)
    rate = rate or max(n / 48, 50)
    for step in range(rounds):
        push, total = _repulsion(y)
        grad = -push / total
        for s in range(0, n, max(1, CHUNK // k)):
            e = min(n, s + max(1, CHUNK // k))
            at, other = np.repeat(np.arange(s, e), k), to[s * k : e * k]
            gap = y[at] - y[other]
            pull = (p[s * k : e * k] * (12 if step < 250 else 1) / (1 + (gap * gap).sum(1)))[:, None] * gap
            for c in range(dims):
                grad[:, c] += np.bincount(at, pull[:, c], n) - np.bincount(other, pull[:, c], n)
        grad *= 4
        gain = np.maximum(np.where(np.sign(grad) == np.sign(move), gain * 0.8, gain + 0.2), 0.01)
        move = (0.5 if step < 250 else 0.8) * move - rate * gain * grad
        y = y + move
        y -= y.mean(0)
    return y


def _repulsion(y: np.ndarray, least: int = 50) -> tuple[np.ndarray, float]:
    """For each point the sum over others of (1 + d^2)^-2 times the way from them, and the sum of (1 + d^2)^-1 over all pairs.

    Points are spread over three nodes of their box in each dimension by Lagrange's polynomials; boxes are at most 1 wide.
    """
    n, dims = y.shape
    low = y.min(0)
    width = max(float((y.max(0) - low).max()), 1e-9) * (1 + 1e-9)
    boxes = max(least if dims < 3 else 10, int(np.ceil(width)))
    nodes, h = 3 * boxes, width / boxes / 3
    inside = (y - low) / (3 * h)
    box = np.clip(np.floor(inside).astype(np.int64), 0, boxes - 1)
    t = (inside - box) * 3 - 0.5  # in nodes, from the box's first
    weight = np.stack(((t - 1) * (t - 2) / 2, -t * (t - 2), t * (t - 1) / 2))
    gaps = np.arange(2 * nodes)
    gaps = np.minimum(gaps, 2 * nodes - gaps) * h
    square = sum((gaps.reshape([-1 if a == c else 1 for a in range(dims)]) ** 2 for c in range(dims)), np.zeros([1] * dims))
    axes, shape = tuple(range(dims)), (2 * nodes,) * dims
    flat = [(np.ravel_multi_index([3 * box[:, c] + o[c] for c in range(dims)], (nodes,) * dims), np.prod([weight[o[c], :, c] for c in range(dims)], axis=0)) for o in np.ndindex(*(3,) * dims)]

    def spread(charge: np.ndarray) -> np.ndarray:
        grid = sum(np.bincount(at, w * charge, nodes**dims) for at, w in flat)
        return np.fft.rfftn(grid.reshape((nodes,) * dims), shape, axes)

    def gathered(grid: np.ndarray, kernel: np.ndarray) -> np.ndarray:
        full = np.fft.irfftn(grid * kernel, shape, axes)[(slice(nodes),) * dims].ravel()
        return sum(w * full[at] for at, w in flat)

    one, two = (np.fft.rfftn((1 + square) ** -e, shape, axes) for e in (1.0, 2.0))
    ones = spread(np.ones(n))
    total = gathered(ones, one).sum() - n
    near = gathered(ones, two)
    push = np.column_stack([y[:, c] * near - gathered(spread(y[:, c]), two) for c in range(dims)])
    return push, max(float(total), 1e-12)


def umap(near: np.ndarray, dist: np.ndarray, dims: int = 2, min_dist: float = 0.01, epochs: int = 200, rate: float = 1.0, negatives: int = 5, seed: int = 0) -> np.ndarray:
    """Layout of a fuzzy graph of neighbours (n x k places and distances) by attraction and sampled repulsion."""
    n, k = near.shape
    rng = np.random.default_rng(seed)
    rho = np.where(dist > 0, dist, np.inf).min(1)
    rho = np.where(np.isfinite(rho), rho, 0)
    lo, hi, sigma = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(64):
        total = np.exp(-np.maximum(dist - rho[:, None], 0) / sigma[:, None]).sum(1)
        big = total > np.log2(max(k, 2))
        hi, lo = np.where(big, sigma, hi), np.where(big, lo, sigma)
        sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
    w = np.exp(-np.maximum(dist - rho[:, None], 0) / np.maximum(sigma, 1e-12)[:, None])
    # The probability that a link is there from either side.
    src, dst = np.repeat(np.arange(n), k), near.ravel()
    pair = np.minimum(src, dst) * n + np.maximum(src, dst)
    order = np.argsort(pair, kind="stable")
    pair, first = np.unique(pair[order], return_index=True)
    weight = 1 - np.multiply.reduceat(1 - w.ravel()[order], first) if len(first) else np.empty(0)
    edges = np.column_stack((pair // n, pair % n))
    # a and b of 1 / (1 + a d^2b), fitted to a step with an exponential tail from min_dist on.
    grid = np.linspace(0, 3, 300)
    want = np.where(grid <= min_dist, 1, np.exp(-(grid - min_dist)))
    tries = [(a, b, ((1 / (1 + a * grid ** (2 * b)) - want) ** 2).sum()) for a in np.linspace(0.5, 3, 26) for b in np.linspace(0.5, 1.5, 21)]
    a, b, _ = min(tries, key=lambda t: t[2])
    y = rng.uniform(-10, 10, (n, dims))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        on = edges[rng.random(len(edges)) < weight / weight.max()]
        i, j = on[:, 0], on[:, 1]
        gap = y[i] - y[j]
        d2 = (gap**2).sum(1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0)[:, None] * gap
        pull = np.clip(pull, -4, 4) * step
        np.add.at(y, i, pull)
        np.add.at(y, j, -pull)
        for s in range(0, len(i), CHUNK // negatives):
            src = np.repeat(i[s : s + CHUNK // negatives], negatives)
            other = rng.integers(0, n, len(src))
            gap = y[src] - y[other]
            d2 = (gap**2).sum(1)
            push = np.clip((2 * b / ((0.001 + d2) * (1 + a * d2**b)))[:, None] * gap, -4, 4)
            push[src == other] = 0
            np.add.at(y, src, push * step)
    return y


def _attach(df: DataFrame, ids: np.ndarray, y: np.ndarray, prefix: str, id_col: str) -> DataFrame:
    made = df.sparkSession.createDataFrame(pa.table({"__id": ids} | {f"{prefix}{i + 1}": np.ascontiguousarray(y[:, i]) for i in range(y.shape[1])}))
    return df.join(made, q(id_col) == F.col("__id"), "left").drop("__id")


def reduce_tsne(df: DataFrame, cols: Selector = None, num_comp: int = 2, perplexity: float = 30.0, max_iterations: int = 1000, id_col: str = "cell_id", seed: int = 0, max_cells: int | None = None) -> DataFrame:
    """t-SNE on the driver: exact while its six n by n matrices of doubles take MAX_DENSE bytes, else from neighbours that are found in parallel."""
    names = [c for c in columns(df, cols, is_numeric) if c != id_col]
    n = df.count()
    if max_cells is not None and n > max_cells:
        raise ValueError(f"more than {max_cells} cells: downsample first")
    if n * n * 48 <= MAX_DENSE:
        ids, x = _points(df, names, id_col)
        return _attach(df, ids, tsne(x, num_comp, perplexity, max_iterations, seed), ".tsne", id_col)
    ids, near, dist = _neighbours(df, names, int(3 * perplexity), id_col, max_cells)
    return _attach(df, ids, tsne_of_neighbours(near, dist, num_comp, perplexity, max_iterations, seed), ".tsne", id_col)


def reduce_umap(df: DataFrame, cols: Selector = None, num_comp: int = 2, neighbors: int = 5, min_dist: float = 0.01, learn_rate: float = 1.0, epochs: int = 200, id_col: str = "cell_id", seed: int = 0, max_cells: int | None = None) -> DataFrame:
    """Neighbours are found in parallel; the layout is made on the driver, in some hundred bytes a cell and neighbour."""
    names = [c for c in columns(df, cols, is_numeric) if c != id_col]
    ids, near, dist = _neighbours(df, names, neighbors, id_col, max_cells)
    return _attach(df, ids, umap(near, dist, num_comp, min_dist, epochs, learn_rate, seed=seed), ".umap", id_col)


def reduce_dimensions(df: DataFrame, cols: Selector = None, method: str = "pca", augment: bool = True, **options) -> DataFrame:
    verbs = {"pca": reduce_pca, "tsne": reduce_tsne, "umap": reduce_umap}
    if method not in verbs:
        raise ValueError(f"method must be one of {sorted(verbs)}")
    out = verbs[method](df, cols, **options)
    return out if augment else out.select(*[q(c) for c in out.columns if c not in df.columns])


