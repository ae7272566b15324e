"""Clusters of clusters: centres are aggregated in parallel, their few rows clustered on the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graphs import louvain
from ..functions.trees import consensus_labels, elbow, kmeans_labels, linkage_labels, pairwise, within_squares
from ..table import Selector, columns, is_numeric, q

#: Clusters that a metaclustering takes at most: all of them go to the driver, which also bounds the bytes of their pairwise gaps.
MAX_CLUSTERS, MAX_BYTES = 20_000, 1 << 30


def summarize_clusters(df: DataFrame, cluster_col: str, cols: list[str], fun: Callable[[Column], Column] = F.median) -> DataFrame:
    """One row of central values for each cluster."""
    return df.groupBy(q(cluster_col)).agg(*[fun(q(c)).alias(c) for c in cols])


def _meta(df: DataFrame, cluster_col: str, cols: Selector, fun: Callable[[Column], Column], label: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    names = [c for c in columns(df, cols, is_numeric) if c != cluster_col]
    got = summarize_clusters(df, cluster_col, names, fun).where(q(cluster_col).isNotNull()).limit(MAX_CLUSTERS + 1).toPandas()
    if len(got) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    if len(got) ** 2 * max(1, len(names)) * 8 > MAX_BYTES:
        raise ValueError(f"{len(got)} clusters by {len(names)} channels are too many to compare pairwise")
    got = got.sort_values(cluster_col, key=lambda s: s.astype(str)).reset_index(drop=True)
    found = label(got[names].to_numpy(float)) if len(got) else np.empty(0, int)
    kind = df.schema[cluster_col].dataType.simpleString()
    table = df.sparkSession.createDataFrame(pd.DataFrame({"c": got[cluster_col], "m": [str(k + 1) for k in found]}), f"c {kind}, m string")
    return df.join(F.broadcast(table), q(cluster_col).eqNullSafe(F.col("c")), "left").drop("c").withColumnRenamed("m", name)  # at most MAX_CLUSTERS rows


def metacluster_hierarchical(df: DataFrame, cluster_col: str, cols: Selector = None, fun: Callable[[Column], Column] = F.median, num_metaclusters: int = 10, distance: str = "euclidean", linkage: str = "complete") -> DataFrame:
    return _meta(df, cluster_col, cols, fun, lambda x: linkage_labels(pairwise(x, distance), num_metaclusters, linkage), ".hierarchical_metacluster")


def metacluster_kmeans(df: DataFrame, cluster_col: str, cols: Selector = None, fun: Callable[[Column], Column] = F.median, num_metaclusters: int = 10, seed: int = 0) -> DataFrame:
    return _meta(df, cluster_col, cols, fun, lambda x: kmeans_labels(x, num_metaclusters, seed), ".kmeans_metacluster")


def phenograph_labels(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Communities of the Jaccard graph of a few points."""
    n = len(x)
    k = max(1, min(k, n - 1)) if n > 1 else 0
    if k == 0:
        return np.zeros(n, int)
    d = pairwise(x)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    on = np.zeros((n, n), bool)
    on[np.arange(n)[:, None], near] = True
    both = on.astype(int) @ on.T.astype(int)
    a, b = np.repeat(np.arange(n), k), near.ravel()
    w = both[a, b] / (2 * k - both[a, b])
    keep = w > 0
    return louvain(a[keep], b[keep], w[keep], n, seed)[0]


def metacluster_phenograph(df: DataFrame, cluster_col: str, cols: Selector = None, fun: Callable[[Column], Column] = F.median, num_neighbors: int = 5, seed: int = 0) -> DataFrame:
    return _meta(df, cluster_col, cols, fun, lambda x: phenograph_labels(x, num_neighbors, seed), ".phenograph_metacluster")


def metacluster_consensus(
    df: DataFrame, cluster_col: str, cols: Selector = None, fun: Callable[[Column], Column] = F.median, num_metaclusters: int = 10, proportion_clusters: float = 0.9, proportion_features: float = 1.0,
    num_reps: int = 20, algorithm: str = "hierarchical", distance: str = "euclidean", seed: int = 0,
) -> DataFrame:
    if algorithm not in ("hierarchical", "pam", "kmeans"):
        raise ValueError("algorithm must be hierarchical, pam or kmeans")
    return _meta(df, cluster_col, cols, fun, lambda x: consensus_labels(x, num_metaclusters, num_reps, proportion_clusters, proportion_features, algorithm, distance, seed=seed), ".consensus_metacluster")


def _som_labels(x: np.ndarray, k: int, seed: int, epochs: int = 100) -> np.ndarray:
    """A map of one row of k nodes."""
    rng = np.random.default_rng(seed)
    codes = x[rng.choice(len(x), k, replace=len(x) < k)].astype(float)
    for epoch in range(epochs):
        reach = max(0.5, (k - 1) * 0.67 * (1 - epoch / epochs))
        best = ((x[:, None] - codes[None]) ** 2).sum(2).argmin(1)
        near = np.exp(-((np.arange(k)[:, None] - np.arange(k)[None]) / reach) ** 2 / 2) if reach > 0.5 else np.eye(k)
        weight = near[:, best]
        total = weight.sum(1, keepdims=True)
        codes = np.where(total > 1e-12, weight @ x / np.maximum(total, 1e-12), codes)
    return ((x[:, None] - codes[None]) ** 2).sum(2).argmin(1)


def metacluster_flowsom(
    df: DataFrame, cluster_col: str, cols: Selector = None, fun: Callable[[Column], Column] = F.median, num_metaclusters: int = 10, algorithm: str = "consensus", seed: int = 0
) -> DataFrame:
    """As many metaclusters as the elbow of the method's own errors says, at most num_metaclusters, by consensus, hierarchical, kmeans or som."""
    makers = {
        "consensus": lambda x, k: consensus_labels(x, k, 100, seed=seed),
        "hierarchical": lambda x, k: linkage_labels(pairwise(x, "minkowski"), k, "ward.D2"),
        "kmeans": lambda x, k: kmeans_labels(x, k, seed),
        "som": lambda x, k: _som_labels(x, k, seed),
    }
    if algorithm not in makers:
        raise ValueError(f"algorithm must be one of {sorted(makers)}")

    def label(x: np.ndarray) -> np.ndarray:
        most = min(num_metaclusters, len(x))
        if most < 3:
            return makers[algorithm](x, most)
        found = [np.zeros(len(x), int), *[makers[algorithm](x, k) for k in range(2, most + 1)]]
        return found[elbow(np.array([within_squares(x, f) for f in found])) - 1]

    return _meta(df, cluster_col, cols, fun, label, ".flowsom_metacluster")


def metacluster(df: DataFrame, cluster_col: str, cols: Selector = None, method: str = "consensus", augment: bool = True, **options) -> DataFrame:
    verbs = {"hierarchical": metacluster_hierarchical, "kmeans": metacluster_kmeans, "phenograph": metacluster_phenograph, "consensus": metacluster_consensus, "flowsom": metacluster_flowsom}
    if method not in verbs:
        raise ValueError(f"method must be one of {sorted(verbs)}")
    out = verbs[method](df, cluster_col, cols, **options)
    return out if augment else out.select(q(f".{method}_metacluster"))
