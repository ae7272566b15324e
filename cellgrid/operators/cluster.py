"""Clustering of cells, and nearest-centre classification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.graphs import louvain
from ..functions.trees import consensus_labels, kmeans_labels
from ..storage import materialize
from ..table import Selector, columns, is_numeric, q
from .neighbors import find_knn, jaccard_edges
from .sample import downsample_constant, join_groups

#: Edges of a graph of neighbours that the driver takes, 24 bytes each.
MAX_EDGES = 40_000_000
#: Bytes of the codes or centres of all groups, which go to every task.
MAX_CODES = 256 << 20
#: Distances of a map's nodes by number.
SOM_METRICS = {1: "manhattan", 2: "euclidean", 3: "chebyshev", 4: "cosine"}


def _matrix(pdf: pd.DataFrame, cols: list[str]) -> np.ndarray:
    return np.column_stack([pdf[c].to_numpy(float) for c in cols])


def cluster_kmeans(df: DataFrame, cols: Selector = None, num_clusters: int = 20, seed: int = 0, max_iter: int = 50, name: str = ".kmeans_cluster") -> DataFrame:
    """k-means; labels are the numbers of the centres from 1, as text."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    names = columns(df, cols, is_numeric)
    ready = df.withColumns({f"__x{i}": q(c).cast("double") for i, c in enumerate(names)})
    vectors = VectorAssembler(inputCols=[f"__x{i}" for i in range(len(names))], outputCol="__v").transform(ready)
    fit = KMeans(k=num_clusters, seed=seed, maxIter=max_iter, featuresCol="__v", predictionCol="__k").fit(vectors)
    return fit.transform(vectors).withColumn(name, (F.col("__k") + 1).cast("string")).select(*[q(c) for c in df.columns], q(name))


def _node_distances(x: np.ndarray, codes: np.ndarray, metric: int) -> np.ndarray:
    if metric == 2:
        return (x * x).sum(1)[:, None] + (codes * codes).sum(1)[None, :] - 2 * x @ codes.T
    if metric == 4:
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(codes, axis=1)[None, :]
        return 1 - np.divide(x @ codes.T, norm, out=np.zeros((len(x), len(codes))), where=norm > 0)
    gap = np.abs(x[:, None, :] - codes[None, :, :])
    return gap.sum(2) if metric == 1 else gap.max(2)


def _nearest_node(x: np.ndarray, codes: np.ndarray, metric: int) -> np.ndarray:
    """The nearest code of each row; codes that are not a number are none."""
    d = _node_distances(x, codes, metric)
    return np.where(np.isnan(d), np.inf, d).argmin(1)


def _sums(rows: DataFrame, cols: list[str], codes: np.ndarray, metric: int) -> tuple[np.ndarray, np.ndarray]:
    """How many rows of each group __g are nearest to each of its codes (groups x codes x channels), and their sums: one pass for all groups."""
    _, nodes, p = codes.shape

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pdf in batches:
            group, x = pdf["__g"].to_numpy(np.int64), _matrix(pdf, cols)
            for g in np.unique(group).tolist():
                count, total = found.setdefault(g, (np.zeros(nodes), np.zeros((nodes, p))))
                own = x[group == g] if len(codes) > 1 else x
                for s in range(0, len(own), 2_048):
                    part = own[s : s + 2_048]
                    best = _nearest_node(part, codes[g], metric)
                    np.add.at(total, best, part)
                    count += np.bincount(best, minlength=nodes)
        for g, (count, total) in found.items():
            at = np.flatnonzero(count)
            yield pd.DataFrame({"g": g, "node": at, "n": count[at], "s": total[at].tolist()})

    got = rows.mapInPandas(sums, "g long, node long, n double, s array<double>")
    got = got.groupBy("g", "node").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(p)]).toPandas()  # a row for each code
    count, total = np.zeros(codes.shape[:2]), np.zeros(codes.shape)
    at = got["g"].to_numpy(int), got["node"].to_numpy(int)
    count[at], total[at] = got["n"].to_numpy(), got[[f"s{i}" for i in range(p)]].to_numpy(float)
    return count, total


def _numbered(df: DataFrame, names: list[str], groups: list[str]) -> tuple[DataFrame, int]:
    """df with __g, the number of a row's group from 0, and how many there are."""
    if not groups:
        return df.withColumn("__g", F.lit(0).cast("long")), 1
    keys = df.select(*[q(g) for g in groups]).distinct()
    place = (F.row_number().over(Window.orderBy(*[q(g) for g in groups])) - 1).cast("long")  # a row for each group
    keys = materialize(keys.withColumn("__g", place))
    return join_groups(df, keys), keys.count()


def _training_rows(df: DataFrame, names: list[str], groups: list[str], nodes: int) -> tuple[DataFrame, int, list[str]]:
    marked, n = _numbered(df, names, groups)
    if n * nodes * max(1, len(names)) * 8 > MAX_CODES:
        raise ValueError(f"{n} groups with {nodes} codes of {len(names)} channels each are too many")
    cols = [f"x{i}" for i in range(len(names))]
    rows = materialize(marked.select("__g", *[q(c).cast("double").alias(x) for c, x in zip(names, cols, strict=True)]).dropna())  # read in each round
    return rows, n, cols


def _first_rows(rows: DataFrame, n: int, cols: list[str], each: int, seed: int) -> list[np.ndarray]:
    """At most `each` rows of each group."""
    if n == 1:
        return [rows.orderBy(F.xxhash64(F.lit(seed), *cols)).limit(each).select(*cols).toPandas().to_numpy(float)]
    got = downsample_constant(rows.withColumnRenamed("__g", "g"), "g", each, seed).toPandas().sort_values(["g", *cols])
    return [got.loc[got["g"] == g, cols].to_numpy(float) for g in range(n)]


def som_codes(df: DataFrame, names: list[str], xdim: int, ydim: int, epochs: int, metric: int, seed: int, groups: list[str] | None = None) -> np.ndarray:
    """Self-organising maps, one for each group (groups x nodes x channels), trained in batches: each epoch sends the codes out and gets sums for each node back."""
    nodes = xdim * ydim
    rows, n, cols = _training_rows(df, names, groups or [], nodes)
    first = _first_rows(rows, n, cols, nodes, seed)
    if not any(len(f) for f in first):
        raise ValueError("no rows to train on")
    codes = np.stack([f[np.arange(nodes) % len(f)] if len(f) else np.full((nodes, len(cols)), np.nan) for f in first])
    grid = np.array([(i % xdim, i // xdim) for i in range(nodes)], float)
    apart = np.abs(grid[:, None, :] - grid[None, :, :]).max(2)
    wide = np.quantile(apart, 0.67)
    for epoch in range(epochs):
        radius = max(0.5, wide * (1 - epoch / max(1, epochs - 1)))
        near = np.exp(-((apart / radius) ** 2) / 2) if radius > 0.5 else np.eye(nodes)
        count, total = _sums(rows, cols, codes, metric)
        weight = count @ near
        codes = np.where(weight[..., None] > 1e-12, np.einsum("ij,gjp->gip", near, total) / np.maximum(weight, 1e-12)[..., None], codes)
    return codes


def _assign_groups(df: DataFrame, names: list[str], groups: list[str], codes: np.ndarray, metric: int, label: Callable[[int, int], str], name: str) -> DataFrame:
    """df with the label of the nearest code of each row's group."""
    marked, _ = _numbered(df, names, groups)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            group, x = pdf["__g"].to_numpy(np.int64), _matrix(pdf, names)
            best = np.empty(len(pdf), np.int64)
            for g in np.unique(group).tolist():
                best[group == g] = _nearest_node(x[group == g], codes[g], metric)
            gone = np.isnan(x).any(1)
            yield pdf.drop(columns="__g").assign(**{name: [None if no else label(g, k) for g, k, no in zip(group.tolist(), best.tolist(), gone.tolist(), strict=True)]})

    return marked.select(*[q(c) for c in df.columns], "__g").mapInPandas(run, schema)


def _kmeans_groups(df: DataFrame, names: list[str], groups: list[str], num_clusters: int = 20, seed: int = 0, max_iter: int = 50, name: str = ".kmeans_cluster") -> DataFrame:
    """k-means of each group by itself, all groups in each pass; the first centres come from a bounded sample of each group."""
    rows, n, cols = _training_rows(df, names, groups, num_clusters)
    each = max(num_clusters, min(50 * num_clusters, MAX_CODES // (8 * max(1, len(cols)) * n)))
    codes = np.full((n, num_clusters, len(cols)), np.nan)
    for g, part in enumerate(_first_rows(rows, n, cols, each, seed)):
        if len(part):
            found = kmeans_labels(part, num_clusters, seed, starts=3)
            for k in range(int(found.max()) + 1):
                codes[g, k] = part[found == k].mean(0)
    for _ in range(max_iter):
        count, total = _sums(rows, cols, codes, 2)
        new = np.where(count[..., None] > 0, total / np.maximum(count, 1)[..., None], codes)
        still = np.nan_to_num(np.abs(new - codes)).max(initial=0.0) < 1e-4
        codes = new
        if still:
            break
    return _assign_groups(df, names, groups, codes, 2, lambda g, k: str(k + 1), name)


def cluster_flowsom(
    df: DataFrame, cols: Selector = None, xdim: int = 10, ydim: int = 10, metric: int = 2, perform_metaclustering: bool = True, num_metaclusters: int = 20, epochs: int = 10, seed: int = 0, by: Selector = None,
) -> DataFrame:
    """A self-organising map (.flowsom_cluster: the node), its codes metaclustered by consensus (.flowsom_metacluster); a map for each group, all of them trained in the same passes."""
    groups = columns(df, by)
    names = [c for c in columns(df, cols, is_numeric) if c not in groups]
    codes = som_codes(df, names, xdim, ydim, epochs, metric, seed, groups)
    if not perform_metaclustering:
        return _assign_groups(df, names, groups, codes, metric, lambda g, k: str(k + 1), ".flowsom_cluster")
    found = [consensus_labels(c, num_metaclusters, seed=seed) if not np.isnan(c).any() else np.zeros(len(c), int) for c in codes]
    return _assign_groups(df, names, groups, codes, metric, lambda g, k: str(found[g][k] + 1), ".flowsom_metacluster")


def cluster_phenograph(df: DataFrame, cols: Selector = None, num_neighbors: int = 30, metric: str = "euclidean", id_col: str = "cell_id", seed: int = 0, max_cells: int = 2_000_000, by: Selector = None, **options) -> DataFrame:
    """Communities of the graph of neighbours weighted by Jaccard coefficients (.phenograph_cluster), largest first; in each group by itself.

    Neighbours and weights are made in parallel; communities are found on the driver, for at most
    max_cells cells and MAX_EDGES edges: downsample and upsample beyond.
    """
    groups = columns(df, by)
    n = df.count()
    if n > max_cells or n * num_neighbors > MAX_EDGES:
        raise ValueError(f"{n} cells with {num_neighbors} neighbours each are more than the driver takes: downsample first")
    near = materialize(find_knn(df, cols, num_neighbors, metric, id_col, by=groups, **options))
    edges = jaccard_edges(near).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").groupBy("a", "b").agg(F.sum("weight").alias("w"))
    got = edges.toPandas().sort_values(["a", "b"])
    marked, _ = _numbered(df, [], groups)
    cells = marked.select(q(id_col).cast("long").alias("id"), "__g").distinct().toPandas().sort_values("id")
    ids, group = cells["id"].to_numpy(), cells["__g"].to_numpy()
    a, b, w = np.searchsorted(ids, got["a"]), np.searchsorted(ids, got["b"]), got["w"].to_numpy(float)
    labels = np.zeros(len(ids), int)
    for g in np.unique(group):
        own, edge = np.flatnonzero(group == g), group[a] == g
        labels[own], _ = louvain(np.searchsorted(own, a[edge]), np.searchsorted(own, b[edge]), w[edge], len(own), seed)
    table = df.sparkSession.createDataFrame(pd.DataFrame({"__id": ids, ".phenograph_cluster": [str(k + 1) for k in labels]}), "__id long, `.phenograph_cluster` string")
    return df.join(table, q(id_col) == F.col("__id"), "left").select(*[q(c) for c in df.columns], q(".phenograph_cluster"))


class Classifier:
    """Centre and covariance of each population, by name."""

    def __init__(self, populations: list[str], centers: np.ndarray, covariances: list[np.ndarray], markers: list[str]) -> None:
        self.populations, self.centers, self.covariances, self.markers = populations, centers, covariances, markers


def classifier(df: DataFrame, cluster_col: str, markers: list[str]) -> Classifier:
    """One aggregation: means and sample covariances of each cluster. Null labels and values count for nothing."""
    p = len(markers)
    x = [q(c).cast("double") for c in markers]
    cells = [F.covar_samp(x[i], x[j]).alias(f"v{i}_{j}") for i in range(p) for j in range(i + 1)]
    got = df.where(q(cluster_col).isNotNull()).groupBy(q(cluster_col).cast("string").alias("c")).agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(p)], *cells).toPandas().sort_values("c")
    centers = got[[f"m{i}" for i in range(p)]].to_numpy(float)
    covariances = []
    for _, r in got.iterrows():
        v = np.zeros((p, p))
        for i in range(p):
            for j in range(i + 1):
                v[i, j] = v[j, i] = r[f"v{i}_{j}"]
        covariances.append(v)
    return Classifier(got["c"].tolist(), centers, covariances, markers)


def distance_columns(df: DataFrame, fit: Classifier, markers: list[str], distance: str = "mahalanobis") -> dict[str, Column]:
    """For each population the distance of a row to it, as an expression."""
    x = [q(c).cast("double") for c in markers]
    out: dict[str, Column] = {}
    for name, mean, cov in zip(fit.populations, fit.centers, fit.covariances, strict=True):
        if distance == "mahalanobis":
            if not np.isfinite(cov).all() or np.linalg.matrix_rank(cov) < len(x):
                raise ValueError(f"the covariance of {name} is singular")
            inverse = np.linalg.inv(cov)
            gap = [c - float(m) for c, m in zip(x, mean, strict=True)]
            terms = [gap[i] * gap[j] * float(inverse[i, j] * (1 if i == j else 2)) for i in range(len(x)) for j in range(i + 1)]
            out[name] = sum(terms[1:], terms[0])
        elif distance in ("cosine", "pearson"):
            middle = sum(x[1:], x[0]) / len(x) if distance == "pearson" else F.lit(0.0)
            target = mean - mean.mean() if distance == "pearson" else mean
            part = [c - middle for c in x] if distance == "pearson" else x
            product = sum((c * float(m) for c, m in zip(part[1:], target[1:], strict=True)), part[0] * float(target[0]))
            length = F.sqrt(sum((c * c for c in part[1:]), part[0] * part[0]))
            out[name] = 1 - F.try_divide(product, length * float(np.linalg.norm(target)))
        else:
            raise ValueError("distance must be mahalanobis, cosine or pearson")
    return out


def cluster_ddpr(
    df: DataFrame, healthy: DataFrame, healthy_label_col: str, cols: Selector = None, distance: str = "mahalanobis", return_distances: bool = False, name: str | None = None,
) -> DataFrame:
    """Each cell gets the population of healthy whose centre is closest, ties by name (.<distance>_cluster)."""
    markers = columns(df, cols, lambda f: is_numeric(f) and f.name in healthy.columns)
    far = distance_columns(df, classifier(healthy, healthy_label_col, markers), markers, distance)
    named = {f".{distance}_{p}": c for p, c in far.items()}
    best = F.array_min(F.array(*[F.struct(c.alias("d"), F.lit(p).alias("p")) for p, c in far.items()]))["p"]
    out = df.withColumns({**(named if return_distances else {}), name or f".{distance}_cluster": best})
    return out


def cluster(df: DataFrame, cols: Selector = None, method: str = "kmeans", by: Selector = None, augment: bool = True, **options) -> DataFrame:
    """Clusters by kmeans, flowsom, phenograph or ddpr; with groups each by itself, labels then end in @<group>."""
    verbs = {"kmeans": cluster_kmeans, "flowsom": cluster_flowsom, "phenograph": cluster_phenograph, "ddpr": cluster_ddpr}
    if method not in verbs:
        raise ValueError(f"method must be one of {sorted(verbs)}")

    names = columns(df, cols, is_numeric) if method != "ddpr" or cols is not None else None
    groups = columns(df, by)
    if method == "ddpr":
        out = cluster_ddpr(df, options["healthy"], cols=names, **{k: v for k, v in options.items() if k != "healthy"})
    elif not groups:
        out = verbs[method](df, names, **options)
    else:
        names = [c for c in names or [] if c not in groups] or None
        out = _kmeans_groups(df, names, groups, **options) if method == "kmeans" else verbs[method](df, names, by=groups, **options)
    if groups:
        tag = F.concat_ws("_", *[F.coalesce(q(g).cast("string"), F.lit("NA")) for g in groups])
        out = out.withColumns({c: F.concat(q(c).cast("string"), F.lit("@"), tag) for c in out.columns if c not in df.columns and c.endswith("cluster")})
    return out if augment else out.select(*[q(c) for c in out.columns if c not in df.columns])


def annotate_clusters(df: DataFrame, cluster_col: str, annotations: dict[str, str] | DataFrame) -> DataFrame:
    """Adds names to clusters: a dict of cluster to name (column <cluster_col>_annotation) or a table with cluster_col and one more."""
    if isinstance(annotations, dict):
        kind = df.schema[cluster_col].dataType.simpleString()
        pairs = F.map_from_arrays(F.array(*[F.lit(k).cast(kind) for k in annotations]), F.array(*[F.lit(v) for v in annotations.values()]))
        return df.withColumn(f"{cluster_col}_annotation", F.try_element_at(pairs, q(cluster_col)))
    if cluster_col not in annotations.columns or len(annotations.columns) != 2:
        raise ValueError("annotations must have the cluster column and one more")
    return df.join(annotations, cluster_col, "left")
