"""What plots show, as tables: drawing is left to other tools."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graphs import minimum_spanning_tree
from ..functions.trees import linkage_levels, pairwise
from ..operators import neighbors, reduce
from ..operators.sample import join_groups
from ..storage import materialize
from ..table import Selector, columns, is_numeric, q

#: Colours of our own choice, in the order of use.
PALETTE = [
    "#1F77B4", "#FF7F0E", "#2CA02C", "#D62728", "#9467BD", "#8C564B", "#E377C2",
    "#7F7F7F", "#BCBD22", "#17BECF", "#AEC7E8", "#FFBB78", "#98DF8A", "#FF9896",
]
#: Rows that are ordered by the distances of all pairs.
MAX_ORDERED = 2_000
#: Bins of the histogram that densities are smoothed from.
FINE_BINS = 4_096


def palette(n: int) -> list[str]:
    if n > len(PALETTE):
        raise ValueError(f"there are {len(PALETTE)} colours")
    return PALETTE[:n]


def cells_density(df: DataFrame, marker: str, by: Selector = None, points: int = 512) -> DataFrame:
    """(groups, x, density): Gaussian kernel estimates, from a fine histogram of each group, so that a group's size does not matter."""
    groups = [q(c) for c in columns(df, by)]
    x = q(marker).cast("double")
    stats = df.groupBy(*groups).agg(F.count(x).alias("__n"), F.stddev_samp(x).alias("__sd"), F.percentile_approx(x, [0.25, 0.75], 1000).alias("__q"))
    ends = df.agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    met = df.join(F.broadcast(ends), F.lit(True)).where(x.isNotNull())  # one row
    width = F.greatest(F.col("__high") - F.col("__low"), F.lit(1e-12))
    place = F.least(F.lit(FINE_BINS - 1), F.floor((x - F.col("__low")) / width * FINE_BINS)).cast("int")
    hist = met.groupBy(*groups, "__low", "__high", place.alias("__bin")).agg(F.count("*").alias("__c"))
    packed = join_groups(hist.groupBy(*groups).agg(F.first("__low").alias("__low"), F.first("__high").alias("__high"), F.collect_list(F.struct("__bin", "__c")).alias("__h")), stats)  # FINE_BINS entries at most

    def smooth(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                h = np.array([(v["__bin"], v["__c"]) for v in r["__h"]], float)
                step = max(r["__high"] - r["__low"], 1e-12) / FINE_BINS
                at = r["__low"] + (h[:, 0] + 0.5) * step
                iqr = (r["__q"][1] - r["__q"][0]) / 1.34
                sd = r["__sd"] if r["__sd"] and r["__sd"] == r["__sd"] else 0.0
                band = 0.9 * (min(sd, iqr) if iqr > 0 else sd or 1.0) * r["__n"] ** -0.2 or 1.0
                grid = np.linspace(r["__low"] - 3 * band, r["__high"] + 3 * band, points)
                k = np.exp(-(((grid[:, None] - at[None]) / band) ** 2) / 2) @ h[:, 1] / (r["__n"] * band * np.sqrt(2 * np.pi))
                rows.append({**{g: r[g] for g in names}, "x": grid.tolist(), "density": k.tolist()})
            yield pd.DataFrame(rows, columns=[*names, "x", "density"])

    names = columns(df, by)
    kinds = ", ".join([f"`{g}` {df.schema[g].dataType.simpleString()}" for g in names] + ["x array<double>", "density array<double>"])
    out = packed.mapInPandas(smooth, kinds)
    return out.select(*groups, F.explode(F.arrays_zip("x", "density")).alias("__p")).select(*groups, "__p.x", "__p.density")


def cells_scatter(df: DataFrame, x: str, y: str, color: str | None = None, facets: Selector = None) -> DataFrame:
    return df.select(*[q(c) for c in dict.fromkeys([x, y, *([color] if color else []), *columns(df, facets)])])


def cells_embedding(df: DataFrame, embedding_cols: Selector = None, compute_cols: Selector = None, method: str = "pca", color: str | None = None, facets: Selector = None, **options) -> DataFrame:
    """Two columns of an embedding, made if none are given, with colour and facets."""
    names = columns(df, embedding_cols)
    if not names:
        df = reduce.reduce_dimensions(df, compute_cols, method, **({"num_comp": 2} | options))
        names = [c for c in df.columns if c.startswith((".pc", ".tsne", ".umap"))][-2:]
    if len(names) != 2:
        raise ValueError("an embedding has two columns here")
    return cells_scatter(df, *names, color, facets)


def cells_layout(df: DataFrame, cols: Selector = None, num_neighbors: int = 5, metric: str = "euclidean", id_col: str = "cell_id", rounds: int = 100, seed: int = 0, max_cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with x and y, edges) of the graph of neighbours, laid out by forces on the driver."""
    edges = neighbors.knn_graph(neighbors.find_knn(df, cols, num_neighbors, metric, id_col), metric)
    if max_cells is not None and df.count() > max_cells:
        raise ValueError(f"more than {max_cells} cells: downsample first")
    edges = materialize(edges)
    got = edges.toArrow().to_pandas()
    ids = np.unique(np.concatenate((got["src"], got["dst"])))
    place = force_layout(np.searchsorted(ids, got["src"]), np.searchsorted(ids, got["dst"]), got["weight"].to_numpy(float), len(ids), rounds, seed)
    nodes = df.sparkSession.createDataFrame(pa.table({id_col: ids, "x": np.ascontiguousarray(place[:, 0]), "y": np.ascontiguousarray(place[:, 1])}))
    return nodes, edges


def force_layout(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, rounds: int = 100, seed: int = 0) -> np.ndarray:
    """Fruchterman and Reingold's forces; repulsion from a sample of nodes where there are many."""
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 2))
    k = 1 / np.sqrt(max(n, 1))
    for r in range(rounds):
        others = np.arange(n) if n <= 1_000 else rng.choice(n, 1_000, replace=False)
        force = np.empty_like(y)
        for s in range(0, n, 1_000):  # a thousand nodes at a time
            gap = y[s : s + 1_000, None] - y[None, others]
            d = np.sqrt((gap**2).sum(2)) + 1e-9
            force[s : s + 1_000] = (gap * (k * k / d**2)[..., None]).sum(1) * (n / max(1, len(others)))
        pull = y[a] - y[b]
        size = np.sqrt((pull**2).sum(1, keepdims=True)) + 1e-9
        pull = pull * size / k * w[:, None]
        np.add.at(force, a, -pull)
        np.add.at(force, b, pull)
        length = np.sqrt((force**2).sum(1, keepdims=True)) + 1e-12
        y = y + force / length * np.minimum(length, 0.1 * (1 - r / rounds))
    return y


def clusters_mst(df: DataFrame, cluster_col: str, cols: Selector = None, fun: Callable[[Column], Column] = F.median, metric: str = "euclidean", color: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes: cluster, size, colour and place; edges of the least spanning tree of the clusters' centres)."""
    names = [c for c in columns(df, cols, is_numeric) if c != cluster_col]
    more = [(F.mode(q(color)) if not is_numeric(df.schema[color]) else F.avg(q(color))).alias("color")] if color else []
    if color and not is_numeric(df.schema[color]):
        spread = df.groupBy(q(cluster_col)).agg(F.count_distinct(q(color)).alias("k")).where("k > 1")
        if not spread.isEmpty():
            raise ValueError("a cluster has several colours")
    got = df.groupBy(q(cluster_col).cast("string").alias("cluster")).agg(F.count("*").alias("size"), *[fun(q(c)).cast("double").alias(f"m{i}") for i, c in enumerate(names)], *more).limit(5_001).toPandas().sort_values("cluster")
    if len(got) > 5_000:
        raise ValueError("more than 5000 clusters")
    x = got[[f"m{i}" for i in range(len(names))]].to_numpy(float)
    d = pairwise(x) if metric == "euclidean" else 1 - _unit(x) @ _unit(x).T
    tree = minimum_spanning_tree(d)
    a, b = np.array([e[0] for e in tree], int), np.array([e[1] for e in tree], int)
    place = force_layout(a, b, np.ones(len(tree)), len(got), seed=seed)
    nodes = got[["cluster", "size", *(["color"] if color else [])]].assign(x=place[:, 0], y=place[:, 1])
    labels = got["cluster"].to_numpy()
    spark = df.sparkSession
    edges = spark.createDataFrame([(labels[i], labels[j], w) for i, j, w in tree], "src string, dst string, distance double")
    return spark.createDataFrame(nodes), edges


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def clusters_volcano(tests: DataFrame, effect: str = "mean_fc", alpha: float = 0.05, num_labels: int = 5, label_col: str | None = None) -> DataFrame:
    """tests with log2_fc, neg_ln_p (minus the natural log of the adjusted p), direction, and labels for the num_labels smallest p."""
    if effect not in tests.columns:
        raise ValueError("the tests have no fold changes")
    tests = materialize(tests)  # labels and rows are of the same tests
    hit = F.col("p_adj") < alpha
    fold = F.when(q(effect) > 0, F.log2(q(effect)))
    out = tests.withColumn("log2_fc", fold).withColumn("neg_ln_p", F.when(F.col("p_adj") > 0, -F.log("p_adj")))
    out = out.withColumn("direction", F.when(hit & (F.col("log2_fc") > 0), "increase").when(hit & (F.col("log2_fc") < 0), "decrease").otherwise("no change"))
    if label_col is None:
        return out
    top = tests.orderBy("p_adj", q(label_col)).limit(num_labels).select(q(label_col).alias("__l"), F.lit(True).alias("__top")).dropDuplicates(["__l"])
    return out.join(F.broadcast(top), q(label_col).eqNullSafe(F.col("__l")), "left").withColumn("label", F.when(F.col("__top"), q(label_col).cast("string"))).drop("__l", "__top")  # num_labels rows


def heatmap(df: DataFrame, row_col: str, cols: Selector = None, fun: Callable[[Column], Column] = F.median, scale_rows: bool = False, scale_cols: bool = False) -> DataFrame:
    """(row, channel, value, row_order, channel_order): central values, rows and channels ordered by likeness.

    Values are scaled and dealt out by the cluster, however many rows there are. Beyond MAX_ORDERED rows their
    order is that of their groups, which halve the rows at the middle of the direction in which they differ most.
    """
    names = [c for c in columns(df, cols, is_numeric) if c != row_col]
    plain = [f"m{i}" for i in range(len(names))]
    values = df.groupBy(q(row_col).cast("string").alias("row")).agg(*[fun(q(c)).cast("double").alias(m) for c, m in zip(names, plain, strict=True)])
    got = _filled(values.toArrow().to_pandas(), plain).sort_values("row", na_position="last", kind="stable").reset_index(drop=True)
    x = got[plain].to_numpy(float)
    for axis, on in ((1, scale_rows), (0, scale_cols)):
        if on and len(x):
            low, high = x.min(axis, keepdims=True), x.max(axis, keepdims=True)
            x = np.divide(x - low, high - low, out=np.zeros_like(x), where=high > low)
    rows, cols_ = _order(x) if len(x) <= MAX_ORDERED else _halved_order(x), _order(x.T) if len(x) <= MAX_ORDERED else _order(_summary(x))
    wide = pa.table({"row": pa.array(got["row"], pa.string()), "row_order": pa.array(rows.astype(np.int32))} | {m: x[:, i] for i, m in enumerate(plain)})
    made = df.sparkSession.createDataFrame(wide)
    parts = [F.struct(F.lit(c).alias("channel"), F.col(m).alias("value"), F.lit(int(o)).cast("int").alias("channel_order")) for c, m, o in zip(names, plain, cols_, strict=True)]
    return made.select("row", F.explode(F.array(*parts)).alias("v"), "row_order").select("row", "v.channel", "v.value", "row_order", "v.channel_order")


def _filled(got: pd.DataFrame, plain: list[str]) -> pd.DataFrame:
    return got.assign(**{m: np.nan_to_num(got[m].to_numpy(float)) for m in plain})


def _order(x: np.ndarray) -> np.ndarray:
    """Ranks in which merged branches stand side by side."""
    n = len(x)
    keys = linkage_levels(pairwise(x), 1, min(n, 60)) if n else [np.empty(0, int)]
    order = np.lexsort(keys[::-1])
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    return rank


def _halved_order(x: np.ndarray, least: int = 16) -> np.ndarray:
    """Ranks of many rows: cut in halves along their first principal direction until groups are small, and these ordered by likeness."""
    found, open_ = [], [np.arange(len(x))]
    while open_:
        at = open_.pop()
        part = x[at]
        if len(at) <= least or (part == part[0]).all():
            found.append(at[np.argsort(_order(part))] if len(at) <= least else at)
            continue
        part = part - part.mean(0)
        along = part @ np.linalg.eigh(part.T @ part)[1][:, -1]
        order = at[np.argsort(along, kind="stable")]
        open_ += [order[len(order) // 2 :], order[: len(order) // 2]]
    rank = np.empty(len(x), int)
    rank[np.concatenate(found)] = np.arange(len(x))
    return rank


def _summary(x: np.ndarray) -> np.ndarray:
    """A row for each channel, as far from each other as the channels are over all rows of x."""
    gram = x.T @ x
    value, vector = np.linalg.eigh(gram)
    return vector * np.sqrt(np.maximum(value, 0))


def clusters_heatmap(df: DataFrame, cluster_col: str, cols: Selector = None, **options) -> DataFrame:
    return heatmap(df, cluster_col, cols, **options)


def sample_heatmap(df: DataFrame, sample_col: str, cols: Selector = None, **options) -> DataFrame:
    return heatmap(df, sample_col, cols, **options)


def sample_features(feature_table: DataFrame, sample_col: str, cols: Selector = None, **options) -> DataFrame:
    return heatmap(feature_table, sample_col, cols, fun=F.first, **options)


def model_plot(model, data: DataFrame | str = "tuning") -> dict[str, DataFrame]:
    """Linear: truth and prediction; classes: ROC curves; survival: curves by risk and the test between them."""
    from ..operators import modeling

    found = modeling.assess_model(model, data)
    if model.kind == "linear":
        points = model.cv_predictions.select("truth", "pred") if isinstance(data, str) else modeling.predict(model, data).select(q(model.outcome_cols[0]).alias("truth"), q(".pred").alias("pred"))
        return {"points": points, "correlation": found["model_metrics"]}
    if model.kind == "survival":
        return {"survival_curves": found["survival_curves"], "log_rank": found["log_rank"]}
    return {"roc_curve": found["roc_curve"]}
