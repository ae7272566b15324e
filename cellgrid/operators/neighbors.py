"""Nearest neighbours, densities, neighbour graphs and Jaccard coefficients.

Neighbours are exact. Cells are cut into blocks of a bounded size; a task holds one block of queries
and one of references, multiplies them as matrices and keeps k for each query; the best k over all
blocks follow. The work is quadratic, as exact search is; approximate=True hashes cells by random
projections first and compares only those that share a bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from ..table import Selector, columns, is_numeric, q
from .sample import join_groups

#: Cells of a block.
BLOCK = 4_096
#: References up to which (numbers in all) one copy goes to every task instead.
BROADCAST_NUMBERS = 4_000_000
METRICS = ("euclidean", "cosine", "l2", "ip")


def _vectors(df: DataFrame, cols: list[str], id_col: str, groups: Sequence[str] = ()) -> DataFrame:
    """(id, g, v): v from wide columns, or the one array column; g stands for the row's group."""
    if len(cols) == 1 and df.schema[cols[0]].dataType.typeName() == "array":
        v = q(cols[0]).cast("array<double>")
    else:
        v = F.array(*[q(c).cast("double") for c in cols])
    return df.select(q(id_col).cast("long").alias("id"), _grouped(df, list(groups)).alias("g"), v.alias("v"))


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["v"].tolist(), float).reshape(len(pdf), -1) if len(pdf) else np.empty((0, 0))


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    product = a @ b.T
    if metric == "ip":
        return 1 - product
    if metric == "cosine":
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        return 1 - np.divide(product, norm, out=np.zeros_like(product), where=norm > 0)
    square = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * product, 0)
    return square


def exact_distance(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, without the cancellation of the matrix form."""
    if metric in ("euclidean", "l2"):
        s = ((x - y) ** 2).sum(1)
        return np.sqrt(s) if metric == "euclidean" else s
    p = (x * y).sum(1)
    if metric == "ip":
        return 1 - p
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return 1 - np.divide(p, norm, out=np.zeros_like(p), where=norm > 0)


def nearest(ids: np.ndarray, a: np.ndarray, ref_ids: np.ndarray, b: np.ndarray, k: int, metric: str, leave_self: bool) -> pd.DataFrame:
    """(cell_id, neighbor_id, distance): the k nearest references of each query, ties by id."""
    found = []
    for start in range(0, len(a), 512):
        part, own = a[start : start + 512], ids[start : start + 512]
        d = distances(part, b, metric)
        if leave_self:
            d[own[:, None] == ref_ids[None, :]] = np.inf
        take = min(k + 8, d.shape[1])
        at = np.argpartition(d, take - 1, axis=1)[:, :take] if take < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        rows = np.repeat(np.arange(len(part)), at.shape[1])
        at = at.ravel()
        keep = np.isfinite(d[rows, at])
        rows, at = rows[keep], at[keep]
        exact = exact_distance(part[rows], b[at], metric)
        order = np.lexsort((ref_ids[at], exact, rows))
        rows, at, exact = rows[order], at[order], exact[order]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        good = rank < k
        found.append(pd.DataFrame({"cell_id": own[rows[good]], "neighbor_id": ref_ids[at[good]], "distance": exact[good]}))
    return pd.concat(found) if found else pd.DataFrame({"cell_id": np.empty(0, np.int64), "neighbor_id": np.empty(0, np.int64), "distance": np.empty(0)})


def _grouped(df: DataFrame, groups: list[str]) -> Column:
    """A number for a row's group; neighbours are looked for in the group alone."""
    if not groups:
        return F.lit(0).cast("long")
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), q(g).cast("string")), F.lit("")) for g in groups])


def _by_group(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(group[order])) + 1, len(order))
    for start, end in zip(np.append(0, ends[:-1]), ends, strict=True):
        if end > start:
            yield int(group[order[start]]), order[start:end]


def _meet(asks: DataFrame, refs: DataFrame, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """work(ids, vectors, reference ids, reference vectors) over queries and references (id, g, v) of one group: blocks of them, so in parts.

    A few references go to every task; beyond, every block of queries meets every block of references of
    its group in a task of its own.
    """
    size = refs.agg(F.sum(F.size("v"))).first()[0] or 0
    if size <= BROADCAST_NUMBERS:
        held = refs.toPandas()
        parts = {g: held.iloc[at] for g, at in _by_group(held["g"].to_numpy(np.int64))}
        parts = {g: (p["id"].to_numpy(np.int64), _matrix(p)) for g, p in parts.items()}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for g, at in _by_group(pdf["g"].to_numpy(np.int64)):
                    if g in parts:
                        own = pdf.iloc[at]
                        yield work(own["id"].to_numpy(np.int64), _matrix(own), *parts[g])

        cores = asks.sparkSession.sparkContext.defaultParallelism
        return asks.repartition(cores, "id").mapInPandas(run, schema)
    cuts = lambda d, name: d.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias(name))
    shape = materialize(cuts(asks, "n_ask").join(cuts(refs, "n_ref"), "g"))
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(shape, "g").withColumn("i", place("n_ask")).withColumn("j", every("n_ref"))
    right = refs.join(shape, "g").withColumn("j", place("n_ref")).withColumn("i", every("n_ask"))

    def pair(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        return work(a["id"].to_numpy(np.int64), _matrix(a), b["id"].to_numpy(np.int64), _matrix(b))

    # Under names of their own, as queries and references may be the same table.
    both = [d.select(*[F.col(c).alias(c) for c in ("g", "i", "j", "id", "v")]).groupBy("g", "i", "j") for d in (left, right)]
    return both[0].cogroup(both[1]).applyInPandas(pair, schema)


def find_knn(
    df: DataFrame, cols: Selector = None, k: int = 10, metric: str = "euclidean", id_col: str = "cell_id", query: DataFrame | None = None, approximate: bool = False, seed: int = 0, by: Selector = None,
) -> DataFrame:
    """(cell_id, rank, neighbor_id, distance): ranks from 1. Without query a cell is no neighbour of its own.

    by: neighbours are looked for among the cells of the same group, for all groups in one pass.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    groups = columns(df, by)
    names = [c for c in columns(df, cols, is_numeric) if c != id_col and c not in groups]
    refs = materialize(_vectors(df, names, id_col, groups))
    asks = refs if query is None else materialize(_vectors(query, names, id_col, groups))
    leave = query is None
    if approximate:
        best = _bucketed(asks, refs, k, metric, leave, seed)
    else:
        best = _meet(asks, refs, lambda ids, a, ref_ids, b: nearest(ids, a, ref_ids, b, k, metric, leave), "cell_id long, neighbor_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy("distance", "neighbor_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("cell_id", "rank", "neighbor_id", "distance")


def count_within(df: DataFrame, cols: Selector, radius: DataFrame, metric: str = "euclidean", id_col: str = "cell_id", by: Selector = None) -> DataFrame:
    """(cell_id, within): how many other cells of its group are closer to a cell than the group's radius (g, radius); no list of them is made."""
    groups = columns(df, by)
    names = [c for c in columns(df, cols, is_numeric) if c != id_col and c not in groups]
    cells = _vectors(df, names, id_col, groups)
    refs = materialize(cells)
    asks = materialize(refs.join(radius, "g").withColumn("v", F.concat("v", F.array("radius"))).drop("radius"))

    def count(ids: np.ndarray, a: np.ndarray, ref_ids: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        a, limit = a[:, :-1], a[:, -1]
        found = np.zeros(len(a), np.int64)
        for start in range(0, len(a), 512):
            part, own, r = a[start : start + 512], ids[start : start + 512], limit[start : start + 512, None]
            d = distances(part, b, metric)
            edge = r * r if metric == "euclidean" else r
            slack = 1e-9 * (np.abs(d).max() + 1)
            inside = d < edge - slack
            i, j = np.nonzero((d >= edge - slack) & (d <= edge + slack))
            inside[i, j] = exact_distance(part[i], b[j], metric) < r[i, 0]
            inside[own[:, None] == ref_ids[None, :]] = False
            found[start : start + 512] = inside.sum(1)
        return pd.DataFrame({"cell_id": ids, "within": found})

    return _meet(asks, refs, count, "cell_id long, within long").groupBy("cell_id").agg(F.sum("within").alias("within"))


def _bucketed(asks: DataFrame, refs: DataFrame, k: int, metric: str, leave: bool, seed: int, tables: int = 8, width: int = 6, most_width: int = 40) -> DataFrame:
    """Cells meet in a bucket of some table: signs of random projections, more of them the more cells there are, so that buckets keep about BLOCK cells.

    Buckets over BLOCK cells are cut into blocks.
    """
    first = refs.first()
    schema = "cell_id long, neighbor_id long, distance double"
    if first is None:
        return asks.sparkSession.createDataFrame([], schema)
    n = refs.count()
    width = min(most_width, max(width, int(np.ceil(np.log2(max(1.0, n / BLOCK))))))
    planes = np.random.default_rng(seed).normal(size=(tables * width, len(first["v"])))
    middle = np.array(refs.agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(planes.shape[1])])).first()[0], float)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            signs = (_matrix(pdf) - middle) @ planes.T > 0
            codes = signs.reshape(len(pdf), tables, width) @ (1 << np.arange(width))
            for t in range(tables):
                yield pd.DataFrame({"g": pdf["g"], "bucket": t * (1 << width) + codes[:, t], "id": pdf["id"], "v": pdf["v"]})

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (_matrix(p) for p in (a, b))
        ids, ref_ids = a["id"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
        return nearest(ids if len(y) else ids[:0], x if len(y) else x[:0], ref_ids, y, k, metric, leave)

    kinds = "g long, bucket long, id long, v array<double>"
    right = refs.mapInPandas(dealt, kinds)
    cuts = materialize(right.groupBy("g", "bucket").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("cuts")))
    right = right.join(cuts, ["g", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
    left = asks.mapInPandas(dealt, kinds).join(cuts, ["g", "bucket"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("piece", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("cuts")).cast("int"))
    right = right.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    both = [d.select("g", "bucket", "part", "piece", "id", "v").groupBy("g", "bucket", "part", "piece") for d in (left, right)]
    return both[0].cogroup(both[1]).applyInPandas(run, schema).dropDuplicates(["cell_id", "neighbor_id"])


def vote(near: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """(cell_id, name): the commonest label (neighbor_id, label) among a cell's neighbours, ties by label."""
    counts = near.join(labels, "neighbor_id").groupBy("cell_id", "label").agg(F.count("*").alias("n"))
    best = F.min_by("label", F.struct(-F.col("n"), F.col("label")))
    return counts.groupBy("cell_id").agg(best.alias(name))


def knn_density(df: DataFrame, cols: Selector = None, k: int = 15, metric: str = "euclidean", summary: str = "mean", normalize: bool = True, id_col: str = "cell_id", name: str = ".knn_density", by: Selector = None, **options) -> DataFrame:
    """(cell_id, name): minus the mean or sum of the distances to the k nearest cells, scaled to 0..1; in each group by itself."""
    near = find_knn(df, cols, k, metric, id_col, by=by, **options)
    total = F.avg if summary == "mean" else F.sum
    out = near.groupBy("cell_id").agg((-total(F.abs("distance"))).alias(name))
    return _to_unit(out, name, df, id_col, columns(df, by)) if normalize else out


def _to_unit(found: DataFrame, name: str, df: DataFrame, id_col: str, groups: list[str]) -> DataFrame:
    """found (cell_id, name) scaled to 0..1 in each group of df's cells."""
    scaled = F.try_divide(q(name) - F.col("__low"), F.col("__high") - F.col("__low"))
    ends = [F.min(q(name)).alias("__low"), F.max(q(name)).alias("__high")]
    if not groups:
        return found.join(F.broadcast(found.agg(*ends)), F.lit(True)).withColumn(name, scaled).drop("__low", "__high")  # one row
    marked = materialize(found.join(df.select(q(id_col).cast("long").alias("cell_id"), _grouped(df, groups).alias("__g")), "cell_id"))
    limits = materialize(marked.groupBy("__g").agg(*ends))  # its size decides how it is joined
    return marked.join(limits, "__g").withColumn(name, scaled).drop("__g", "__low", "__high")


def spade_density(
    df: DataFrame, cols: Selector = None, alpha_multiplier: float = 5.0, max_cells: int = 2_000, metric: str = "euclidean", normalize: bool = True, id_col: str = "cell_id", name: str = ".spade_density", seed: int = 0, by: Selector = None,
) -> DataFrame:
    """(cell_id, name): how many of a cell's nearest hundredth of all cells are within a radius; in each group by itself.

    The radius is alpha_multiplier times the median nearest distance among at most max_cells cells of the
    group. Cells within it are counted, and the count stops at a hundredth of the group's cells.
    """
    groups = columns(df, by)
    keys = [q(g) for g in groups]
    ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), q(id_col))))
    if groups:
        # Of each group only rows whose hash is low enough to be among the first can be in the sample.
        sizes = materialize(df.groupBy(*keys).agg(F.count("*").alias("__n")))
        share = F.shiftrightunsigned(F.xxhash64(F.lit(seed), q(id_col)), 11) / float(1 << 53)
        sample = join_groups(df, sizes).where(share <= F.least(F.lit(1.0), (max_cells + 6 * max_cells**0.5 + 6) / F.col("__n"))).drop("__n").withColumn("__r", ranked).where(F.col("__r") <= max_cells).drop("__r")
    else:
        sample = df.orderBy(F.xxhash64(F.lit(seed), q(id_col))).limit(max_cells)
    sample = materialize(sample)
    marked = sample.select(q(id_col).cast("long").alias("cell_id"), _grouped(sample, groups).alias("g"))
    gaps = marked.join(find_knn(sample, cols, 1, metric, id_col, by=by), "cell_id", "left").groupBy("g").agg(F.coalesce(F.median("distance"), F.lit(0.0)).alias("__d"))
    radius = materialize(gaps.select("g", (F.col("__d") * alpha_multiplier).alias("radius")))
    counts = count_within(df, cols, radius, metric, id_col, by)
    most = df.groupBy(_grouped(df, groups).alias("g")).agg(F.greatest(F.lit(1), F.round(F.count("*") * 0.01)).alias("__m"))
    of = df.select(q(id_col).cast("long").alias("cell_id"), _grouped(df, groups).alias("g"))
    met = counts.join(of, "cell_id").join(materialize(most), "g")
    out = met.select("cell_id", F.least("within", "__m").cast("double").alias(name))
    return _to_unit(out, name, df, id_col, groups) if normalize else out


def estimate_density(df: DataFrame, cols: Selector = None, method: str = "mean_distance", id_col: str = "cell_id", name: str | None = None, augment: bool = False, by: Selector = None, **options) -> DataFrame:
    """Local density of each cell by mean_distance, sum_distance or spade; by groups if any are given, all in one pass."""
    name = name or (".spade_density" if method == "spade" else ".knn_density")
    if method == "spade":
        out = spade_density(df, cols, id_col=id_col, name=name, by=by, **options)
    elif method in ("mean_distance", "sum_distance"):
        out = knn_density(df, cols, summary=method.split("_")[0], id_col=id_col, name=name, by=by, **options)
    else:
        raise ValueError("method must be mean_distance, sum_distance or spade")
    out = out.withColumnRenamed("cell_id", id_col)
    return df.join(out, id_col, "left") if augment else out


def knn_graph(near: DataFrame, metric: str = "euclidean", weighted: bool = True) -> DataFrame:
    """(src, dst, weight) from the table of neighbours."""
    weight = (1 - F.col("distance") if metric == "cosine" else 1 / (1 + F.col("distance"))) if weighted else F.lit(1.0)
    return near.select(F.col("cell_id").alias("src"), F.col("neighbor_id").alias("dst"), weight.alias("weight"))


def jaccard_edges(near: DataFrame) -> DataFrame:
    """(src, dst, weight): for each cell and neighbour the share of their neighbours that they have in common; zeros left out."""
    sets = materialize(near.groupBy("cell_id").agg(F.collect_set("neighbor_id").alias("s")))  # k ids each
    pairs = near.select("cell_id", "neighbor_id").join(sets.withColumnRenamed("s", "a"), "cell_id").join(sets.select(F.col("cell_id").alias("neighbor_id"), F.col("s").alias("b")), "neighbor_id")
    common = F.size(F.array_intersect("a", "b"))
    weight = common / (F.size("a") + F.size("b") - common)
    return pairs.select(F.col("cell_id").alias("src"), F.col("neighbor_id").alias("dst"), weight.alias("weight")).where("weight > 0")


