"""Labels of a clustered reference carried over to other cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..table import Selector, columns, is_numeric, q
from .cluster import cluster_ddpr
from .neighbors import find_knn, vote

NAME = ".upsample_cluster"


def upsample_distance(df: DataFrame, reference: DataFrame, reference_cluster_col: str, cols: Selector = None, distance: str = "mahalanobis") -> DataFrame:
    """The reference cluster whose centre is closest."""
    return cluster_ddpr(df, reference, reference_cluster_col, cols, distance, name=NAME)


def upsample_neighbor(df: DataFrame, reference: DataFrame, reference_cluster_col: str, cols: Selector = None, num_neighbors: int = 1, metric: str = "euclidean", id_col: str = "cell_id") -> DataFrame:
    """The commonest cluster among the nearest reference cells, ties by name."""
    names = [c for c in columns(df, cols, lambda f: is_numeric(f) and f.name in reference.columns) if c != id_col]
    near = find_knn(reference, names, num_neighbors, metric, id_col, query=df)
    labels = reference.select(q(id_col).alias("neighbor_id"), q(reference_cluster_col).cast("string").alias("label"))
    voted = vote(near, labels, NAME).withColumnRenamed("cell_id", "__id")
    return df.join(voted, q(id_col) == F.col("__id"), "left").drop("__id")


def upsample(df: DataFrame, reference: DataFrame, reference_cluster_col: str, cols: Selector = None, method: str = "distance", augment: bool = True, **options) -> DataFrame:
    verbs = {"distance": upsample_distance, "neighbor": upsample_neighbor}
    if method not in verbs:
        raise ValueError(f"method must be one of {sorted(verbs)}")
    out = verbs[method](df, reference, reference_cluster_col, cols, **options)
    return out if augment else out.select(q(NAME))
