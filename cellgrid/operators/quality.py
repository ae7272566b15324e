"""Quality control of channels, acquisition and clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import MAD_SCALE, cut_bin, shannon_entropy, sum_rescale
from ..functions.special import t_quantile
from ..table import Selector, columns, is_numeric, q
from .cluster import classifier, distance_columns
from .neighbors import find_knn, vote
from .quantiles import exact_quantile
from .sample import join_groups


def assess_channels(
    df: DataFrame, channels: Selector = None, negative_threshold: float = math.asinh(2), negative_proportion_flag: float = 0.95
) -> DataFrame:
    """(channel, negative_proportion, flagged_channel): one scan for all channels."""
    names = columns(df, channels, is_numeric)
    shares = df.agg(*[F.avg((q(c) < negative_threshold).cast("double")).alias(c) for c in names])
    long = shares.unpivot([], [q(c) for c in names], "channel", "negative_proportion")
    return long.withColumn("flagged_channel", F.col("negative_proportion") > negative_proportion_flag)


def _with_bins(df: DataFrame, time_col: str, by: Selector, num_timesteps: int | None) -> DataFrame:
    groups = [q(c) for c in columns(df, by)]
    if num_timesteps is None or groups:
        rows = df.count()
        num_timesteps = max(1, rows // 1000) if num_timesteps is None else num_timesteps
        if num_timesteps > rows:
            raise ValueError("more time steps than cells")
    ends = df.groupBy(*groups).agg(F.min(q(time_col)).alias("__low"), F.max(q(time_col)).alias("__high"))
    return join_groups(df, ends).withColumn("timestep", cut_bin(q(time_col), F.col("__low"), F.col("__high"), num_timesteps)).drop("__low", "__high")


def flow_rate(df: DataFrame, time_col: str, num_timesteps: int | None = None, by: Selector = None) -> DataFrame:
    """(groups, timestep, num_cells): cells in each equal-width step of time; empty steps have no row."""
    groups = [q(c) for c in columns(df, by)]
    return _with_bins(df, time_col, by, num_timesteps).groupBy(*groups, "timestep").agg(F.count("*").alias("num_cells"))


def assess_flow_rate(
    df: DataFrame, time_col: str, by: Selector = None, num_timesteps: int | None = None, alpha_threshold: float = 0.01, augment: bool = False
) -> DataFrame:
    """Each cell's time step, how many cells it has and whether that is far from the usual (flagged_window).

    A step is far if its distance from the median in median absolute deviations is beyond the two-sided
    quantile of a t distribution with as many degrees of freedom as there are steps.
    """
    groups = [q(c) for c in columns(df, by)]
    binned = _with_bins(df, time_col, by, num_timesteps)
    counts = binned.groupBy(*groups, "timestep").agg(F.count("*").alias("num_cells"))
    middle = counts.groupBy(*groups).agg(F.median("num_cells").alias("__m"), F.count("*").alias("__k"))
    off = join_groups(counts, middle)
    spread = off.groupBy(*groups).agg((F.median(F.abs(F.col("num_cells") - F.col("__m"))) * MAD_SCALE).alias("__mad"))
    step_counts = [r[0] for r in middle.select("__k").distinct().collect()]  # at most one for each number of steps
    limit = F.lit(None).cast("double")
    for k in step_counts:
        limit = F.when(F.col("__k") == k, F.lit(t_quantile(1 - alpha_threshold / 2, k))).otherwise(limit)
    rate = join_groups(off, spread).withColumn("__z", F.try_divide(F.col("num_cells") - F.col("__m"), F.col("__mad")))
    rate = rate.withColumn("__flag", F.coalesce(F.abs("__z") > limit, F.lit(False))).select(*groups, F.col("timestep"), F.col("num_cells").alias("__cells"), "__flag")
    out = join_groups(binned, rate).withColumnsRenamed({"__cells": "num_cells", "__flag": "flagged_window"})
    return out if augment else out.select(*groups, q(time_col), "timestep", "num_cells", "flagged_window")


def assess_clusters_distance(
    df: DataFrame, cluster_col: str, markers: Selector = None, z_threshold: float = 3.0, augment: bool = False, per_cluster: bool = False
) -> DataFrame:
    """mahalanobis_distance to the own cluster's centre, its robust z_score and flagged_cell (z above the threshold).

    z is over all cells; per_cluster takes each cluster by itself.
    """
    names = columns(df, markers, is_numeric)
    fit = classifier(df, cluster_col, names)
    far = distance_columns(df, fit, names, "mahalanobis")
    own = F.coalesce(*[F.when(q(cluster_col).cast("string") == p, c) for p, c in far.items()])
    out = df.withColumn("mahalanobis_distance", own)
    by = [q(cluster_col)] if per_cluster else []
    if by:
        out = join_groups(out, out.groupBy(*by).agg(F.median("mahalanobis_distance").alias("__m")))
        out = join_groups(out, out.groupBy(*by).agg((F.median(F.abs(F.col("mahalanobis_distance") - F.col("__m"))) * MAD_SCALE).alias("__mad")))
    else:
        middle = exact_quantile(out, F.col("mahalanobis_distance"), 0.5)
        spread = exact_quantile(out, F.abs(F.col("mahalanobis_distance") - F.lit(middle)), 0.5)
        out = out.withColumns({"__m": F.lit(middle).cast("double"), "__mad": F.lit(None if spread is None else spread * MAD_SCALE).cast("double")})
    out = out.withColumn("z_score", F.try_divide(F.col("mahalanobis_distance") - F.col("__m"), F.col("__mad"))).withColumn("flagged_cell", F.col("z_score") > z_threshold)
    new = ["mahalanobis_distance", "z_score", "flagged_cell"]
    return out.select(*([q(c) for c in df.columns] if augment else []), *new)


def assess_clusters_entropy(
    df: DataFrame, cluster_col: str, markers: Selector = None, entropy_threshold: float | None = None, entropy_quantile: float = 0.9, num_closest_clusters: int | None = None, augment: bool = False,
) -> DataFrame:
    """entropy of how near a cell is to its closest clusters, flagged_cell and the distances mahalanobis_<cluster>."""
    names = columns(df, markers, is_numeric)
    fit = classifier(df, cluster_col, names)
    far = distance_columns(df, fit, names, "mahalanobis")
    k = min(num_closest_clusters or len(far), len(far))
    new = {f".mahalanobis_{p}": c for p, c in far.items()}
    wide = df.withColumns(new)
    near = wide.withColumn("__near", F.slice(F.sort_array(F.array(*[q(c) for c in new])), 1, k)).withColumn("__p", sum_rescale(F.col("__near")))
    near = near.withColumn("entropy", shannon_entropy(F.transform("__p", lambda x: 1 - x)))
    if entropy_threshold is None:
        entropy_threshold = exact_quantile(near, F.col("entropy"), entropy_quantile)
    near = near.withColumn("__limit", F.lit(entropy_threshold).cast("double"))
    out = near.withColumn("flagged_cell", F.col("entropy") > F.col("__limit"))
    return out.select(*([q(c) for c in df.columns] if augment else []), "entropy", "flagged_cell", *[q(c) for c in new])


def assess_clusters_knn(df: DataFrame, cluster_col: str, markers: Selector = None, num_neighbors: int = 10, id_col: str = "cell_id", augment: bool = False) -> DataFrame:
    """knn_cluster, the commonest cluster among the nearest cells, and whether it is another (flagged_cell)."""
    names = [c for c in columns(df, markers, is_numeric) if c != id_col]
    near = find_knn(df, names, num_neighbors, id_col=id_col)
    voted = vote(near, df.select(q(id_col).alias("neighbor_id"), q(cluster_col).cast("string").alias("label")), "knn_cluster")
    out = df.join(voted.withColumnRenamed("cell_id", id_col) if id_col != "cell_id" else voted, id_col, "left")
    out = out.withColumn("flagged_cell", F.col("knn_cluster") != q(cluster_col).cast("string"))
    return out if augment else out.select(q(id_col), "knn_cluster", "flagged_cell")


