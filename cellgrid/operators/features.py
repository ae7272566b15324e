"""Features of samples: what clusters make up, and how channels look in them.

Each verb is one aggregation of the cells; all later steps work on groups times clusters.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from ..table import Selector, columns, is_numeric, q
from .sample import join_groups

#: Values that a group must have on either side of a comparison of distributions.
LEAST_VALUES = 10
#: Columns that a wide result has at most.
MAX_WIDE = 20_000


def _wide(long: DataFrame, groups: list[str], key: Column, value: str, fill: float | None = None) -> DataFrame:
    """A column for each distinct key, in order, found in one small pass and named in the pivot."""
    keyed = long.withColumn("__key", key)
    names = [r[0] for r in keyed.select("__key").where("__key IS NOT NULL").distinct().orderBy("__key").limit(MAX_WIDE + 1).collect()]
    if len(names) > MAX_WIDE:
        raise ValueError(f"more than {MAX_WIDE} columns")
    out = keyed.groupBy(*[q(g) for g in groups]).pivot("__key", names).agg(F.first(value))
    return out.fillna(fill, names) if fill is not None and names else out


def _stim(cols: list[str]) -> Column:
    return F.concat_ws("_", *[q(c).cast("string") for c in cols])


def extract_proportion(df: DataFrame, cluster_col: str, by: Selector = None, format: str = "wide") -> DataFrame:
    """Share of each cluster in each group's cells; clusters that a group lacks have 0. Wide: prop@<cluster>."""
    groups = columns(df, by)
    g = [q(c) for c in groups]
    counts = df.groupBy(*g, q(cluster_col)).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*g).agg(F.sum("__n").alias("__total"))
    clusters = counts.select(q(cluster_col)).distinct()
    scaffold = totals.crossJoin(clusters)  # groups times clusters, as many rows as the result has
    met = join_groups(scaffold, counts.select(*g, q(cluster_col), "__n"), "left")
    long = met.select(*g, q(cluster_col), (F.coalesce("__n", F.lit(0)) / F.col("__total")).alias("prop"))
    if format == "long":
        return long
    return _wide(long, groups, F.concat(F.lit("prop@"), q(cluster_col).cast("string")), "prop", 0.0)


def _summaries(df: DataFrame, cluster_col: str, markers: list[str], by: list[str], stim: list[str], fun: Callable[[Column], Column]) -> DataFrame:
    """(groups, cluster, stim columns, channel, values), from one aggregation."""
    keys = [q(c) for c in [*by, cluster_col, *stim]]
    made = df.groupBy(*keys).agg(*[fun(q(c)).cast("double").alias(c) for c in markers])
    return made.unpivot(keys, [q(c) for c in markers], "channel", "values")


def _marker_features(df: DataFrame, cluster_col: str, cols: Selector, by: Selector, stim_col: Selector, fun: Callable[[Column], Column], format: str, suffix: str, value: str) -> DataFrame:
    groups, stim = columns(df, by), columns(df, stim_col)
    markers = [c for c in columns(df, cols, is_numeric) if c not in (*groups, *stim, cluster_col)]
    long = _summaries(df, cluster_col, markers, groups, stim, fun).withColumnRenamed("values", value)
    if format == "long":
        return long
    parts = [_stim(stim), F.lit("_")] if stim else []
    return _wide(long, groups, F.concat(*parts, F.col("channel"), F.lit("@"), q(cluster_col).cast("string"), F.lit(suffix)), value)


def extract_central_tendency(
    df: DataFrame, cluster_col: str, cols: Selector = None, by: Selector = None, stimulation_col: Selector = None, fun: Callable[[Column], Column] = F.median, format: str = "wide"
) -> DataFrame:
    """fun of each channel in each group and cluster. Wide: <stimulation>_<channel>@<cluster>_ct."""
    return _marker_features(df, cluster_col, cols, by, stimulation_col, fun, format, "_ct", "values")


def extract_threshold(
    df: DataFrame, cluster_col: str, cols: Selector = None, by: Selector = None, stimulation_col: Selector = None, threshold: float = math.asinh(2), format: str = "wide"
) -> DataFrame:
    """Share of cells above a threshold. Wide: <stimulation>_<channel>@<cluster>_threshold."""
    share = lambda c: F.avg((c > threshold).cast("double"))
    return _marker_features(df, cluster_col, cols, by, stimulation_col, share, format, "_threshold", "values")


def compare_distributions(df: DataFrame, cluster_col: str, cols: Selector, by: Selector, level_col: str, reference_level: str, num_bins: int, kind: str) -> DataFrame:
    """(groups, cluster, level, channel, value): distance of each level's histogram from the reference level's.

    Bins are right-closed, num_bins - 1 of them between the whole numbers around both levels' values.
    Fewer than LEAST_VALUES values on a side, or no width, give null. Cells meet once in a histogram of
    counts; all else works on bins.
    """
    groups = columns(df, by)
    markers = [c for c in columns(df, cols, is_numeric) if c not in (*groups, level_col, cluster_col)]
    keys = [q(c) for c in [*groups, cluster_col]]
    names = [*groups, cluster_col]
    values = [q(c) for c in names]
    long = df.unpivot([*keys, q(level_col)], [q(c).cast("double").alias(c) for c in markers], "channel", "__x").where(F.col("__x").isNotNull())
    ends = long.groupBy(*values, q(level_col), "channel").agg(F.min("__x").alias("__a"), F.max("__x").alias("__b"), F.count("*").alias("__n"))
    is_ref = q(level_col).cast("string") == reference_level
    marker = [*names, "channel"]
    ref = ends.where(is_ref).select(*[q(c) for c in marker], F.col("__a").alias("__ra"), F.col("__b").alias("__rb"), F.col("__n").alias("__rn"))
    pairs = join_groups(ends.where(~is_ref), ref)
    low, high = F.floor(F.least("__a", "__ra")), F.ceil(F.greatest("__b", "__rb"))
    # Written: used three times, and its size decides whether cells have to be dealt to meet it.
    pairs = materialize(pairs.select(*[q(c) for c in marker], q(level_col).alias("__level"), F.col("__n").alias("__n1"), F.col("__rn").alias("__n2"), low.alias("__low"), high.alias("__high")))
    bins = num_bins - 1
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("__x") - F.col("__low")) * bins / (F.col("__high") - F.col("__low"))))).cast("int")

    def histogram(cells: DataFrame, other: DataFrame, on_level: bool) -> DataFrame:
        met = join_groups(cells, other.select(*[q(c) for c in marker], *([F.col("__level").alias(level_col)] if on_level else []), *[F.col(c).alias(c) for c in ("__low", "__high")], *([] if on_level else ["__level"])))
        level = q(level_col) if on_level else F.col("__level")
        return met.where("__high > __low").groupBy(*[q(c) for c in marker], level.alias("__level"), place.alias("__bin")).agg(F.count("*").alias("__c"))

    first = histogram(long.where(~is_ref), pairs, True).withColumn("__side", F.lit(1))
    second = histogram(long.where(is_ref), pairs, False).withColumn("__side", F.lit(2))
    both = first.unionByName(second).groupBy(*[q(c) for c in marker], "__level", "__bin").agg(
        F.sum(F.when(F.col("__side") == 1, F.col("__c")).otherwise(0)).alias("__c1"), F.sum(F.when(F.col("__side") == 2, F.col("__c")).otherwise(0)).alias("__c2")
    )
    total = pairs.select(*[q(c) for c in marker], F.col("__level").alias("__lv"), "__n1", "__n2", "__low", "__high")
    shares = join_on(both, total, marker)
    p, r = F.col("__c1") / F.col("__n1"), F.col("__c2") / F.col("__n2")
    if kind == "emd":
        w = Window.partitionBy(*[q(c) for c in marker], "__level").orderBy("__bin")  # at most num_bins rows
        shares = shares.withColumn("__gap", F.abs(F.sum(p - r).over(w)) * (F.lead("__bin", 1).over(w) - F.col("__bin")))
        value = F.coalesce(F.sum("__gap"), F.lit(0.0))
    else:
        h = lambda s: F.when(s > 0, -s * F.log2(s)).otherwise(0.0)
        value = F.sum(h((p + r) / 2) - (h(p) + h(r)) / 2)
    made = shares.groupBy(*[q(c) for c in marker], F.col("__level").alias("__lv")).agg(value.alias("__value"))
    out = join_on(total.withColumnRenamed("__lv", "__level"), made, marker, "left")
    good = (F.col("__n1") >= LEAST_VALUES) & (F.col("__n2") >= LEAST_VALUES) & (F.col("__high") > F.col("__low"))
    return out.select(*values, F.col("__level").alias(level_col), "channel", F.when(good, F.col("__value")).alias(kind))


def join_on(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """left (with __level) and right (with __lv) where names and levels agree, nulls included."""
    renamed = right.withColumnsRenamed({c: f"__r{i}" for i, c in enumerate(names)})
    on = reduce(lambda a, b: a & b, [q(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(names)], F.col("__level").eqNullSafe(F.col("__lv")))
    return left.join(renamed, on, how).drop("__lv", *[f"__r{i}" for i in range(len(names))])


def _distribution_features(df, cluster_col, cols, by, level_col, reference_level, num_bins, format, kind) -> DataFrame:
    long = compare_distributions(df, cluster_col, cols, by, level_col, reference_level, num_bins, kind)
    if format == "long":
        return long
    key = F.concat(q(level_col).cast("string"), F.lit("_"), F.col("channel"), F.lit("@"), q(cluster_col).cast("string"), F.lit(f"_{kind}"))
    return _wide(long, columns(df, by), key, kind)


def extract_emd(df: DataFrame, cluster_col: str, cols: Selector = None, by: Selector = None, emd_col: str = "", reference_level: str = "", num_bins: int = 100, format: str = "wide") -> DataFrame:
    """Earth mover's distance from the reference level, in bins. Wide: <level>_<channel>@<cluster>_emd."""
    return _distribution_features(df, cluster_col, cols, by, emd_col, reference_level, num_bins, format, "emd")


def extract_jsd(df: DataFrame, cluster_col: str, cols: Selector = None, by: Selector = None, jsd_col: str = "", reference_level: str = "", num_bins: int = 100, format: str = "wide") -> DataFrame:
    """Jensen-Shannon divergence from the reference level, in bits. Wide: <level>_<channel>@<cluster>_jsd."""
    return _distribution_features(df, cluster_col, cols, by, jsd_col, reference_level, num_bins, format, "jsd")


def extract_features(
    df: DataFrame, cluster_col: str, by: Selector, lineage_cols: Selector, signaling_cols: Selector, stimulation_col: str | None = None, basal_level: str | None = None,
    signaling_method: str = "threshold", fun: Callable[[Column], Column] = F.median, threshold: float = math.asinh(2), num_bins: int = 100,
) -> DataFrame:
    """Proportions, central values of lineage channels and signalling features of each group, side by side."""
    groups = columns(df, by)
    parts = [extract_proportion(df, cluster_col, groups), extract_central_tendency(df, cluster_col, lineage_cols, groups, fun=fun)]
    if signaling_method == "threshold":
        parts.append(extract_threshold(df, cluster_col, signaling_cols, groups, stimulation_col, threshold))
    elif signaling_method in ("central tendency", "central_tendency"):
        parts.append(extract_central_tendency(df, cluster_col, signaling_cols, groups, fun=fun))
    elif signaling_method in ("emd", "jsd"):
        if stimulation_col is None or basal_level is None:
            raise ValueError("emd and jsd need a stimulation column and its basal level")
        basal = df.where(q(stimulation_col).cast("string") == basal_level)
        basal = extract_central_tendency(basal, cluster_col, signaling_cols, groups, fun=fun)
        parts.append(basal.withColumnsRenamed({c: f"{basal_level}_{c}" for c in basal.columns if c not in groups}))
        verb = extract_emd if signaling_method == "emd" else extract_jsd
        parts.append(verb(df, cluster_col, signaling_cols, groups, stimulation_col, basal_level, num_bins))
    else:
        raise ValueError("signaling_method must be threshold, emd, jsd or central tendency")
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), F.lit(True)) if not groups else _left(out, part, groups)
    return out


def _left(a: DataFrame, b: DataFrame, names: list[str]) -> DataFrame:
    b = b.withColumnsRenamed({c: f"__r{i}" for i, c in enumerate(names)})
    on = reduce(lambda x, y: x & y, [q(c).eqNullSafe(F.col(f"__r{i}")) for i, c in enumerate(names)])
    return a.join(b, on, "left").drop(*[f"__r{i}" for i in range(len(names))])
