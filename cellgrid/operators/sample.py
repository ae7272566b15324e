"""Downsampling of cells."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize
from ..table import Selector, columns, is_numeric, q
from .quantiles import exact_quantile


#: Rows that a draw with replacement looks through in one task.
BUCKET_ROWS = 1_000_000


def _groups(df: DataFrame, by: Selector) -> list[Column]:
    return [q(c) for c in columns(df, by)]


def _ranked(df: DataFrame, by: list[Column], seed: int) -> DataFrame:
    """df with __n, its group's size, and __r, a random rank in the group.

    Without groups all rows would meet in one task; a random bucket first finds who can be among the
    first, see downsample_constant.
    """
    fixed = materialize(df.withColumn("__u", F.rand(seed)))
    sizes = fixed.groupBy(*by).agg(F.count("*").alias("__n"))
    return join_groups(fixed, sizes)


def join_groups(df: DataFrame, right: DataFrame, how: str = "inner", write: bool = False) -> DataFrame:
    """df with the columns of right whose names begin with __, which has one row for each group; null groups meet.

    write: right is written first. Its size is then known when the join is planned, and where it is small
    enough for a broadcast the rows of df are not dealt at all: for a df of cells.
    """
    right = materialize(right) if write else right
    names = [c for c in right.columns if not c.startswith("__")]
    if not names:
        return df.join(F.broadcast(right), F.lit(True), how)  # one row
    marked = right.select(*[q(c).alias(f"__by_{i}") for i, c in enumerate(names)], *[c for c in right.columns if c.startswith("__")])
    on = F.lit(True)
    for i, c in enumerate(names):
        on = on & q(c).eqNullSafe(F.col(f"__by_{i}"))
    return df.join(marked, on, how).drop(*[f"__by_{i}" for i in range(len(names))])


def _first_by_rank(ranked: DataFrame, by: list[Column], quota: Column, plain: list[str]) -> DataFrame:
    """The quota of rows with the least __u in each group, quota a column over __n.

    Only rows whose __u is near the quota's place need to be ranked: those clearly below stay, those
    clearly above go, so that a group of any size sends few rows to one task.
    """
    share = quota / F.col("__n")
    slack = 6 * F.sqrt(share * (1 - share) / F.col("__n")) + 6 / F.col("__n")
    marked = materialize(ranked.withColumn("__quota", quota).withColumn("__low", share - slack).withColumn("__high", share + slack))
    sure = marked.where(F.col("__u") < F.col("__low"))
    unsure = marked.where((F.col("__u") >= F.col("__low")) & (F.col("__u") <= F.col("__high")))
    counts = sure.groupBy(*by).agg(F.count("*").alias("__sure"))
    unsure = join_groups(unsure, counts, "left")
    w = Window.partitionBy(*by).orderBy("__u")
    more = unsure.withColumn("__r", F.row_number().over(w)).where(F.col("__r") + F.coalesce("__sure", F.lit(0)) <= F.col("__quota"))
    return sure.select(*[q(c) for c in plain]).union(more.select(*[q(c) for c in plain]))


def downsample_constant(df: DataFrame, by: Selector = None, num_cells: int = 1, seed: int = 0) -> DataFrame:
    """num_cells random cells of each group; groups with fewer keep all."""
    groups = _groups(df, by)
    ranked = _ranked(df, groups, seed)
    return _first_by_rank(ranked, groups, F.least(F.lit(num_cells), F.col("__n")), df.columns)


def downsample_prop(df: DataFrame, by: Selector = None, prop_cells: float = 1.0, seed: int = 0) -> DataFrame:
    """A share of each group's cells, rounded down, at random."""
    groups = _groups(df, by)
    ranked = _ranked(df, groups, seed)
    return _first_by_rank(ranked, groups, F.floor(F.lit(prop_cells) * F.col("__n") + 1e-9), df.columns)


def spade_bound(density: DataFrame, target: Column, by: list[Column]) -> DataFrame:
    """The groups with __bound: cells stay with the probability bound / density, and target of them on average.

    density: rows with __d above 0. Equal densities are summed up first; the windows then run over a
    group's distinct densities.
    """
    levels = density.groupBy(*by, "__d").agg(F.count("*").alias("__k"), F.max(target).alias("__t"))
    up = Window.partitionBy(*by).orderBy(F.col("__d").desc())
    before = Window.partitionBy(*by).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    x = levels.withColumn("__cdf", F.sum(F.col("__k") / F.col("__d")).over(up)).withColumn("__i", F.coalesce(F.sum("__k").over(before), F.lit(0)) + 1)
    whole = Window.partitionBy(*by)
    x = x.withColumn("__flat", F.max_by(F.col("__t") / F.col("__cdf"), F.col("__cdf")).over(whole)).withColumn("__least", F.min("__d").over(whole))
    want = (F.col("__t") - F.col("__i")) / F.col("__cdf")
    first = F.coalesce(F.min_by(want, F.when(want <= F.col("__d"), F.col("__i"))), F.min_by(want, F.col("__i")))
    return x.groupBy(*by).agg(F.when(F.max("__flat") > F.max("__least"), first).otherwise(F.max("__flat")).alias("__bound"))


def downsample_density(
    df: DataFrame, by: Selector = None, density_cols: Selector = None, target_percentile: float | None = 0.03, outlier_percentile: float = 0.01,
    target_num_cells: int | None = None, target_prop_cells: float | None = None, method: str = "mean_distance", id_col: str = "cell_id", seed: int = 0, **options,
) -> DataFrame:
    """Keeps cells with a probability that falls with their local density.

    Cells at or below outlier_percentile of density go. With a number or share of cells (rounded up) the
    bound follows from it; else it is the target_percentile of positive densities.
    """
    from .neighbors import estimate_density

    groups = _groups(df, by)
    channels = columns(df, density_cols, is_numeric)
    found = estimate_density(df, [c for c in channels if c != id_col], method=method, id_col=id_col, by=by, name="__d", augment=True, **options)
    found = materialize(found.withColumn("__u", F.rand(seed)))
    positive = found.where("__d > 0")
    at = lambda rows, share, name: rows.sparkSession.range(1).select(F.lit(exact_quantile(rows, F.col("__d"), share)).cast("double").alias(name))
    if target_num_cells is None and target_prop_cells is None and not groups:
        bounds = at(positive, float(target_percentile), "__bound")
    elif target_num_cells is None and target_prop_cells is None:
        bounds = positive.groupBy(*groups).agg(F.percentile("__d", F.lit(float(target_percentile))).alias("__bound"))
    else:
        sizes = found.groupBy(*groups).agg(F.count("*").alias("__n"))
        target = F.lit(float(target_num_cells)) if target_num_cells is not None else F.ceil(F.lit(target_prop_cells) * F.col("__n")).cast("double")
        bounds = spade_bound(join_groups(positive, sizes).withColumn("__target", target), F.col("__target"), groups)
    cut = found.groupBy(*groups).agg(F.percentile("__d", F.lit(float(outlier_percentile))).alias("__cut")) if groups else at(found, float(outlier_percentile), "__cut")
    kept = join_groups(join_groups(found, bounds), cut)
    return kept.where((F.col("__d") > F.col("__cut")) & (F.try_divide("__bound", "__d") > F.col("__u"))).select(*[q(c) for c in df.columns])


def slice_sample(df: DataFrame, n: int | None = None, prop: float | None = None, by: Selector = None, weight_by: str | None = None, replace: bool = False, seed: int = 0) -> DataFrame:
    """n random rows, or the share prop of the rows (rounded down), of each group.

    weight_by: a column of weights; null and zero weights are never drawn. replace: rows may be drawn more
    than once, and a group gives n of them however few it has; else it gives at most all that it has.
    """
    if (n is None) == (prop is None):
        raise ValueError("give n or prop")
    groups = _groups(df, by)
    quota = F.lit(n) if n is not None else F.floor(F.lit(prop) * F.col("__n") + 1e-9)
    if weight_by is None and not replace:
        return downsample_constant(df, by, n, seed) if n is not None else downsample_prop(df, by, prop, seed)
    weight = F.coalesce(q(weight_by).cast("double"), F.lit(0.0)) if weight_by else F.lit(1.0)
    if not replace:
        # The rows with the least -log(u) / weight are a weighted sample without replacement.
        fixed = materialize(df.withColumn("__w", weight).withColumn("__k", F.when(F.col("__w") > 0, -F.log(1 - F.rand(seed)) / F.col("__w"))))
        sizes = fixed.groupBy(*groups).agg(F.count("*").alias("__n"), F.count("__k").alias("__can"))
        wanted = join_groups(fixed, sizes).where("__k IS NOT NULL").withColumn("__quota", F.least(quota, F.col("__can")))
        share = F.col("__quota") / F.col("__can")
        slack = 6 * F.sqrt(share * (1 - share) / F.col("__can")) + 6 / F.col("__can")
        # Only rows up to a quantile beyond the quota's place need to be ranked.
        steps = [i / 200 for i in range(1, 201)]
        bound = wanted.groupBy(*groups).agg(F.max(F.least(F.lit(1.0), share + slack)).alias("__share"), F.percentile_approx("__k", steps, 10_000).alias("__q"))
        bound = bound.withColumn("__bound", F.get("__q", F.least(F.lit(199), F.ceil(F.col("__share") * 200)).cast("int"))).drop("__q", "__share")
        near = materialize(join_groups(wanted, bound).where(F.col("__k") <= F.col("__bound")))
        rank = F.row_number().over(Window.partitionBy(*groups).orderBy("__k"))
        return near.withColumn("__r", rank).where(F.col("__r") <= F.col("__quota")).select(*[q(c) for c in df.columns])
    # With replacement: a group's draws are dealt to buckets of rows by the buckets' weights, then to rows by where they fall on the running weights.
    buckets = -(-df.count() // BUCKET_ROWS) or 1
    numbered = materialize(df.withColumns({"__w": weight, "__id": F.monotonically_increasing_id()}).withColumn("__b", F.pmod(F.xxhash64("__id"), F.lit(buckets)).cast("int")))
    totals = numbered.groupBy(*groups, "__b").agg(F.count("*").alias("__rows"), F.sum("__w").alias("__all"))
    sizes = totals.groupBy(*groups).agg(F.sum("__rows").alias("__n"))
    wanted = join_groups(totals, sizes).select(*groups, "__b", "__all", quota.cast("long").alias("__quota"))
    schema = T.StructType([*wanted.schema.fields, T.StructField("__k", T.LongType())])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf["__all"].sum()
        rng = np.random.default_rng([seed, zlib.crc32(repr(pdf.drop(columns=["__b", "__all"]).iloc[0].tolist()).encode())])
        pdf = pdf.sort_values("__b")
        return pdf.assign(__k=rng.multinomial(int(pdf["__quota"].iloc[0]), pdf["__all"] / whole) if whole > 0 else 0)

    dealt = materialize(wanted.groupBy(*groups).applyInPandas(deal, schema))
    draws = dealt.where("__k > 0").withColumn("__draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__k")))).withColumn("__u", (1 - F.rand(seed)) * F.col("__all"))
    places = numbered.where("__w > 0").withColumn("__to", F.sum("__w").over(Window.partitionBy(*groups, "__b").orderBy("__id")))
    none = F.lit(None).cast("long")
    both = draws.select(*groups, "__b", F.col("__u").alias("__at"), none.alias("__id"), "__draw").union(places.select(*groups, "__b", F.col("__to").alias("__at"), "__id", none))
    following = Window.partitionBy(*groups, "__b").orderBy(F.col("__at"), F.col("__id").isNotNull()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = Window.partitionBy(*groups, "__b").orderBy(F.col("__at"), F.col("__id").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.coalesce(F.first("__id", ignorenulls=True).over(following), F.last("__id", ignorenulls=True).over(before))  # the sums' last bits may differ
    taken = materialize(both.withColumn("__hit", hit).where("__draw IS NOT NULL").select("__hit"))
    return numbered.join(taken, F.col("__id") == F.col("__hit")).select(*[q(c) for c in df.columns])


def downsample(df: DataFrame, by: Selector = None, method: str = "constant", **options) -> DataFrame:
    verbs = {"constant": downsample_constant, "prop": downsample_prop, "density": downsample_density}
    if method not in verbs:
        raise ValueError(f"method must be one of {sorted(verbs)}")
    return verbs[method](df, by, **options)
