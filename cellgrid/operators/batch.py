"""Batch correction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..table import Selector, columns, is_numeric, q
from .sample import join_groups


def batch_correct_rescale(df: DataFrame, channels: Selector = None, by: Selector = None, augment: bool = True) -> DataFrame:
    """Each channel to 0..1 by its range in the group; null where a group's values are equal.

    The ranges are one small aggregate joined back, so that no group has to be in one task.
    """
    names, group_names = columns(df, channels, is_numeric), columns(df, by)
    groups = [q(c) for c in group_names]
    names = [c for c in names if c not in group_names]
    ends = df.groupBy(*groups).agg(*[f(q(c)).alias(f"__{w}_{i}") for i, c in enumerate(names) for w, f in (("low", F.min), ("high", F.max))])
    met = join_groups(df, ends, write=True)
    scaled = {c: F.try_divide(q(c) - F.col(f"__low_{i}"), F.col(f"__high_{i}") - F.col(f"__low_{i}")) for i, c in enumerate(names)}
    out = met.withColumns(scaled)
    return out.select(*[q(c) for c in df.columns]) if augment else out.select(*groups, *[q(c) for c in names])


def batch_correct_quantile(df: DataFrame, channels: Selector = None, by: Selector = None, augment: bool = True) -> DataFrame:
    """Gives all cells of a group one distribution over channels: a value becomes the mean of its rank among the cells.

    Ranks are within a cell; tied values share the mean of the means of their ranks.
    """
    names, group_names = columns(df, channels, is_numeric), columns(df, by)
    groups = [q(c) for c in group_names]
    names = [c for c in names if c not in group_names]
    d = len(names)
    ranked = df.withColumn("__sorted", F.sort_array(F.array(*[q(c).cast("double") for c in names])))
    means = ranked.groupBy(*groups).agg(F.array(*[F.avg(F.get("__sorted", F.lit(r))) for r in range(d)]).alias("__means"))
    met = join_groups(ranked, means, write=True)

    def placed(c: str):
        x = q(c).cast("double")
        first = F.array_position("__sorted", x).cast("int")
        ties = F.size(F.filter("__sorted", lambda v: v == x))
        return F.when(ties == 1, F.get("__means", first - 1)).otherwise(F.aggregate(F.slice("__means", first, ties), F.lit(0.0), lambda a, v: a + v) / ties)

    out = met.withColumns({c: placed(c) for c in names})
    return out.select(*[q(c) for c in df.columns]) if augment else out.select(*groups, *[q(c) for c in names])


def batch_correct(df: DataFrame, channels: Selector = None, by: Selector = None, augment: bool = True, method: str = "rescale") -> DataFrame:
    verbs = {"rescale": batch_correct_rescale, "quantile": batch_correct_quantile}
    if method not in verbs:
        raise ValueError(f"method must be one of {sorted(verbs)}")
    return verbs[method](df, channels, by, augment)


