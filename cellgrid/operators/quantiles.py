"""Exact quantiles over all rows, without a task that sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one task may sort.
MOST = 1_000_000
#: Accuracy of the approximate quantiles that enclose the wanted place.
ACCURACY = 10_000


def exact_quantile(df: DataFrame, value: Column, share: float, most: int = MOST) -> float | None:
    """The quantile at share, between two values in proportion as percentile() does; None without values. Nulls do not count.

    Approximate quantiles enclose the wanted place; only the values between them are kept, and so on until
    a task can sort them.
    """
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = rows.count()
    if not n:
        return None
    place, below = share * (n - 1), 0  # values below the range that is left
    low_place, high_place = math.floor(place), math.ceil(place)
    while n > most:
        near = (low_place - below) / n, (high_place - below + 1) / n
        bounds = [max(0.0, near[0] - 3 / ACCURACY), min(1.0, near[1] + 3 / ACCURACY)]
        low, high = rows.agg(F.percentile_approx("v", bounds, ACCURACY)).first()[0]
        under, inside = rows.agg(F.count_if(F.col("v") < low), F.count_if((F.col("v") >= low) & (F.col("v") <= high))).first()
        if low == high or inside == n or not (below + under <= low_place and high_place < below + under + inside):
            if low == high and below + under <= low_place and high_place < below + under + inside:
                return float(low)
            break
        rows, below, n = rows.where((F.col("v") >= low) & (F.col("v") <= high)), below + under, inside
    held = rows.groupBy("v").agg(F.count("*").alias("k"))  # equal values are one
    return held.agg(F.percentile("v", (place - below) / (n - 1) if n > 1 else 0.0, F.col("k"))).first()[0]
