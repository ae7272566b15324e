"""Flow rate of a running acquisition, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..table import Selector, columns, q


def stream_flow_rate(events: DataFrame, time_col: str, step: str = "1 hour", lateness: str = "2 hours", by: Selector = None) -> DataFrame:
    """(groups, start, end, num_cells): cells in each step of event time; steps close when the watermark has passed them.

    events may be a stream or a table. State is one count for each open step and group.
    """
    groups = [q(c) for c in columns(events, by)]
    counted = events.withWatermark(time_col, lateness).groupBy(F.window(q(time_col), step).alias("w"), *groups).agg(F.count("*").alias("num_cells"))
    return counted.select(*groups, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "num_cells")
