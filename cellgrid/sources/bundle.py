"""Exchange with other containers: a bundle of assay, channels, cells and embeddings; and frames for each sample."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sample import join_groups
from ..storage import materialize
from ..table import CellTable, Selector, columns, is_numeric, q
from .panel import channel_name, panel_of

#: Columns of embeddings, by their names.
REDUCED = {"pca": re.compile(r"^\.pc\d+$"), "tsne": re.compile(r"^\.tsne\d+$"), "umap": re.compile(r"^\.umap\d+$")}


def split_reduced(df: DataFrame, reduced: list[str] | None = None) -> dict[str, list[str]]:
    """Columns of each kind of embedding, and others of the given."""
    names = reduced if reduced is not None else [c for c in df.columns if any(p.match(c) for p in REDUCED.values())]
    out = {kind: [c for c in names if p.match(c)] for kind, p in REDUCED.items()}
    rest = [c for c in names if not any(c in v for v in out.values())]
    return {k: v for k, v in {**out, "other": rest}.items() if v}


def to_bundle(table: CellTable, channels: Selector = None, id_col: str = "cell_id") -> dict[str, DataFrame]:
    """assay (cell, channel, value), row_data (channels), col_data (what else is known of cells) and reduced_<kind>."""
    df = table.df
    reduced = split_reduced(df)
    taken = {c for v in reduced.values() for c in v}
    names = [c for c in columns(df, channels, is_numeric) if c not in taken and c != id_col]
    rest = [c for c in df.columns if c not in names and c not in taken and c != id_col]
    out = {
        "assay": df.unpivot([q(id_col)], [q(c).cast("double").alias(c) for c in names], "channel", "value"),
        "row_data": df.sparkSession.createDataFrame([(c,) for c in names], "marker_name string"),
        "col_data": df.select(q(id_col), *[q(c) for c in rest]),
    }
    return out | {f"reduced_{kind}": df.select(q(id_col), *[q(c) for c in cols]) for kind, cols in reduced.items()}


def write_bundle(table: CellTable, path: str, channels: Selector = None, id_col: str = "cell_id") -> None:
    for name, df in to_bundle(table, channels, id_col).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def from_bundle(parts: dict[str, DataFrame], id_col: str = "cell_id") -> CellTable:
    """The cell table that a bundle was made of."""
    names = [r[0] for r in parts["row_data"].collect()]  # a row for each channel
    df = parts["assay"].groupBy(q(id_col)).pivot("channel", names).agg(F.first("value"))
    for name, part in parts.items():
        if name == "col_data" or name.startswith("reduced_"):
            df = df.join(part, id_col, "left")
    return CellTable(df)


def read_bundle(spark: SparkSession, path: str, names: list[str] = ("assay", "row_data", "col_data"), id_col: str = "cell_id") -> CellTable:
    return from_bundle({n: spark.read.parquet(f"{path}/{n}") for n in names}, id_col)


def frame_parameters(df: DataFrame, by: Selector = None) -> DataFrame:
    """(groups, name, desc, range, minRange, maxRange): what a frame says of each numeric channel, from one aggregation."""
    groups = columns(df, by)
    names = [c for c in columns(df, None, is_numeric) if c not in groups]
    ends = df.groupBy(*[q(g) for g in groups]).agg(*[f(q(c)).cast("double").alias(f"{w}_{i}") for i, c in enumerate(names) for w, f in (("lo", F.min), ("hi", F.max))])
    rows = F.array(*[F.struct(F.lit(c.replace("|", "_")).alias("name"), F.lit(c.replace("|", "_")).alias("desc"), (F.col(f"hi_{i}") - F.col(f"lo_{i}")).alias("range"), F.col(f"lo_{i}").alias("minRange"), F.col(f"hi_{i}").alias("maxRange")) for i, c in enumerate(names)])
    return ends.select(*[q(g) for g in groups], F.explode(rows).alias("__r")).select(*[q(g) for g in groups], "__r.*")


@dataclass(frozen=True)
class Frame:
    """Cells of numeric channels with what is said of each channel (see frame_parameters)."""

    exprs: DataFrame
    parameters: DataFrame


@dataclass(frozen=True)
class FrameSet:
    """Frames of samples: cells with the name of their sample, a row of group columns for each sample, and parameters of all channels."""

    exprs: DataFrame
    metadata: DataFrame
    parameters: DataFrame


def as_frame(df: DataFrame) -> Frame:
    """The numeric channels of all cells as one frame; | in a channel's name becomes _."""
    names = columns(df, None, is_numeric)
    return Frame(df.select(*[q(c).cast("double").alias(c.replace("|", "_")) for c in names]), frame_parameters(df.select(*[q(c) for c in names])))


def as_frame_set(df: DataFrame, by: Selector) -> FrameSet:
    """A frame for each group, named Sample_1, Sample_2, ... in the groups' order; parameters are those of all cells together."""
    groups = columns(df, by)
    if not groups:
        raise ValueError("a set of frames needs groups")
    names = [c for c in columns(df, None, is_numeric) if c not in groups]
    keys = materialize(df.select(*[q(g) for g in groups]).distinct())
    place = F.row_number().over(Window.orderBy(*[q(g) for g in groups]))  # a row for each sample
    metadata = materialize(keys.withColumn("sample", F.concat(F.lit("Sample_"), place.cast("string"))))
    marked = join_groups(df, metadata.withColumnRenamed("sample", "__sample"))
    exprs = marked.select(F.col("__sample").alias("sample"), *[q(c).cast("double").alias(c.replace("|", "_")) for c in names])
    return FrameSet(exprs, metadata.select("sample", *[q(g) for g in groups]), frame_parameters(df.select(*[q(c) for c in names])))


def from_frame(frame: Frame, sep: str = "|") -> CellTable:
    """The cell table of a frame, its panel found from the parameters' names and descriptions as of a file."""
    rows = [(r["name"], r["desc"]) for r in frame.parameters.select("name", "desc").collect()]  # a row for each channel
    panel = panel_of([n for n, _ in rows], [d for _, d in rows])
    named = {n: channel_name(a, m, sep) for (n, _), (m, a) in zip(rows, panel, strict=True)}
    df = frame.exprs.select(*[q(c).alias(named.get(c, c)) for c in frame.exprs.columns])
    return CellTable(df, df.sparkSession.createDataFrame(panel, "metals string, antigens string"))


def from_pandas(spark: SparkSession, pdf, panel: DataFrame | None = None) -> CellTable:
    return CellTable(spark.createDataFrame(pdf)).with_panel(panel)


def from_spark(df: DataFrame, panel: DataFrame | None = None) -> CellTable:
    return CellTable(df).with_panel(panel)


def union_frames(tables: list[CellTable]) -> CellTable:
    """All rows, with the first table's panel."""
    if not tables:
        raise ValueError("no tables")
    df = tables[0].df
    for t in tables[1:]:
        df = df.unionByName(t.df, allowMissingColumns=True)
    return CellTable(df, tables[0].panel)
