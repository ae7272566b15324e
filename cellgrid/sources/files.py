"""Reading and writing cell tables: CSV, Parquet and FCS, one file or many."""

from __future__ import annotations

import os.path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..table import CellTable, columns, q


def extension(path: str) -> str:
    return os.path.splitext(path.rstrip("/").rsplit("/", 1)[-1])[1].lstrip(".")


def _files(spark: SparkSession, path: str) -> list[str]:
    """Files of a folder (not of folders in it), or the file, found through the store's own file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    status = fs.getFileStatus(where)
    if status.isFile():
        return [path]
    return sorted(s.getPath().toString() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))


def read_csv(spark: SparkSession, path: str | list[str], panel: DataFrame | None = None, schema: T.StructType | str | None = None) -> CellTable:
    """CSV with a header; a schema saves the pass that infers types."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return CellTable(df).with_panel(panel)


def read_file(spark: SparkSession, path: str, sep: str = "|", panel: DataFrame | None = None) -> dict[str, CellTable]:
    kind = extension(path)
    if kind == "fcs":
        from .fcs import read_fcs

        return read_fcs(spark, path, sep)
    if kind == "csv":
        return {"1": read_csv(spark, path, panel)}
    if kind == "parquet":
        return {"1": CellTable(spark.read.parquet(path)).with_panel(panel)}
    raise ValueError(f"files of kind {kind!r} are not understood")


def read_data(spark: SparkSession, path: str | list[str], sep: str = "|", panel: DataFrame | None = None) -> dict[str, CellTable]:
    """Cell tables by panel number, from files or a folder; with more files than one there is a column file_name.

    CSV files of the same columns are one panel.
    """
    paths = [f for p in ([path] if isinstance(path, str) else path) for f in _files(spark, p)]
    kinds = {extension(p) for p in paths}
    if len(kinds) != 1:
        raise ValueError(f"files of one kind are needed, not {sorted(kinds)}")
    if kinds == {"fcs"}:
        from .fcs import read_fcs

        return read_fcs(spark, paths, sep, len(paths) > 1)
    if kinds != {"csv"}:
        return {k: v for p in paths for k, v in read_file(spark, p, sep, panel).items()}
    by_header: dict[tuple, list[str]] = {}
    for p in paths:
        by_header.setdefault(tuple(spark.read.option("header", True).csv(p).columns), []).append(p)
    out = {}
    for k, group in enumerate(by_header.values(), 1):
        table = read_csv(spark, group, panel)
        if len(paths) > 1:
            table = CellTable(table.df.select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name")), table.panel)
        out[str(k)] = table
    return out


def put(files: DataFrame, out_path: str, heads: dict[str, bytes] | None = None) -> None:
    """Writes rows (name, content) as files, from the driver's iterator: rows of one name that follow each other are one file, after its head if it has one.

    No more than the rows of a partition are held.
    """
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(out_path)
    fs = folder.getFileSystem(conf)
    fs.mkdirs(folder)
    stream = last = None
    try:
        for r in files.toLocalIterator():
            if stream is None or r["name"] != last:
                if stream is not None:
                    stream.close()
                last = r["name"]
                stream = fs.create(jvm.org.apache.hadoop.fs.Path(folder, last), True)
                if heads and last in heads:
                    stream.write(bytearray(heads[last]))
            stream.write(bytearray(r["content"]))
    finally:
        if stream is not None:
            stream.close()


def write_csv(df: DataFrame, out_path: str, by: str | list[str] | None = None, sep: str = "_", file_name: str | None = None, single_files: bool = False) -> None:
    """CSV by groups: a folder <group>.csv of parts for each group, without the group columns, written in parallel.

    single_files: one file for each group instead, made in one task each.
    """
    groups = columns(df, by)
    if not groups and not file_name:
        raise ValueError("without groups a file name is needed")
    rest = [c for c in df.columns if c not in groups]
    if not groups:
        df.select(*[q(c) for c in rest]).write.mode("overwrite").option("header", True).csv(f"{out_path}/{file_name.removesuffix('.csv')}.csv")
        return
    name = F.concat_ws(sep, *[q(g).cast("string") for g in groups])
    if not single_files:
        df.select(name.alias("group"), *[q(c) for c in rest]).write.mode("overwrite").option("header", True).partitionBy("group").csv(out_path)
        return
    ready = df.select(name.alias("__group"), *[q(c) for c in rest])

    def run(pdf):
        text = pdf[rest].to_csv(index=False)
        return pdf.iloc[:1][["__group"]].assign(name=pdf["__group"].iloc[0] + ".csv", content=text.encode())[["name", "content"]]

    put(ready.groupBy("__group").applyInPandas(run, "name string, content binary"), out_path)


def write_data(df: DataFrame, out_path: str, by: str | list[str] | None = None, format: str = "csv", sep: str = "_", file_name: str | None = None) -> None:
    if format == "csv":
        write_csv(df, out_path, by, sep, file_name)
    elif format == "fcs":
        from .fcs import write_fcs

        write_fcs(df, out_path, by, sep, file_name)
    else:
        raise ValueError("format must be csv or fcs")
