"""Where intermediate tables go: the folder in spark.checkpoint.dir, which all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What the names of intermediate tables begin with.
PREFIX = "cellgrid-scratch-"


def scratch_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cellgrid-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def materialize(df: DataFrame) -> DataFrame:
    """df written once as Parquet and read again: lineage ends, random columns keep their values.

    The files go when the session's driver ends; who needs the space before, calls drop_scratch.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{PREFIX}{uuid.uuid4().hex}"
    df.write.parquet(path)
    place, files = _files(spark, path)
    files.deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_scratch(spark: SparkSession) -> int:
    """Deletes all intermediate tables in the shared folder, and says how many there were; results not yet written are lost."""
    place, files = _files(spark, scratch_dir(spark))
    found = [f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith(PREFIX)]
    for path in found:
        files.delete(path, True)
    return len(found)
