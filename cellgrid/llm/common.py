"""What the corpus operators share: reading tables, cutting lineage, small expressions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of the operators define it.
WHITE = " \t\n\x0b\f\r"
#: Java pattern of a run of it.
WHITE_RUN = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="cellgrid-")
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Rows, and bytes where Spark knows the setting, that Python gets at a time: texts and sets of shingles may be megabytes each.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that begin meanwhile send BATCH at most to Python in one piece; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, release: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends here. The files go when the session's driver ends.

    release: the shuffle files behind it go at once. Nothing refers to them any more, but Spark removes what
    nothing refers to only when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cellgrid-scratch-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    if release:
        spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes tables that stored has written and that nothing will read again."""
    for df in dfs:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, although lambdas in body refer to it."""
    return F.transform(F.array(value), body).getItem(0)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does just that where all is ASCII, and faster."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column) -> Column:
    """The runs of other characters than ASCII white space, in order."""
    return let(
        F.btrim(c, F.lit(WHITE)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE_RUN)),
    )


def n_words_of(c: Column) -> Column:
    t = F.btrim(c, F.lit(WHITE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, WHITE_RUN))).cast("long")


def hash_pair(c: Column) -> tuple[Column, Column]:
    """128 bits of hash as two longs."""
    return F.xxhash64(c), F.xxhash64(F.lit(7), c)
