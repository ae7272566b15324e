"""From raw documents to a training mix: five stages, each written as Parquet and read again.

Stages take (spark, docs, sf_dir), work on all rows of docs and return the columns of documents; the
last adds how often the mix takes a document. docs has doc_id, text, lang, source and n_chars, each of
which may be null; ids may repeat. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm.common import stored, table
from cellgrid.llm.decontaminate import find_benchmark_leaks
from cellgrid.llm.language import fit_language_model, identify_languages
from cellgrid.llm.line_dedup import drop_frequent_lines
from cellgrid.llm.mixing import mix_sources
from cellgrid.llm.simhash import near_duplicate_groups


def _keyed(docs: DataFrame, *cols: str) -> DataFrame:
    """docs with __key: the id and a hash of cols, that is of all that a stage's verdict on a row follows from.

    Ids may be null or repeat. Rows with one key have one verdict, so that dropping by key drops only rows
    that were found themselves.
    """
    told = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in cols]
    return docs.withColumn("__key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64(*told).cast("string")))


def _without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """docs without the rows whose key is in gone; gone is written first, so that its size decides how it is joined."""
    return docs.join(stored(gone.select(F.col(key).alias("__gone")).distinct()), F.col(key) == F.col("__gone"), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty texts among them) and those of no clear language.

    The declared language is evidence, the source the host; either may be null. Each row is judged by itself,
    whatever other rows have its id.
    """
    marked = _keyed(docs, "text", "lang", "source")
    found = identify_languages(marked, fit_language_model(docs), id_col="__key", declared_col="lang", host_col="source")
    return _without(marked, found.where(~F.col("kept")), "__key").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that ten or more rows have, whatever their ids; n_chars follows. A null text becomes an empty one."""
    out = drop_frequent_lines(docs, min_docs=10)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose sets of five-word shingles are similar by 0.8 or more, directly or through others, one stays.

    That is the row with the smallest id, a null id only without others; of rows of one id that with the least
    hash of its text, then of all its columns. Rows of one id with different texts are different documents.
    """
    # Numbers are written with their rows, as ids may be null or repeat.
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()))
    groups = near_duplicate_groups(rows, similarity=0.8, width=5, id_col="__row")
    order = (F.col("doc_id").isNull().alias("no"), "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(*docs.columns).alias("all"))
    found = stored(rows.select("__row", *order).join(groups, "__row"))
    stays = found.groupBy("component_id").agg(F.min(F.struct("no", "doc_id", "h", "all", "__row"))["__row"].alias("stays"))
    gone = found.select("__row").join(stays, F.col("__row") == F.col("stays"), "left_anti")
    return _without(rows, gone, "__row").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item; other rows of their id stay, and so do null and empty texts."""
    marked = _keyed(docs, "text")
    return _without(marked, find_benchmark_leaks(marked, table(spark, sf_dir, "benchmark"), id_col="__key"), "__key").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with copies (how often) and taken (words); rows equal in id and text go together, empty texts are not taken."""
    rest = tuple(c for c in docs.columns if c not in ("copies", "taken"))
    out = mix_sources(docs, keep=rest)
    return out.where("copies > 0").select(*rest, "copies", "taken")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Fingerprints, trigram likelihoods and hash thresholds are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
