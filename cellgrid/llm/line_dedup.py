"""Drop lines that many documents share.

Normalised lines are exploded and hashed, the documents of each hash are counted, lines over the
threshold go, and what stays is put together again by position. Only hashes and positions are
dealt by key; the texts move once, to meet the positions to drop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, hash_pair, let, stored, text_or_empty


def line_keys(text: Column) -> Column:
    """A key for each \\n-split line: stripped of ASCII white space, A-Z in lower case."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))


def _kept(lines: Column, drop: Column) -> Column:
    """lines without the positions in drop (ascending), joined by \\n; linear in their number."""
    bounds = F.concat(F.array(F.lit(-1)), drop, F.array(F.size(lines)))
    runs = let(
        bounds,
        lambda b: F.transform(
            F.sequence(F.lit(1), F.size(b) - 1),
            lambda i: F.slice(lines, F.get(b, i - 1) + 2, F.get(b, i) - F.get(b, i - 1) - 1),
        ),
    )
    return F.array_join(F.flatten(runs), "\n")


def drop_frequent_lines(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with its frequent lines gone, and n_lines (before) and n_dropped.

    Each row counts as one document. A line's key is the line stripped of ASCII white space with
    A-Z in lower case; a key of at least min_chars code points found in at least min_docs documents
    loses all its lines. A null text counts as an empty one, that is as one empty line, and comes
    back empty; a text that loses all its lines comes back empty. Null, tied or repeated ids are
    fine: equal rows lose equal lines. Columns n_lines and n_dropped of the input are replaced;
    others pass through. An empty table gives an empty one.
    """
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars must be at least 1")
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), line_keys(text).alias("ks"))

    def hashed(df: DataFrame, *keep: str) -> DataFrame:
        h1, h2 = hash_pair(F.col("k"))
        return df.where(F.length("k") >= min_chars).select(*keep, h1.alias("h1"), h2.alias("h2"))

    # Written, so that both sides of the join are dealt by it alone and a line that very many have can be split.
    frequent = stored(
        hashed(keyed.select(F.explode(F.array_distinct("ks")).alias("k")))
        .groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    )
    found = hashed(keyed.select("id", "th", F.posexplode("ks").alias("pos", "k")), "id", "th", "pos")
    drops = (
        found.join(frequent, ["h1", "h2"], "left_semi")
        .groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
        .select(F.col("id").alias("__line_id"), F.col("th").alias("__line_th"), F.col("drop").alias("__line_drop"))
    )
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    met = (
        docs.withColumn("__line_text", text)
        .join(drops, F.col(id_col).eqNullSafe(F.col("__line_id")) & (F.xxhash64("__line_text") == F.col("__line_th")), "left")
        .withColumn("__line_drop", F.coalesce("__line_drop", F.array().cast("array<int>")))
    )
    done = let(
        F.split("__line_text", "\n", -1),
        lambda lines: F.struct(
            F.size(lines).cast("long").alias("n"),
            F.when(F.size("__line_drop") == 0, F.col("__line_text")).otherwise(_kept(lines, F.col("__line_drop"))).alias("t"),
        ),
    )
    out = met.withColumn("__line_done", done).select(
        *rest,
        F.col("__line_done.t").alias(text_col),
        F.col("__line_done.n").alias("n_lines"),
        F.size("__line_drop").cast("long").alias("n_dropped"),
    )
    return out.select(*[c for c in docs.columns if c in (*rest, text_col)], "n_lines", "n_dropped")
