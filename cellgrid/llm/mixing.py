"""Mix sources to target weights with thresholds on a hash.

Words are summed by source and hash bucket; in each source the budget falls into one bucket, which
alone is refined by the hash's next bits. What lies below the threshold is taken: a filter, no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words_of, stored, text_or_empty

#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


#: Bits of a document's place.
PLACE_BITS = 52


def place_of(id_: Column, text: Column) -> Column:
    """The first 52 bits of the MD5 of id and text, a hash that SQL engines share."""
    whole = F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), text)
    return F.conv(F.substring(F.md5(whole), 1, PLACE_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """totals (source, source_size) with target, full and budget.

    Sources by code point, null last, weigh weights[0], weights[1], ..., repeating, and share the sum
    of all sizes; a target stops at cap times its source's size and the excess goes to the others by
    weight until none is above. full: whole passes over the source; budget: words beyond them. The
    windows run over one row for each source.
    """
    ranked = totals.withColumn("__r", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.get(F.array(*[F.lit(int(x)) for x in weights]), F.col("__r") % len(weights))
    everything = Window.partitionBy()
    below = Window.orderBy("ratio", "__r").rowsBetween(Window.unboundedPreceding, -1)
    x = ranked.withColumn("w", w).withColumn("ratio", F.col("source_size") * cap / F.col("w"))
    x = x.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(below), F.lit(0)))
    x = x.withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0)))
    x = x.withColumn("rate", F.col("left") / F.col("left_w"))
    x = x.withColumn("rate", F.min_by(F.when(F.col("rate") <= F.col("ratio"), F.col("rate")), F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "__r"))).over(everything))
    target = F.least((F.col("source_size") * cap).cast("double"), F.col("rate") * F.col("w"))
    x = x.withColumn("target", target)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.greatest(F.round(F.col("target") - F.col("full") * F.col("source_size")).cast("long"), F.lit(0))
    x = x.withColumn("full", full).withColumn("budget", budget)
    # A budget of the whole source is one more pass over it.
    whole = (F.col("source_size") > 0) & (F.col("budget") >= F.col("source_size"))
    return x.select(
        "source", "source_size", "target", (F.col("full") + whole.cast("long")).alias("full"),
        F.when(whole, F.lit(0)).otherwise(F.col("budget")).cast("long").alias("budget"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    bits: int = 13,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """id_col, the columns in keep, and size, source_size, target, copies, taken for each row of docs.

    size is the number of words (runs of other characters than ASCII white space; null text: 0).
    copies is how often the mix takes the document, taken = copies * size; each source's sum of taken
    misses its target by at most half its boundary document. A document's place is a hash of its id
    and text, so reruns agree; rows equal in both go together. Null sources are one source, the last.
    Empty texts have size 0 and add nothing; in a source without words nothing is taken. Columns of
    docs named like those returned are replaced; an empty table gives an empty one. Names in keep are
    columns of docs to carry along.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    carry = [c for c in dict.fromkeys((id_col, *keep)) if c not in new]
    text = text_or_empty(text_col)
    sized = stored(docs.select(
        *[F.col(c).alias(f"in_{i}") for i, c in enumerate(carry)],
        F.col(source_col).alias("source"), n_words_of(text).alias("size"),
        place_of(F.col(id_col), text).alias("h"),
    ))
    state = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    facts = ["source", "source_size", "target", "full"]
    state = stored(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("closer", F.lit(False)))
    few = state.count() <= BROADCAST_SOURCES

    def meet(df: DataFrame, how: str) -> DataFrame:
        right = state.withColumnRenamed("source", "s")
        return df.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("s")), how).drop("s")

    levels = -(-PLACE_BITS // bits)
    for level in range(1, levels + 1):
        before, now = max(0, PLACE_BITS - bits * (level - 1)), max(0, PLACE_BITS - bits * level)
        inside = meet(sized.select("source", "size", "h"), "inner")
        if level > 1:
            inside = inside.where(F.shiftright("h", before) == F.col("prefix"))
        hist = inside.groupBy(*facts, "budget", "prefix", F.shiftright("h", now).alias("bucket")).agg(F.sum("size").alias("n"))
        up_to = Window.partitionBy("source").orderBy("bucket")
        crossed = hist.withColumn("sum", F.sum("n").over(up_to)).where((F.col("sum") > F.col("budget")) & (F.col("sum") - F.col("n") <= F.col("budget")) & (F.col("n") > 0))
        left = F.col("budget") - F.col("sum") + F.col("n")
        state = stored(crossed.select(*facts, left.alias("budget"), F.col("bucket").alias("prefix"), (left * 2 > F.col("n")).alias("closer")))
    extra = (F.col("h") < F.col("prefix")) | ((F.col("h") == F.col("prefix")) & F.col("closer"))
    out = meet(sized, "left").withColumn("copies", F.coalesce(F.col("full") + extra.cast("long"), F.lit(0)).cast("long"))
    return out.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(carry)],
        "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )
