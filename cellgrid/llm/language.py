"""Language identification: text, declarations, address suffixes and hosts weighed together.

A text's likelihood under each language comes from byte trigrams. What pages of a language tend to
declare, the suffixes of their addresses and the languages of a host are counted over the corpus,
with hosts smoothed towards their domain and domains towards everything. The posterior adds the logs; a
row's own text is left out of its host's and its domain's counts, as it is weighed already.
"""

from __future__ import annotations

import html as markup
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1 << 14
#: Most trigrams that a text's likelihood counts as: neighbours depend on each other.
EVIDENCE = 60.0
_HIDDEN = re.compile(r"<(script|style|head|nav)\b", re.I)
_CLOSING = re.compile(r"</(script|style|head|nav)\s{0,80}>", re.I)
_KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_SPACES = re.compile(rb" +")


class LanguageModel(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # bucket x language, log likelihood of a trigram


def visible_text(page: str) -> str:
    """What a page shows: no scripts, styles, head, navigation, comments or tags; entities replaced.

    One pass: a comment, or one of these elements, ends at its end mark, and one without an end mark is a tag
    like others; a tag ends at the next >, and the text after one without an end is shown.
    """
    closings: dict[str, list[tuple[int, int]]] = {}
    for m in _CLOSING.finditer(page):
        closings.setdefault(m[1].lower(), []).append((m.start(), m.end()))
    shown, at = [], 0
    while (lt := page.find("<", at)) >= 0:
        shown.append(page[at:lt])
        end = -1
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = end + 3 if end >= 0 else -1
        elif m := _HIDDEN.match(page, lt):
            ends = closings.get(m[1].lower(), [])
            k = bisect_left(ends, (m.end(), 0))
            end = ends[k][1] if k < len(ends) else -1
        if end < 0:
            end = page.find(">", lt) + 1
        if not end:
            at = lt
            break
        shown.append(" ")
        at = end
    return markup.unescape("".join(shown) + page[at:])


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each trigram of the letters, A-Z in lower case, with single spaces between words."""
    raw = _SPACES.sub(b" ", b" " + (text or "").encode("utf-8", "surrogatepass").translate(_KEEP) + b" ")
    if not raw.strip():
        return np.empty(0, np.int64)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    x = (b[:-2] * np.uint32(65_599) + b[1:-1]) * np.uint32(65_599) + b[2:]
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(18)).astype(np.int64)


def fit_language_model(
    labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 4_000, most_languages: int = 64
) -> LanguageModel:
    """Trigram model from about `sample` rows with a language, chosen by a hash of their text.

    The driver gets a count for each language and bucket in use, at most most_languages * BUCKETS.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    chosen = rows.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 20)) < int(min(1.0, sample / max(n, 1)) * (1 << 20)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                own = total.setdefault(lang.as_py(), np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "bucket", "n"])

    counts = chosen.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(count, "lang string, bucket int, n long")
    counts = stored(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    languages = [r.lang for r in counts.select("lang").distinct().orderBy("lang").limit(most_languages + 1).collect()]
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    got = counts.toPandas()
    table = np.full((BUCKETS, max(1, len(languages))), 0.5)
    where = {x: k for k, x in enumerate(languages)}
    table[got["bucket"].to_numpy(np.int64), got["lang"].map(where).to_numpy(np.int64)] += got["n"].to_numpy()
    return LanguageModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def identify_languages(
    docs: DataFrame,
    model: LanguageModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str | None = None,
    url_col: str | None = None,
    host_col: str | None = None,
    pages: bool = False,
    least: float = 0.5,
    strength: float = 8.0,
) -> DataFrame:
    """(id_col, lang, probability, text_lang, declared, suffix, host, kept), a row for each row of docs.

    text_lang is the likeliest language by text alone; lang takes the declared language, the address's
    suffix and the host into account. pages: texts are pages, whose html lang attribute is the declaration.
    Without url_col the host is host_col's value and there is no suffix. kept: the text has letters and
    the probability is at least `least`. A null or empty text, and one without letters, has no text_lang
    and is not kept, though lang follows from the rest. Null declarations, addresses and hosts say
    nothing. Ids may be null or repeat and are passed on; other columns are not looked at. An empty
    table gives an empty one; with a model without languages nothing is kept.
    """
    names, logs = model.languages, model.logs
    size = len(names)
    id_type = docs.schema[id_col].dataType.simpleString()
    string = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    url = F.lower(string(url_col))
    address = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    host = F.nullif(address, F.lit("")) if url_col else string(host_col)
    place = F.nullif(F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[-_/?#.]|$)", 1), F.lit(""))
    suffix = F.coalesce(place, F.nullif(F.regexp_extract(address, r"\.([a-z]{2,})$", 1), F.lit("")))
    declared = F.regexp_extract(F.col(text_col), r"(?i)<html(?=\s)[^<>]*?\slang\s{0,80}=\s{0,80}[\"']?([A-Za-z]{2,3})", 1) if pages else string(declared_col)
    declared = F.nullif(F.regexp_extract(F.lower(declared), r"^([a-z]{2,3})(?:[-_]|$)", 1), F.lit(""))
    # Names of docs' columns cannot meet those made here: only these are carried on.
    given = docs.select(F.col(id_col).alias("id"), declared.alias("declared"), suffix.alias("suffix"), host.alias("host"), F.col(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, grams = [], []
            for x in b.column(4):
                text = x.as_py() or ""
                at = trigrams(visible_text(text) if pages else text)
                n = len(at)
                grams.append(n)
                out.append((logs[at].sum(axis=0, dtype=np.float64) * min(1.0, EVIDENCE / n)).tolist() if n and size else [0.0] * size)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(grams, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["id", "declared", "suffix", "host", "n", "ll"])

    scored = stored(given.mapInArrow(score, f"id {id_type}, declared string, suffix string, host string, n long, ll array<double>"))
    if not size:
        none = F.lit(None).cast("string")
        return scored.select(F.col("id").alias(id_col), none.alias("lang"), F.lit(0.0).alias("probability"), none.alias("text_lang"), "declared", "suffix", "host", F.lit(False).alias("kept"))
    best = F.array_max("ll")
    odds = F.transform("ll", lambda x: F.exp(x - best))
    soft = scored.where("n > 0").withColumn("odds", odds)
    p = [F.col(f"p_{k}") for k in range(size)]
    sums = [F.sum(F.get("odds", F.lit(k)) / F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)).alias(f"p_{k}") for k in range(size)]
    totals = [F.sum(x).alias(f"p_{k}") for k, x in enumerate(p)]

    # One pass over the corpus counts declarations, suffixes and hosts; the rest works on these counts.
    counts = stored(soft.groupBy("declared", "suffix", "host").agg(*sums))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    hosts = stored(counts.groupBy("host").agg(*totals).withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain)))
    domains = hosts.groupBy("domain").agg(*totals)
    overall = [float(x or 0) + 1.0 for x in hosts.agg(*totals).first()]
    base = [x / sum(overall) for x in overall]

    domains = domains.select("domain", F.array(*p).alias("domain_p"))
    by_host = hosts.where("host IS NOT NULL").join(domains, "domain").select("host", F.array(*p).alias("host_p"), "domain_p")

    def likelihood(col: str) -> DataFrame:
        """The log of how often each language comes with the value, among rows that have one."""
        seen = counts.where(F.col(col).isNotNull()).groupBy(col).agg(*totals)
        every = seen.agg(*totals, F.count("*").alias("kinds"))
        every = every.select("kinds", *[F.col(f"p_{k}").alias(f"all_{k}") for k in range(size)])
        each = [F.log((F.col(f"p_{k}") + 0.5) / (F.col(f"all_{k}") + 0.5 * (F.col("kinds") + 1))) for k in range(size)]
        return seen.join(F.broadcast(every), F.lit(True)).select(col, F.array(*each).alias(f"{col}_log"))  # every is one row

    met = scored.join(stored(by_host), "host", "left")
    for col in ("declared", "suffix"):
        met = met.join(stored(likelihood(col)), col, "left")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:

            def matrix(name: str, b: pa.RecordBatch = b) -> tuple[np.ndarray, np.ndarray]:
                """The arrays of a column as rows, zeros where there is none, and where there is one."""
                given = b.column(name).is_valid().to_numpy(zero_copy_only=False)
                rows = np.zeros((b.num_rows, size))
                rows[given] = b.column(name).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                return rows, given

            ll, n = matrix("ll")[0], b.column("n").to_numpy()
            odds = np.exp(ll - ll.max(1, keepdims=True))
            own = np.where((n > 0)[:, None], odds / odds.sum(1, keepdims=True), 0.0)

            def smooth(counts: np.ndarray, up: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                """Shares of the counts without the row's own, smoothed towards up."""
                less = np.maximum(counts - own, 0)
                return (less + strength * up) / (less.sum(1, keepdims=True) + strength)

            host, has_host = matrix("host_p")
            prior = np.where(has_host[:, None], smooth(host, smooth(matrix("domain_p")[0], np.array(base))), np.array(base))
            total = ll + np.log(prior) + matrix("declared_log")[0] + matrix("suffix_log")[0]
            probability = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            called = pa.array([names[k] for k in total.argmax(1).tolist()], pa.string())
            by_text = pa.array([names[k] if m else None for k, m in zip(ll.argmax(1).tolist(), n.tolist(), strict=True)], pa.string())
            kept = pa.array((n > 0) & (probability >= least))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), called, pa.array(probability), by_text, b.column("declared"), b.column("suffix"), b.column("host"), kept],
                ["id", "lang", "probability", "text_lang", "declared", "suffix", "host", "kept"],
            )

    wanted = met.select("id", "declared", "suffix", "host", "n", "ll", "host_p", "domain_p", "declared_log", "suffix_log")
    done = wanted.mapInArrow(decide, f"id {id_type}, lang string, probability double, text_lang string, declared string, suffix string, host string, kept boolean")
    return done.withColumnRenamed("id", id_col)
