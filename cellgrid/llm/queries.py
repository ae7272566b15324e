"""Queries over the corpus tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import answer_schema, exchanges_as_calls, format_chat
from .common import table
from .decontaminate import find_benchmark_leaks
from .language import fit_language_model, identify_languages
from .licenses import find_licences
from .line_dedup import drop_frequent_lines
from .mixing import mix_sources
from .quality import rate_quality
from .secrets import BASE_KINDS, count_kind, find_secrets, spans_text
from .simhash import simhash_groups
from .substring_dedup import passage_classes


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_classes(table(spark, sf_dir, "documents"), least_words=51, width=5, similarity=0.8)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return out.select(
        "doc_id",
        *[count_kind(F.col("spans"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
        count_kind(F.col("spans"), "novel").alias("n_novel"),
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_licences(table(spark, sf_dir, "documents"))
    starts = F.transform(F.filter("places", lambda p: p["exact"]), lambda p: p["start"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.filter("places", lambda p: p["exact"])).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate_quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no tool calls of its own: each question becomes a call whose result is its answer. Level and partner are -1 where there is none."""
    out = format_chat(exchanges_as_calls(table(spark, sf_dir, "conversations")), answer_schema(spark))
    none = lambda c: F.coalesce(c, F.lit(-1)).alias(c)
    return out.select("conv_id", "turn", "step", "role", "kind", "call_id", none("level"), none("partner"), "status", "json")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), budget=2, width=3, seed=42)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their doc_id, then pages as -1 - page_id: ids of the two tables overlap."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit_language_model(docs)
    ours = identify_languages(docs, model, declared_col="lang", host_col="source")
    theirs = identify_languages(pages, model, id_col="page_id", text_col="html", url_col="url", pages=True)
    return ours.union(theirs.withColumn("page_id", -1 - F.col("page_id")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=(1, 2, 3), cap=3)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=5, least=0.8)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_secrets, op3_licenses, op4_quality, op5_chat, op6_simhash, op7_line_dedup, op8_language_id, op9_mixing, op10_decontaminate)}

ORACLE = {
    "op5_chat": r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, 't' || (turn + 1) AS id, CASE WHEN turn >= 2 THEN 't' || (turn - 1) END AS needs, coalesce(text, '') AS text
                     FROM conversations WHERE role = 'user' AND turn IS NOT NULL),
r AS (SELECT conv_id, turn, 't' || turn AS id, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL),
ci AS (SELECT conv_id, id, min(turn) AS turn, count(*) AS n FROM c WHERE conv_id IS NOT NULL GROUP BY conv_id, id),
ri AS (SELECT conv_id, id, min(turn) AS turn, count(*) AS n FROM r WHERE conv_id IS NOT NULL GROUP BY conv_id, id),
e AS (SELECT DISTINCT conv_id, id, needs FROM c WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, id, 0 AS level FROM e WHERE needs IS NULL UNION ALL SELECT e.conv_id, e.id, l.level + 1 FROM e JOIN l ON e.conv_id = l.conv_id AND e.needs = l.id),
j AS (SELECT *, CASE WHEN needs IS NULL THEN json_object('chars', length(text), 'question', text)
                     ELSE json_object('chars', length(text), 'previous', '$' || needs, 'question', text) END AS arguments FROM c),
m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT conv_id, turn, 'assistant', '<tool_call>' || json_object('arguments', arguments, 'id', id, 'name', 'answer') || '</tool_call>' FROM j)
SELECT conv_id, turn, 0::INTEGER AS step, role, 'message' AS kind, NULL::VARCHAR AS call_id, 0::INTEGER AS level, -1::BIGINT AS partner, 'ok' AS status,
       CAST(json_object('content', text, 'role', role) AS VARCHAR) AS json FROM m
UNION ALL
SELECT j.conv_id, j.turn, 1, 'assistant', 'call', j.id, coalesce(l.level, -1), coalesce(ri.turn, -1),
       coalesce(nullif(concat_ws(', ', CASE WHEN ci.n > 1 THEN 'repeated id' END, CASE WHEN ri.turn IS NULL THEN 'no result' END, CASE WHEN ri.turn < j.turn THEN 'result first' END,
                                 CASE WHEN l.level IS NULL THEN 'cycle' END), ''), 'ok'),
       CAST(json_object('arguments', arguments, 'id', j.id, 'name', 'answer', 'type', 'call') AS VARCHAR)
FROM j LEFT JOIN ci USING (conv_id, id) LEFT JOIN ri USING (conv_id, id) LEFT JOIN l USING (conv_id, id)
UNION ALL
SELECT r.conv_id, r.turn, 0, 'tool', 'result', r.id, coalesce(l.level, -1), coalesce(ci.turn, -1),
       coalesce(nullif(concat_ws(', ', CASE WHEN ri.n > 1 THEN 'repeated id' END, CASE WHEN ci.turn IS NULL THEN 'no call' END, CASE WHEN r.turn < ci.turn THEN 'result first' END), ''), 'ok'),
       CAST(json_object('call', r.id, 'content', r.text, 'type', 'result') AS VARCHAR)
FROM r LEFT JOIN ci USING (conv_id, id) LEFT JOIN ri USING (conv_id, id) LEFT JOIN l USING (conv_id, id)
""",
    "op7_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, line, pos,
        translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.line, k.pos, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    # A target stops at three times its source: sources whose share is above their cap come first by ratio.
    "op9_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || md5(concat(coalesce(doc_id::VARCHAR, ''), '|', coalesce(text, '')))[:13])::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM s),
x AS (SELECT *, 1 + r % 3 AS w, source_size * 3 / (1 + r % 3) AS ratio FROM w),
y AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER below, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER below, 0)) AS rate
      FROM x WINDOW below AS (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least((source_size * 3)::DOUBLE, w * (SELECT arg_min(rate, (ratio, r)) FROM y WHERE rate <= ratio)) AS target FROM y),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM t),
b AS (SELECT *, greatest(round(target - passes * source_size), 0)::BIGINT AS rest FROM f),
c AS (SELECT source, place, sum(size)::BIGINT AS n FROM d GROUP BY source, place),
u AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place) - n AS before FROM c),
k AS (SELECT u.source, u.place, CASE WHEN before + n <= rest OR (before < rest AND 2 * (rest - before) > n) THEN 1 ELSE 0 END AS extra
      FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT d.doc_id, d.size, b.source_size, b.target, CASE WHEN d.size = 0 THEN 0 ELSE (b.passes + k.extra) * d.size END::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.place = k.place
""",
}
