"""One query for each operator over the shared tables, with the SQL that must give the same rows.

Cells are the rows of lineitem: four channels, cluster l_returnflag, effect l_linestatus, sample
l_suppkey. Acquisition is events, vectors are embeddings, samples' outcomes come from orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs
from ..operators import batch, cluster, discovery, features, neighbors, preprocess, quality, reduce, sample, upsample

CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").drop("l_shipdate")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Rounded so that the order of additions does not show; no negative zero."""
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) + F.lit(0.0) for c in names})


def _doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return _round(df, [f.name for f in df.schema if f.dataType.typeName() == "double"], digits)


_KEYS = ", ".join(KEY)
_R = lambda x, d=6: f"round({x}, {d}) + 0.0"
_ASINH = {c: f"asinh({c} / 5)" for c in CHANNELS}


def _each(template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in CHANNELS)


@query(f"SELECT {_KEYS}, {', '.join(_R(_ASINH[c]) + f' AS {c}' for c in CHANNELS)} FROM lineitem")
def preprocess_asinh(spark, d):
    out = preprocess.preprocess(cells(spark, d), CHANNELS)
    return _round(out, CHANNELS).select(*KEY, *CHANNELS)


@query(f"SELECT {_KEYS}, {_R('asinh((floor(l_quantity) + 1) / 5)')} AS l_quantity FROM lineitem")
def preprocess_denoise(spark, d):
    return _round(preprocess.preprocess(cells(spark, d), ["l_quantity"], undo_noise=True), ["l_quantity"]).select(*KEY, "l_quantity")


@query(f"SELECT {_KEYS}, {_R('sinh(l_discount) / 0.2')} AS l_discount, {_R('sinh(l_tax) / 0.2')} AS l_tax FROM lineitem")
def postprocess_sinh(spark, d):
    return _round(preprocess.postprocess(cells(spark, d), ["l_discount", "l_tax"]), ["l_discount", "l_tax"]).select(*KEY, "l_discount", "l_tax")


@query(f"SELECT {_KEYS}, {_R('ln(1 + l_extendedprice)')} AS l_extendedprice FROM lineitem")
def transform_custom(spark, d):
    return _round(preprocess.transform(cells(spark, d), ["l_extendedprice"], lambda c: F.log(1 + c)), ["l_extendedprice"]).select(*KEY, "l_extendedprice")


@query(
    "WITH s AS (" + _each("SELECT '{c}' AS channel, avg((l.{c} < asinh(2))::INTEGER) AS p FROM lineitem l") + f") SELECT channel, {_R('p')} AS negative_proportion, p > 0.95 AS flagged_channel FROM s"
)
def assess_channels(spark, d):
    return _doubles(quality.assess_channels(cells(spark, d), CHANNELS))


_BIN = "CASE WHEN hi = lo THEN 1 ELSE greatest(1, least({b}, ceil((t - lo) * {b} / (hi - lo)))) END::INTEGER"
_TIMED = "SELECT event_id, event_type, epoch(ts) AS t FROM events"


def _timed(spark, d):
    return table(spark, d, "events").select("event_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) / 1e6D").alias("time"))


@query(f"WITH e AS ({_TIMED}), r AS (SELECT min(t) AS lo, max(t) AS hi FROM e) SELECT {_BIN.format(b=100)} AS timestep, count(*)::BIGINT AS num_cells FROM e, r GROUP BY 1")
def calculate_flow_rate(spark, d):
    return quality.flow_rate(_timed(spark, d), "time", 100)


def _assess_flow_sql(limit: float) -> str:
    return f"""
WITH e AS ({_TIMED}), r AS (SELECT event_type, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1),
b AS (SELECT event_id, e.event_type, {_BIN.format(b=50)} AS timestep FROM e JOIN r USING (event_type)),
n AS (SELECT event_type, timestep, count(*) AS num_cells FROM b GROUP BY 1, 2),
m AS (SELECT event_type, median(num_cells) AS m, mad(num_cells) * 1.4826 AS mad FROM n GROUP BY 1)
SELECT b.event_id, b.event_type, b.timestep, n.num_cells::BIGINT AS num_cells,
       coalesce(abs((n.num_cells - m.m) / nullif(m.mad, 0)) > {limit!r}, false) AS flagged_window
FROM b JOIN n USING (event_type, timestep) JOIN m USING (event_type)"""


def _flow_limit() -> float:
    from ..functions.special import t_quantile

    return t_quantile(1 - 0.01 / 2, 50)


@query(_assess_flow_sql(_flow_limit()))
def assess_flow_rate(spark, d):
    out = quality.assess_flow_rate(_timed(spark, d), "time", "event_type", 50, augment=True)
    return out.select("event_id", "event_type", "timestep", "num_cells", "flagged_window")


@query(f"SELECT {_KEYS}, l_returnflag, " + ", ".join(_R(f"(l.{c} - min(l.{c}) OVER w) / (max(l.{c}) OVER w - min(l.{c}) OVER w)") + f" AS {c}" for c in CHANNELS) + " FROM lineitem l WINDOW w AS (PARTITION BY l_returnflag)")
def batch_correct_rescale(spark, d):
    return _round(batch.batch_correct(cells(spark, d), CHANNELS, "l_returnflag", method="rescale"), CHANNELS).select(*KEY, "l_returnflag", *CHANNELS)


@query(
    f"""
WITH c AS (SELECT row_number() OVER () AS id, * FROM lineitem),
u AS ({" UNION ALL ".join(f"SELECT id, {_KEYS}, l_returnflag, '{c}' AS ch, {c} AS v FROM c" for c in CHANNELS)}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v) AS rn FROM u),
m AS (SELECT l_returnflag, rn, avg(v) AS mean FROM r GROUP BY 1, 2),
x AS (SELECT r.id, {", ".join("r." + k for k in KEY)}, r.ch, avg(m.mean) OVER (PARTITION BY r.id, r.v) AS y FROM r JOIN m USING (l_returnflag, rn))
SELECT {_KEYS}, {", ".join(_R(f"max(CASE WHEN ch = '{c}' THEN y END)", 4) + f" AS {c}" for c in CHANNELS)} FROM x GROUP BY id, {_KEYS}"""
)
def batch_correct_quantile(spark, d):
    return _round(batch.batch_correct(cells(spark, d), CHANNELS, "l_returnflag", method="quantile"), CHANNELS, 4).select(*KEY, *CHANNELS)


@query("SELECT l_suppkey, least(50, count(*))::BIGINT AS n FROM lineitem GROUP BY 1")
def downsample_constant(spark, d):
    return sample.downsample(cells(spark, d), "l_suppkey", "constant", num_cells=50, seed=1).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, floor(0.1 * count(*) + 1e-9)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING floor(0.1 * count(*) + 1e-9) > 0")
def downsample_prop(spark, d):
    return sample.downsample(cells(spark, d), "l_suppkey", "prop", prop_cells=0.1, seed=1).groupBy("l_suppkey").agg(F.count("*").alias("n"))


def _vec(spark, d):
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "cell_id")


_KNN = """
p AS (SELECT a.vec_id AS cell_id, b.vec_id AS neighbor_id,
      list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbor_id) AS rank FROM p QUALIFY rank <= {k})"""


@query(f"WITH {_KNN.format(k=10)} SELECT cell_id, rank::INTEGER AS rank, neighbor_id, {_R('distance')} AS distance FROM k")
def find_knn(spark, d):
    return _doubles(neighbors.find_knn(_vec(spark, d), ["embedding"], 10))


@query(f"WITH {_KNN.format(k=15)}, s AS (SELECT cell_id, -avg(distance) AS x FROM k GROUP BY 1) SELECT cell_id, {_R('(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())')} AS density FROM s")
def knn_density(spark, d):
    return _doubles(neighbors.knn_density(_vec(spark, d), ["embedding"], 15, name="density"))


@query()
def spade_density(spark, d):
    return _doubles(neighbors.estimate_density(_vec(spark, d), ["embedding"], "spade", name="density", alpha_multiplier=5.0, max_cells=100_000))


@query(f"WITH {_KNN.format(k=10)} SELECT cell_id AS src, neighbor_id AS dst, {_R('1 / (1 + distance)')} AS weight FROM k")
def knn_graph(spark, d):
    return _doubles(neighbors.knn_graph(neighbors.find_knn(_vec(spark, d), ["embedding"], 10)))


@query(
    f"""WITH {_KNN.format(k=15)}, s AS (SELECT cell_id, list(neighbor_id) AS l FROM k GROUP BY 1)
SELECT k.cell_id AS src, k.neighbor_id AS dst,
       {_R("len(list_intersect(a.l, b.l)) / (len(a.l) + len(b.l) - len(list_intersect(a.l, b.l)))::DOUBLE")} AS weight
FROM k JOIN s a ON a.cell_id = k.cell_id JOIN s b ON b.cell_id = k.neighbor_id WHERE len(list_intersect(a.l, b.l)) > 0"""
)
def jaccard_edges(spark, d):
    return _doubles(neighbors.jaccard_edges(neighbors.find_knn(_vec(spark, d), ["embedding"], 15)))


@query(
    f"""WITH {_KNN.format(k=5).replace("a.vec_id <> b.vec_id", "a.vec_id <> b.vec_id AND b.vec_id % 2 = 0 AND a.vec_id % 2 = 1")},
v AS (SELECT k.cell_id, e.label::VARCHAR AS label, count(*) AS n FROM k JOIN embeddings e ON e.vec_id = k.neighbor_id GROUP BY 1, 2)
SELECT cell_id, label AS upsample_cluster FROM v QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, label) = 1"""
)
def upsample_neighbor(spark, d):
    """The reference is one half of the vectors, the cells to label are the other: that is the operator's input."""
    v = _vec(spark, d)
    out = upsample.upsample(v.where("cell_id % 2 = 1"), v.where("cell_id % 2 = 0"), "label", ["embedding"], method="neighbor", num_neighbors=5)
    return out.select("cell_id", F.col("`.upsample_cluster`").alias("upsample_cluster"))


_FIT = "f AS (SELECT l_returnflag AS p, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) AS c FROM lineitem GROUP BY 1)"
_D2 = "((l_quantity - m1) ** 2 * c - 2 * (l_quantity - m1) * (l_discount - m2) * b + (l_discount - m2) ** 2 * a) / (a * c - b * b)"


@query(f"WITH {_FIT}, x AS (SELECT {_KEYS}, l_quantity AS q, l_discount AS dc, p, {_D2} AS d FROM lineitem, f) SELECT {_KEYS}, {', '.join(_R(f'max(CASE WHEN p = {chr(39)}{p}{chr(39)} THEN d END)', 4) + f' AS d_{p}' for p in 'ANR')} FROM x GROUP BY {_KEYS}, q, dc")
def ddpr_mahalanobis(spark, d):
    c = cells(spark, d)
    out = cluster.cluster(c, ["l_quantity", "l_discount"], "ddpr", healthy=c, healthy_label_col="l_returnflag", distance="mahalanobis", return_distances=True)
    return _doubles(out.groupBy(*KEY, "l_quantity", "l_discount").agg(*[F.max(f"`.mahalanobis_{p}`").alias(f"d_{p}") for p in "ANR"]).select(*KEY, *[f"d_{p}" for p in "ANR"]), 4)


@query(
    f"""WITH f AS (SELECT l_returnflag AS p, {", ".join(f"avg({c}) AS m_{c}" for c in CHANNELS)} FROM lineitem GROUP BY 1)
SELECT {_KEYS}, p AS population, {_R("1 - (" + " + ".join(f"{c} * m_{c}" for c in CHANNELS) + ") / (sqrt(" + " + ".join(f"{c} * {c}" for c in CHANNELS) + ") * sqrt(" + " + ".join(f"m_{c} * m_{c}" for c in CHANNELS) + "))")} AS distance
FROM lineitem, f"""
)
def ddpr_cosine(spark, d):
    c = cells(spark, d)
    out = cluster.cluster_ddpr(c, c, "l_returnflag", CHANNELS, "cosine", return_distances=True)
    return _doubles(out.unpivot(KEY, [F.col(f"`.cosine_{p}`").alias(p) for p in "ANR"], "population", "distance"))


@query(
    f"""WITH l AS (SELECT *, list_avg([{", ".join(CHANNELS)}]) AS xm FROM lineitem),
g AS (SELECT l_returnflag AS p, {", ".join(f"avg({c}) AS m_{c}" for c in CHANNELS)} FROM lineitem GROUP BY 1),
f AS (SELECT *, list_avg([{", ".join(f"m_{c}" for c in CHANNELS)}]) AS mm FROM g)
SELECT {_KEYS}, p AS population, {_R("1 - (" + " + ".join(f"({c} - xm) * (m_{c} - mm)" for c in CHANNELS) + ") / (sqrt(" + " + ".join(f"({c} - xm) ** 2" for c in CHANNELS) + ") * sqrt(" + " + ".join(f"(m_{c} - mm) ** 2" for c in CHANNELS) + "))")} AS distance
FROM l, f"""
)
def ddpr_pearson(spark, d):
    c = cells(spark, d)
    out = cluster.cluster_ddpr(c, c, "l_returnflag", CHANNELS, "pearson", return_distances=True)
    return _doubles(out.unpivot(KEY, [F.col(f"`.pearson_{p}`").alias(p) for p in "ANR"], "population", "distance"))


@query(f"WITH {_FIT}, x AS (SELECT {_KEYS}, l_quantity, l_discount, p, {_D2} AS d FROM lineitem, f) SELECT {_KEYS}, p AS upsample_cluster FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS}, l_quantity, l_discount, i ORDER BY d, p) AS r FROM (SELECT x.*, row_number() OVER (PARTITION BY {_KEYS}, l_quantity, l_discount, p) AS i FROM x)) WHERE r = 1")
def upsample_distance(spark, d):
    c = cells(spark, d)
    out = upsample.upsample(c, c, "l_returnflag", ["l_quantity", "l_discount"], method="distance")
    return out.select(*KEY, F.col("`.upsample_cluster`").alias("upsample_cluster"))


@query(
    f"""WITH {_FIT}, x AS (SELECT {_KEYS}, {_D2} AS d FROM lineitem JOIN f ON p = l_returnflag), m AS (SELECT median(d) AS m, mad(d) * 1.4826 AS s FROM x)
SELECT {_KEYS}, {_R("d", 4)} AS mahalanobis_distance, {_R("(d - m) / s", 4)} AS z_score, (d - m) / s > 3 AS flagged_cell FROM x, m"""
)
def assess_clusters_distance(spark, d):
    out = quality.assess_clusters_distance(cells(spark, d), "l_returnflag", ["l_quantity", "l_discount"], augment=True)
    return _round(out, ["mahalanobis_distance", "z_score"], 4).select(*KEY, "mahalanobis_distance", "z_score", "flagged_cell")


@query(
    f"""WITH {_FIT}, x AS (SELECT row_number() OVER () AS id, * FROM lineitem), y AS (SELECT id, {_KEYS}, p, {_D2} AS d FROM x, f),
s AS (SELECT *, d / sum(d) OVER (PARTITION BY id) AS w FROM y),
e AS (SELECT id, {_KEYS}, CASE WHEN abs(max(1 - w) - 1) < 1.5e-8 THEN 0 ELSE -sum((1 - w + 1e-20) * ln(1 - w + 1e-20)) END AS entropy FROM s GROUP BY ALL)
SELECT {_KEYS}, {_R("entropy", 5)} AS entropy, entropy > 0.5 AS flagged_cell FROM e"""
)
def assess_clusters_entropy(spark, d):
    out = quality.assess_clusters_entropy(cells(spark, d), "l_returnflag", ["l_quantity", "l_discount"], entropy_threshold=0.5, augment=True)
    return _round(out, ["entropy"], 5).select(*KEY, "entropy", "flagged_cell")


@query(
    f"""WITH {_KNN.format(k=10)}, v AS (SELECT k.cell_id, e.label::VARCHAR AS label, count(*) AS n FROM k JOIN embeddings e ON e.vec_id = k.neighbor_id GROUP BY 1, 2),
b AS (SELECT cell_id, label FROM v QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, label) = 1)
SELECT b.cell_id, b.label AS knn_cluster, b.label <> e.label::VARCHAR AS flagged_cell FROM b JOIN embeddings e ON e.vec_id = b.cell_id"""
)
def assess_clusters_knn(spark, d):
    return quality.assess_clusters_knn(_vec(spark, d), "label", ["embedding"], 10)


@query(f"SELECT {_KEYS}, l_returnflag, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' END AS l_returnflag_annotation FROM lineitem")
def annotate_clusters(spark, d):
    out = cluster.annotate_clusters(cells(spark, d), "l_returnflag", {"A": "accepted", "R": "returned"})
    return out.select(*KEY, "l_returnflag", "l_returnflag_annotation")


_PROP = """
n AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
t AS (SELECT l_suppkey, sum(n) AS t FROM n GROUP BY 1),
p AS (SELECT t.l_suppkey, c.l_returnflag, coalesce(n.n, 0) / t.t AS prop FROM t CROSS JOIN (SELECT DISTINCT l_returnflag FROM n) c LEFT JOIN n ON n.l_suppkey = t.l_suppkey AND n.l_returnflag = c.l_returnflag)"""


@query(f"WITH {_PROP} SELECT l_suppkey, l_returnflag, {_R('prop')} AS prop FROM p")
def extract_proportion_long(spark, d):
    return _doubles(features.extract_proportion(cells(spark, d), "l_returnflag", "l_suppkey", "long"))


@query(f"WITH {_PROP} SELECT l_suppkey, " + ", ".join(f"{_R(f'max(CASE WHEN l_returnflag = {chr(39)}{x}{chr(39)} THEN prop END)')} AS \"prop@{x}\"" for x in "ANR") + " FROM p GROUP BY 1")
def extract_proportion_wide(spark, d):
    return _doubles(features.extract_proportion(cells(spark, d), "l_returnflag", "l_suppkey"))


_BY = "l_suppkey, l_returnflag, l_linestatus"


@query("WITH x AS (" + _each("SELECT " + _BY + ", '{c}' AS channel, median({c}) AS v FROM lineitem GROUP BY 1, 2, 3") + f") SELECT {_BY}, channel, {_R('v')} AS \"values\" FROM x")
def extract_central_tendency_long(spark, d):
    return _doubles(features.extract_central_tendency(cells(spark, d), "l_returnflag", CHANNELS, "l_suppkey", "l_linestatus", format="long"))


def _wide_sql(f: str, suffix: str) -> str:
    parts = [f"{_R(f.format(c=c, t=f'l_returnflag = {chr(39)}{x}{chr(39)} AND l_linestatus = {chr(39)}{s}{chr(39)}'))} AS \"{s}_{c}@{x}_{suffix}\"" for c in CHANNELS for x in "ANR" for s in "FO"]
    return f"SELECT l_suppkey, {', '.join(parts)} FROM lineitem GROUP BY 1"


@query(_wide_sql("median({c}) FILTER (WHERE {t})", "ct"))
def extract_central_tendency_wide(spark, d):
    return _doubles(features.extract_central_tendency(cells(spark, d), "l_returnflag", CHANNELS, "l_suppkey", "l_linestatus"))


@query(_wide_sql("avg(({c} > asinh(2))::INTEGER) FILTER (WHERE {t})", "threshold"))
def extract_threshold_wide(spark, d):
    return _doubles(features.extract_threshold(cells(spark, d), "l_returnflag", CHANNELS, "l_suppkey", "l_linestatus"))


@query("WITH x AS (" + _each("SELECT l_suppkey, l_returnflag, '{c}' AS channel, avg((l.{c} > asinh(2))::INTEGER) AS v FROM lineitem l GROUP BY 1, 2") + f") SELECT l_suppkey, l_returnflag, channel, {_R('v')} AS \"values\" FROM x")
def extract_threshold_long(spark, d):
    return _doubles(features.extract_threshold(cells(spark, d), "l_returnflag", CHANNELS, "l_suppkey", format="long"))


def _distribution_sql(kind: str) -> str:
    bins = 99
    body = "sum(abs(f))" if kind == "emd" else "sum(CASE WHEN p + r > 0 THEN -(p + r) / 2 * log2((p + r) / 2) ELSE 0 END - (CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END + CASE WHEN r > 0 THEN -r * log2(r) ELSE 0 END) / 2)"
    return f"""
WITH l AS ({_each("SELECT l_suppkey, l_returnflag, l_linestatus, '{c}' AS channel, {c} AS v FROM lineitem")}),
e AS (SELECT l_suppkey, l_returnflag, channel, floor(min(v)) AS lo, ceil(max(v)) AS hi,
      count(*) FILTER (WHERE l_linestatus = 'O') AS n1, count(*) FILTER (WHERE l_linestatus = 'F') AS n2 FROM l GROUP BY 1, 2, 3),
b AS (SELECT l_suppkey, l_returnflag, channel, l_linestatus, n1, n2, lo, hi,
      greatest(1, least({bins}, ceil((v - lo) * {bins} / (hi - lo))))::INTEGER AS bin FROM l JOIN e USING (l_suppkey, l_returnflag, channel) WHERE hi > lo),
g AS (SELECT l_suppkey, l_returnflag, channel, unnest(range(1, {bins + 1})) AS bin FROM e WHERE hi > lo AND n1 >= 10 AND n2 >= 10),
c AS (SELECT l_suppkey, l_returnflag, channel, bin, count(*) FILTER (WHERE l_linestatus = 'O') / max(n1) AS p, count(*) FILTER (WHERE l_linestatus = 'F') / max(n2) AS r FROM b GROUP BY 1, 2, 3, 4),
s AS (SELECT g.*, coalesce(p, 0) AS p, coalesce(r, 0) AS r,
      sum(coalesce(p, 0) - coalesce(r, 0)) OVER (PARTITION BY g.l_suppkey, g.l_returnflag, g.channel ORDER BY g.bin) AS f
      FROM g LEFT JOIN c USING (l_suppkey, l_returnflag, channel, bin)),
v AS (SELECT l_suppkey, l_returnflag, channel, {body} AS x FROM s GROUP BY 1, 2, 3)
SELECT e.l_suppkey, e.l_returnflag, 'O' AS l_linestatus, e.channel, {_R("x")} AS {kind}
FROM e LEFT JOIN v USING (l_suppkey, l_returnflag, channel) WHERE n1 > 0 AND n2 > 0"""


@query(_distribution_sql("emd"))
def extract_emd(spark, d):
    return _doubles(features.extract_emd(cells(spark, d), "l_returnflag", CHANNELS, "l_suppkey", "l_linestatus", "F", format="long"))


@query(_distribution_sql("jsd"))
def extract_jsd(spark, d):
    return _doubles(features.extract_jsd(cells(spark, d), "l_returnflag", CHANNELS, "l_suppkey", "l_linestatus", "F", format="long"))


@query(
    f"WITH {_PROP}, w AS (SELECT l_suppkey, " + ", ".join(f"{_R(f'max(CASE WHEN l_returnflag = {chr(39)}{x}{chr(39)} THEN prop END)')} AS \"prop@{x}\"" for x in "ANR") + " FROM p GROUP BY 1), "
    "m AS (SELECT l_suppkey, " + ", ".join(f"{_R(f'median(l_quantity) FILTER (WHERE l_returnflag = {chr(39)}{x}{chr(39)})')} AS \"l_quantity@{x}_ct\"" for x in "ANR") + ", "
    + ", ".join(f"{_R(f'avg((l_tax > asinh(2))::INTEGER) FILTER (WHERE l_returnflag = {chr(39)}{x}{chr(39)} AND l_linestatus = {chr(39)}{s}{chr(39)})')} AS \"{s}_l_tax@{x}_threshold\"" for x in "ANR" for s in "FO")
    + " FROM lineitem GROUP BY 1) SELECT * FROM w JOIN m USING (l_suppkey)"
)
def extract_features(spark, d):
    return _doubles(features.extract_features(cells(spark, d), "l_returnflag", "l_suppkey", ["l_quantity"], ["l_tax"], "l_linestatus"))


_SHARES = """
n AS (SELECT l_suppkey, l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT l_suppkey, l_linestatus, sum(n) AS t FROM n GROUP BY 1, 2),
s AS (SELECT t.l_suppkey, t.l_linestatus, c.l_returnflag, coalesce(n.n, 0) AS n, coalesce(n.n, 0) / t.t AS x FROM t CROSS JOIN (SELECT DISTINCT l_returnflag FROM n) c
      LEFT JOIN n ON n.l_suppkey = t.l_suppkey AND n.l_linestatus = t.l_linestatus AND n.l_returnflag = c.l_returnflag),
ok AS (SELECT l_returnflag FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE n > 3) > 5),
v AS (SELECT s.* FROM s JOIN ok USING (l_returnflag))"""
_WELCH = "m AS (SELECT {k}, avg(x) FILTER (WHERE l_linestatus = 'F') AS m1, avg(x) FILTER (WHERE l_linestatus = 'O') AS m2, var_samp(x) FILTER (WHERE l_linestatus = 'F') / count(*) FILTER (WHERE l_linestatus = 'F') AS a, var_samp(x) FILTER (WHERE l_linestatus = 'O') / count(*) FILTER (WHERE l_linestatus = 'O') AS b, count(*) FILTER (WHERE l_linestatus = 'F') AS k1, count(*) FILTER (WHERE l_linestatus = 'O') AS k2 FROM v GROUP BY ALL)"
_WELCH_OUT = f"{_R('(m1 - m2) / sqrt(a + b)', 5)} AS t, {_R('(a + b) ** 2 / (a * a / (k1 - 1) + b * b / (k2 - 1))', 3)} AS df, {_R('m1 - m2')} AS mean_diff, {{fc}} AS mean_fc"
_PAIR = "w AS (SELECT {k}, l_suppkey, avg(x) FILTER (WHERE l_linestatus = 'F') AS a, avg(x) FILTER (WHERE l_linestatus = 'O') AS b FROM v GROUP BY ALL)"
_PAIR_OUT = f"{_R('avg(a - b) / sqrt(var_samp(a - b) / count(*))', 5)} AS t, (count(*) - 1)::DOUBLE AS df, {_R('avg(a - b)')} AS mean_diff, {_R('avg(a / (b + 0.001))', 5)} AS mean_fc"


def _tested(df: DataFrame, digits_fc: int = 5) -> DataFrame:
    return df.withColumns({"t": F.round("t", 5) + 0.0, "df": F.round("df", 3) + 0.0, "mean_diff": F.round("mean_diff", 6) + 0.0, "mean_fc": F.round("mean_fc", digits_fc) + 0.0})


@query(f"WITH {_SHARES}, {_WELCH.format(k='l_returnflag')} SELECT l_returnflag, {_WELCH_OUT.format(fc=_R('m1 / m2', 5))} FROM m")
def analyze_abundance_ttest(spark, d):
    return _tested(discovery.analyze_abundance_ttest(cells(spark, d), "l_returnflag", "l_linestatus", "l_suppkey", with_p=False))


@query(f"WITH {_SHARES}, {_PAIR.format(k='l_returnflag')} SELECT l_returnflag, {_PAIR_OUT} FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def analyze_abundance_ttest_paired(spark, d):
    return _tested(discovery.analyze_abundance_ttest(cells(spark, d), "l_returnflag", "l_linestatus", "l_suppkey", "paired", with_p=False))


_MEANS = "v AS (" + _each("SELECT l_suppkey, l_linestatus, l_returnflag, '{c}' AS marker, avg({c}) AS x FROM lineitem GROUP BY 1, 2, 3") + ")"


@query(f"WITH {_MEANS}, {_WELCH.format(k='l_returnflag, marker')} SELECT l_returnflag, marker, {_R('(m1 - m2) / sqrt(a + b)', 4)} AS t, {_R('(a + b) ** 2 / (a * a / (k1 - 1) + b * b / (k2 - 1))', 3)} AS df, {_R('m1 - m2', 4)} AS mean_diff, {_R('m1 / (m2 + 0.001)', 5)} AS mean_fc FROM m")
def analyze_expression_ttest(spark, d):
    out = discovery.analyze_expression_ttest(cells(spark, d), "l_returnflag", "l_linestatus", "l_suppkey", CHANNELS, with_p=False)
    return out.withColumns({"t": F.round("t", 4) + 0.0, "df": F.round("df", 3) + 0.0, "mean_diff": F.round("mean_diff", 4) + 0.0, "mean_fc": F.round("mean_fc", 5) + 0.0})


@query()
def analyze_abundance_glmm(spark, d):
    return discovery.analyze_abundance_glmm(cells(spark, d), "l_returnflag", "l_suppkey", "l_linestatus", "l_suppkey")


@query()
def analyze_abundance_voom(spark, d):
    return discovery.analyze_abundance_diffcyt(cells(spark, d), "l_returnflag", "l_suppkey", "l_linestatus", method="voom")


@query()
def analyze_abundance_edger(spark, d):
    return discovery.analyze_abundance_diffcyt(cells(spark, d), "l_returnflag", "l_suppkey", "l_linestatus", method="edgeR")


@query(
    """WITH p AS (SELECT o_orderkey AS id, o_totalprice / (SELECT max(o_totalprice) + 1 FROM orders) AS p_val FROM orders),
r AS (SELECT *, p_val * count(*) OVER () / rank_max AS raw FROM (SELECT *, count(*) OVER (ORDER BY p_val) AS rank_max FROM p))
SELECT id, round(least(1, min(raw) OVER (ORDER BY p_val DESC)), 6) + 0.0 AS p_adj FROM r"""
)
def bh_adjust(spark, d):
    orders = table(spark, d, "orders")
    top = orders.agg((F.max("o_totalprice") + 1).alias("m"))
    p = orders.join(F.broadcast(top), F.lit(True)).select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / F.col("m")).alias("p_val"))
    return _doubles(discovery.bh_adjust(p).select("id", "p_adj"))


@query()
def reduce_tsne(spark, d):
    return reduce.reduce_tsne(_vec(spark, d), ["embedding"], max_iterations=300, seed=1).select("cell_id", F.col("`.tsne1`").alias("tsne1"), F.col("`.tsne2`").alias("tsne2"))


@query()
def reduce_umap(spark, d):
    return reduce.reduce_umap(_vec(spark, d), ["embedding"], epochs=100, seed=1).select("cell_id", F.col("`.umap1`").alias("umap1"), F.col("`.umap2`").alias("umap2"))


@query(
    f"""SELECT a.vec_id AS cell_id, {_R("list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])")} AS similarity,
{_R("sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))")} AS length FROM embeddings a, embeddings b WHERE b.vec_id = 0"""
)
def vector_algebra(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("v"))
    one = v.where("cell_id = 0").select(F.col("v").alias("w"))
    return _doubles(v.join(F.broadcast(one), F.lit(True)).select("cell_id", exprs.cosine_similarity(F.col("v"), F.col("w")).alias("similarity"), exprs.magnitude(F.col("v")).alias("length")))


@query("SELECT p.penalty, m.mixture FROM (VALUES (1e-10), (3.1622776601683795e-08), (1e-05), (0.0031622776601683794), (1.0)) p(penalty) CROSS JOIN (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) m(mixture)".replace("(1e-10)", "(1e-10::DOUBLE)").replace("(0.0)", "(0.0::DOUBLE)"))
def create_grid(spark, d):
    from ..operators import modeling

    return modeling.create_grid(spark)


def _customers(spark, d):
    """A row for each customer with orders: what they spent as features, outcomes of each kind."""
    orders = table(spark, d, "orders")
    spent = orders.groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("share_f"),
    )
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    made = c.join(spent, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")
    return made.withColumns({
        "rich": F.when(F.col("c_acctbal") > 4500, F.lit("yes")).otherwise(F.lit("no")), "time": F.col("n_orders") + F.col("share_f"), "event": (F.col("c_nationkey") % 2).cast("double"),
        "score": (F.col("mean_price") / 200000).cast("double"),
    })


_CUSTOMERS = """
s AS (SELECT o_custkey, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS mean_price, avg((o_orderstatus = 'F')::INTEGER) AS share_f FROM orders GROUP BY 1),
c AS (SELECT c_custkey, CASE WHEN c_acctbal > 4500 THEN 'yes' ELSE 'no' END AS rich, round(n_orders + share_f, 6) AS time, (c_nationkey % 2)::DOUBLE AS event, round(mean_price / 200000, 6) AS score
      FROM customer JOIN s ON c_custkey = o_custkey)"""


def _rounded(spark, d):
    return _customers(spark, d).withColumns({"time": F.round("time", 6), "score": F.round("score", 6)})


@query(
    f"""WITH {_CUSTOMERS}, g AS (SELECT score, count(*) FILTER (WHERE rich = 'yes') AS p, count(*) FILTER (WHERE rich = 'no') AS n FROM c GROUP BY 1)
SELECT score AS threshold, {_R("sum(p) OVER (ORDER BY score DESC) / sum(p) OVER ()")} AS tpr, {_R("sum(n) OVER (ORDER BY score DESC) / sum(n) OVER ()")} AS fpr FROM g"""
)
def roc_curve(spark, d):
    from ..operators import modeling

    return _round(modeling.roc_curve(_rounded(spark, d), "rich", "score", "yes").where("threshold < 1e300"), ["tpr", "fpr"])


@query(
    f"""WITH {_CUSTOMERS}, g AS (SELECT rich, time, count(*) AS k, sum(event) AS e FROM c GROUP BY 1, 2),
r AS (SELECT *, sum(k) OVER (PARTITION BY rich) - coalesce(sum(k) OVER (PARTITION BY rich ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_risk FROM g)
SELECT rich, time, at_risk::BIGINT AS at_risk, e::BIGINT AS events,
       {_R("CASE WHEN min(1 - e / at_risk) OVER w <= 0 THEN 0 ELSE exp(sum(ln(greatest(1 - e / at_risk, 1e-300))) OVER w) END")} AS survival FROM r WINDOW w AS (PARTITION BY rich ORDER BY time)
UNION ALL SELECT rich, 0.0, count(*), 0, 1.0 FROM c GROUP BY 1"""
)
def km_curve(spark, d):
    from ..operators import modeling

    return _round(modeling.km_curve(_rounded(spark, d), "time", "event", "rich"), ["survival"])


@query()
def split_data(spark, d):
    from ..operators import modeling

    return modeling.split_data(_customers(spark, d), "k-fold", 10, seed=1).groupBy("split_id", "role").agg(F.count("*").alias("n"))


ORACLE["split_data"] = """
WITH n AS (SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)), f AS (SELECT unnest(range(1, 11)) AS f),
a AS (SELECT f, n, n // 10 + (CASE WHEN f - 1 BETWEEN 1 AND n % 10 THEN 1 ELSE 0 END) AS k FROM f, n)
SELECT format('Fold{:02d}', f) AS split_id, 'assessment' AS role, k::BIGINT AS n FROM a
UNION ALL SELECT format('Fold{:02d}', f), 'analysis', (n - k)::BIGINT FROM a"""


@query("SELECT event_type, count(*)::BIGINT AS num_cells, strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS start FROM events GROUP BY event_type, time_bucket(INTERVAL '6 hours', ts)")
def stream_flow_rate(spark, d):
    from ..streaming.flow import stream_flow_rate as rate

    events = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return rate(events, "ts", "6 hours", by="event_type").select("event_type", "num_cells", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"))


@query(f"WITH u AS ({_each('SELECT {c} AS v, ' + chr(39) + '{c}' + chr(39) + ' AS channel, l_returnflag FROM lineitem')}) SELECT l_returnflag, channel AS name, min(v) AS \"minRange\", max(v) AS \"maxRange\", {_R('max(v) - min(v)')} AS range FROM u GROUP BY 1, 2")
def frame_parameters(spark, d):
    from ..sources import bundle

    out = bundle.frame_parameters(cells(spark, d).select("l_returnflag", *CHANNELS), "l_returnflag")
    return _round(out, ["range"]).select("l_returnflag", "name", "minRange", "maxRange", "range")


@query(f"WITH u AS ({_each('SELECT l_orderkey, l_partkey, {c} AS v, ' + chr(39) + '{c}' + chr(39) + ' AS channel FROM lineitem')}) SELECT channel, count(*)::BIGINT AS n, {_R('sum(v)', 2)} AS total FROM u GROUP BY 1")
def bundle_assay(spark, d):
    from ..sources import bundle
    from ..table import CellTable, with_cell_id

    ready = with_cell_id(cells(spark, d), [*KEY, "l_quantity", "l_extendedprice"])
    assay = bundle.to_bundle(CellTable(ready), CHANNELS)["assay"]
    return _round(assay.groupBy("channel").agg(F.count("*").alias("n"), F.sum("value").alias("total")), ["total"], 2)


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice)::BIGINT AS cell_id, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem")
def cell_id(spark, d):
    from ..table import with_cell_id

    return with_cell_id(cells(spark, d), [*KEY, "l_quantity", "l_extendedprice"]).select("cell_id", *KEY)


@query()
def plot_cells_layout(spark, d):
    from . import plotdata

    return plotdata.cells_layout(_vec(spark, d), ["embedding"], rounds=20)[0]


@query()
def plot_clusters_heatmap(spark, d):
    from . import plotdata

    return _doubles(plotdata.clusters_heatmap(cells(spark, d), "l_returnflag", CHANNELS, scale_cols=True).select("row", "channel", "value"))


@query()
def plot_sample_heatmap(spark, d):
    from . import plotdata

    return _doubles(plotdata.sample_heatmap(cells(spark, d), "l_linenumber", CHANNELS, scale_cols=True).select("row", "channel", "value"))


def _folder(spark, kind: str) -> str:
    import uuid

    from ..storage import scratch_dir

    return f"{scratch_dir(spark)}/{kind}-{uuid.uuid4().hex}"


@query(f"SELECT l_returnflag || '.csv' AS file_name, count(*)::BIGINT AS n, {_R('sum(l_quantity)', 2)} AS l_quantity, {_R('sum(l_tax)', 2)} AS l_tax FROM lineitem GROUP BY 1")
def csv_round_trip(spark, d):
    """Cells written as a CSV file for each cluster, read back and summed up."""
    from ..sources import files

    where = _folder(spark, "csv")
    files.write_csv(cells(spark, d).select("l_returnflag", "l_quantity", "l_tax"), where, "l_returnflag", single_files=True)
    read = files.read_data(spark, where)["1"].df
    return _round(read.groupBy("file_name").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("l_quantity"), F.sum("l_tax").alias("l_tax")), ["l_quantity", "l_tax"], 2)


@query(f"SELECT {_KEYS}, l_returnflag, l_quantity FROM lineitem")
def nest_unnest(spark, d):
    from ..table import CellTable

    return CellTable(cells(spark, d).select(*KEY, "l_returnflag", "l_quantity")).nest(["l_suppkey", "l_returnflag"]).unnest().df.select(*KEY, "l_returnflag", "l_quantity")


@query(_each("SELECT " + _KEYS + ", '{c}' AS channel, {c} AS x FROM lineitem"))
def pivot_longer(spark, d):
    from ..table import CellTable

    return CellTable(cells(spark, d).select(*KEY, *CHANNELS)).pivot_longer(CHANNELS, "channel", "x").df


@query("SELECT l_suppkey, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{x}')::BIGINT AS \"{x}\"" for x in "ANR") + " FROM lineitem GROUP BY 1")
def pivot_wider(spark, d):
    from ..table import CellTable

    counts = cells(spark, d).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return CellTable(counts).pivot_wider("l_returnflag", "n", ["A", "N", "R"]).df.fillna(0)


@query(
    f"""WITH a AS (SELECT vec_id AS cell_id, [exp(x::DOUBLE) FOR x IN embedding] AS e FROM embeddings),
p AS (SELECT cell_id, [x / list_sum(e) FOR x IN e] AS p FROM a)
SELECT cell_id, {_R("-list_sum([(x + 1e-20) * ln(x + 1e-20) FOR x IN p])")} AS entropy, {_R("list_max(p)")} AS top FROM p"""
)
def softmax_entropy(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p = v.select("cell_id", exprs.softmax(F.col("v")).alias("p"))
    return _doubles(p.select("cell_id", exprs.shannon_entropy(F.col("p")).alias("entropy"), F.array_max("p").alias("top")))


@query(f"SELECT {_KEYS}, {_R('(l_quantity - min(l_quantity) OVER w) / (max(l_quantity) OVER w - min(l_quantity) OVER w)')} AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def rescale(spark, d):
    return _doubles(cells(spark, d).select(*KEY, exprs.rescale_over(F.col("l_quantity"), [F.col("l_suppkey")]).alias("scaled")))


@query(f"WITH {_KNN.format(k=15)}, s AS (SELECT cell_id, -sum(distance) AS x FROM k GROUP BY 1) SELECT cell_id, {_R('(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())')} AS density FROM s")
def knn_density_sum(spark, d):
    return _doubles(neighbors.estimate_density(_vec(spark, d), ["embedding"], "sum_distance", name="density"))


@query(f"SELECT {_KEYS}, s.s_name, l_quantity FROM lineitem LEFT JOIN supplier s ON s.s_suppkey = l_suppkey")
def annotate_from_table(spark, d):
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return cluster.annotate_clusters(cells(spark, d), "l_suppkey", names).select(*KEY, "s_name", "l_quantity")


@query("SELECT l_quantity, l_extendedprice, l_returnflag, l_linestatus FROM lineitem")
def plot_cells_scatter(spark, d):
    from . import plotdata

    return plotdata.cells_scatter(cells(spark, d), "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")


def _heatmap_sql(key: str) -> str:
    return f"""WITH m AS ({_each("SELECT " + key + "::VARCHAR AS row, '{c}' AS channel, median({c}) AS v FROM lineitem GROUP BY 1")})
SELECT row, channel, {_R("coalesce((v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0), 0)")} AS value FROM m WINDOW w AS (PARTITION BY channel)"""


ORACLE["plot_clusters_heatmap"], ORACLE["plot_sample_heatmap"] = _heatmap_sql("l_returnflag"), _heatmap_sql("l_linenumber")
ORACLE["spade_density"] = f"""
WITH {_KNN.format(k=1)}, a AS (SELECT 5 * median(distance) AS alpha FROM k), n AS (SELECT greatest(1, round(0.01 * count(*))) AS m FROM embeddings),
k2 AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance, neighbor_id) AS r FROM p),
c AS (SELECT cell_id, count(*) FILTER (WHERE distance < alpha AND r <= m) AS x FROM k2, a, n GROUP BY 1)
SELECT cell_id, {_R("(x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0)")} AS density FROM c"""

from . import model_queries  # noqa: E402, F401  its queries join those above
