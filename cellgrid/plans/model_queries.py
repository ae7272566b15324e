"""Queries over clusters, tests and models whose results SQL can work out in another way.

Distribution functions are integrated by Simpson's rule, maximum likelihood is found by Newton's steps
written out, spanning trees follow from minimax paths, and clusters are recovered from data in which
they are known.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import cluster, discovery, features, metacluster, modeling, neighbors, preprocess, reduce, sample
from ..sources import bundle, fcs, files
from ..storage import scratch_dir
from . import plotdata
from .queries import _CUSTOMERS, _KNN, _MEANS, _PROP, _R, _SHARES, _WELCH, CHANNELS, KEY, _customers, _distribution_sql, _doubles, _each, _round, _rounded, _vec, cells, extract_proportion_wide, query, table

# distribution functions


def _simpson(top: str, f: str, steps: int = 400) -> str:
    """The integral of f(x) from 0 to top."""
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({top}) / {3 * steps} * list_sum([({weight}) * {f.replace('{x}', f'(({top}) * i / {steps})')} FOR i IN range(0, {steps + 1})])"


def _t_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t."""
    body = _simpson(f"abs({t})", f"power(1 + power({{x}}, 2) / {df}, -({df} + 1) / 2)")
    return f"(1 - 2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt({df} * pi()) * {body})"


def _normal_sql(z: str) -> str:
    """Two-sided p of the standard normal."""
    return f"(1 - 2 / sqrt(2 * pi()) * {_simpson(f'abs({z})', 'exp(-power({x}, 2) / 2)')})"


def _adjusted(source: str, by: str = "") -> str:
    """CTEs adj(...) with p_adj and significant from source(..., p_val)."""
    part = f"PARTITION BY {by} " if by else ""
    return f"""raw AS (SELECT *, p_val * count(*) OVER ({part}) / count(*) OVER ({part}ORDER BY p_val) AS raw FROM {source}),
adj AS (SELECT *, least(1, min(raw) OVER ({part}ORDER BY p_val DESC)) AS p_adj FROM raw)"""


_STAR = "CASE WHEN p_adj < 0.05 THEN '*' ELSE '' END AS significant"

# differential abundance and expression


def _tested(df, digits):
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})


def _significance_sql(values: str, keys: str, fc: str, digits: tuple[int, int, int]) -> str:
    t, diff, fold = digits
    return f"""WITH {values}, {_WELCH.format(k=keys)},
w AS (SELECT {keys}, (m1 - m2) / sqrt(a + b) AS t, (a + b) ** 2 / (a * a / (k1 - 1) + b * b / (k2 - 1)) AS df, m1 - m2 AS mean_diff, {fc} AS mean_fc FROM m),
p AS (SELECT *, {_t_sql("t", "df")} AS p_val FROM w), {_adjusted("p")}
SELECT {keys}, {_R("t", t)} AS t, {_R("df", 3)} AS df, {_R("mean_diff", diff)} AS mean_diff, {_R("mean_fc", fold)} AS mean_fc, {_R("p_val")} AS p_val, {_R("p_adj")} AS p_adj, {_STAR} FROM adj"""


_ABUNDANCE = _significance_sql(_SHARES, "l_returnflag", "m1 / m2", (5, 6, 5))
_EXPRESSION = _significance_sql(_MEANS, "l_returnflag, marker", "m1 / (m2 + 0.001)", (4, 4, 5))


@query(_ABUNDANCE)
def analyze_abundance_significance(spark, d):
    out = discovery.analyze_abundance(cells(spark, d), "l_returnflag", "ttest", effect_col="l_linestatus", group_cols="l_suppkey")
    return _tested(out, {"t": 5, "df": 3, "mean_diff": 6, "mean_fc": 5, "p_val": 6, "p_adj": 6})


@query(_EXPRESSION)
def analyze_expression_significance(spark, d):
    out = discovery.analyze_expression(cells(spark, d), "l_returnflag", "ttest", effect_col="l_linestatus", group_cols="l_suppkey", marker_cols=CHANNELS)
    return _tested(out, {"t": 4, "df": 3, "mean_diff": 4, "mean_fc": 5, "p_val": 6, "p_adj": 6})


@query(
    f"""WITH s AS ({_EXPRESSION}), f AS (SELECT *, CASE WHEN mean_fc > 0 THEN log2(mean_fc) END AS fold, CASE WHEN p_adj > 0 THEN -ln(p_adj) END AS neg FROM s),
top AS (SELECT DISTINCT marker FROM (SELECT marker FROM s ORDER BY p_adj, marker LIMIT 5))
SELECT f.* EXCLUDE (fold, neg), {_R("fold", 5)} AS log2_fc, {_R("neg", 5)} AS neg_ln_p,
       CASE WHEN p_adj < 0.05 AND fold > 0 THEN 'increase' WHEN p_adj < 0.05 AND fold < 0 THEN 'decrease' ELSE 'no change' END AS direction, top.marker AS label
FROM f LEFT JOIN top USING (marker)"""
)
def plot_clusters_volcano(spark, d):
    return _tested(plotdata.clusters_volcano(analyze_expression_significance(spark, d), label_col="marker"), {"log2_fc": 5, "neg_ln_p": 5})


@query(
    f"""WITH t AS (SELECT l_linestatus AS s, count(*) AS t FROM lineitem GROUP BY 1), n AS (SELECT l_returnflag, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2),
o AS (SELECT l_returnflag, max(CASE WHEN s = 'O' THEN ln(n / (t - n)) END) - max(CASE WHEN s = 'F' THEN ln(n / (t - n)) END) AS estimate, sqrt(sum(1 / n + 1 / (t - n))) AS std_error FROM n JOIN t USING (s) GROUP BY 1),
z AS (SELECT *, estimate / std_error AS statistic FROM o), p AS (SELECT *, {_normal_sql("statistic")} AS p_val FROM z), {_adjusted("p")}
SELECT l_returnflag, 'l_linestatusO' AS term, {_R("estimate")} AS estimate, {_R("std_error")} AS std_error, {_R("statistic", 4)} AS statistic, {_R("p_val", 5)} AS p_val,
       {_R("exp(estimate)")} AS mean_fc, {_R("p_adj", 5)} AS p_adj, {_STAR} FROM adj"""
)
def analyze_abundance_glm(spark, d):
    """Without random effects the model's estimate is the log odds ratio of the pooled counts."""
    out = discovery.analyze_abundance(cells(spark, d), "l_returnflag", "glmm", group_cols="l_suppkey", fixed_effect_cols="l_linestatus")
    return _tested(out, {"estimate": 6, "std_error": 6, "statistic": 4, "p_val": 5, "mean_fc": 6, "p_adj": 5})


@query(
    f"""WITH v AS ({" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS marker, l_suppkey, avg({c}) FILTER (WHERE l_linestatus = 'O') AS o, avg({c}) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem GROUP BY 1, 2, 3" for c in ("l_quantity", "l_discount"))}),
m AS (SELECT l_returnflag, marker, count(*) AS n, avg(o - f) AS estimate, avg(f) AS base, var_samp(o - f) AS vd, 2 * var_samp((o + f) / 2) AS between_, (var_samp(o) + var_samp(f)) / 2 AS pooled FROM v GROUP BY 1, 2),
e AS (SELECT *, CASE WHEN between_ > vd / 2 THEN sqrt(vd / n) ELSE sqrt(2 * pooled / n) END AS std_error FROM m)
SELECT l_returnflag, marker, 'l_linestatusO' AS term, {_R("estimate", 5)} AS estimate, {_R("std_error", 5)} AS std_error, {_R("estimate / std_error", 3)} AS statistic,
       {_R("estimate", 5)} AS mean_diff, {_R("(base + estimate) / base", 5)} AS mean_fc FROM e"""
)
def analyze_expression_lmm(spark, d):
    """Each sample has both levels, so that the restricted likelihood gives the paired difference, or the pooled one where samples vary less than their halves."""
    out = discovery.analyze_expression(cells(spark, d), "l_returnflag", "lmm", group_cols="l_suppkey", fixed_effect_cols="l_linestatus", random_effect_cols="l_suppkey", marker_cols=["l_quantity", "l_discount"])
    out = _tested(out, {"estimate": 5, "std_error": 5, "statistic": 3, "mean_diff": 5, "mean_fc": 5})
    return out.select("l_returnflag", "marker", "term", "estimate", "std_error", "statistic", "mean_diff", "mean_fc")


def _psi(x: str, shift: int = 200) -> str:
    """The digamma function: its recurrence up to x + shift, then its asymptotic series."""
    y = f"({x} + {shift})"
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} * {y}) - list_sum([1 / ({x} + i) FOR i IN range(0, {shift})]))"


def _psi1(x: str, shift: int = 200) -> str:
    """The trigamma function."""
    y = f"({x} + {shift})"
    return f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * {y} * {y} * {y}) + list_sum([1 / power({x} + i, 2) FOR i IN range(0, {shift})]))"


@query(
    f"""WITH RECURSIVE v AS ({_each("SELECT l_suppkey, l_linestatus, l_returnflag, '{c}' AS marker, median({c}) AS x FROM lineitem GROUP BY 1, 2, 3")}),
m AS (SELECT l_returnflag AS cluster, marker, avg(x) FILTER (WHERE l_linestatus = 'O') - avg(x) FILTER (WHERE l_linestatus = 'F') AS effect, count(*) - 2 AS d,
      1 / count(*) FILTER (WHERE l_linestatus = 'O') + 1 / count(*) FILTER (WHERE l_linestatus = 'F') AS width,
      (var_samp(x) FILTER (WHERE l_linestatus = 'O') * (count(*) FILTER (WHERE l_linestatus = 'O') - 1) + var_samp(x) FILTER (WHERE l_linestatus = 'F') * (count(*) FILTER (WHERE l_linestatus = 'F') - 1)) / (count(*) - 2) AS s2 FROM v GROUP BY 1, 2),
e AS (SELECT ln(s2) - {_psi("(d / 2)")} + ln(d / 2) AS e, {_psi1("(d / 2)")} AS tri, d FROM m),
q AS (SELECT avg(e) AS mean, var_samp(e) - avg(tri) AS extra, sum(d) AS most FROM e),
b AS (SELECT 0 AS k, 1e-8::DOUBLE AS lo, 1e8::DOUBLE AS hi UNION ALL SELECT k + 1, CASE WHEN {_psi1("sqrt(lo * hi)")} > extra THEN sqrt(lo * hi) ELSE lo END, CASE WHEN {_psi1("sqrt(lo * hi)")} > extra THEN hi ELSE sqrt(lo * hi) END FROM b, q WHERE k < 120),
pr AS (SELECT CASE WHEN extra > 0 THEN 2 * sqrt(lo * hi) END AS d0, mean, most FROM b, q WHERE k = 120),
ps AS (SELECT d0, most, CASE WHEN d0 IS NULL THEN exp(mean) ELSE exp(mean + {_psi("(d0 / 2)")} - ln(d0 / 2)) END AS prior FROM pr),
st AS (SELECT m.*, effect / sqrt(width * CASE WHEN d0 IS NULL THEN prior ELSE (d0 * prior + d * s2) / (d0 + d) END) AS statistic, CASE WHEN d0 IS NULL THEN most ELSE least(d + d0, most) END AS df FROM m, ps),
p AS (SELECT *, {_t_sql("statistic", "df")} AS p_val FROM st), {_adjusted("p")}
SELECT cluster, marker, 'l_linestatusO' AS contrast, {_R("effect", 4)} AS effect, {_R("statistic", 4)} AS statistic, {_R("p_val", 5)} AS p_val, {_R("p_adj", 5)} AS p_adj, {_STAR} FROM adj"""
)
def analyze_expression_limma(spark, d):
    out = discovery.analyze_expression(cells(spark, d), "l_returnflag", "diffcyt", group_cols="l_suppkey", fixed_effect_cols="l_linestatus", marker_cols=CHANNELS, diffcyt_method="limma")
    return _tested(out, {"effect": 4, "statistic": 4, "p_val": 5, "p_adj": 5})


# features


def _wide_distances(kind: str) -> str:
    parts = [f"max(CASE WHEN channel = '{c}' AND l_returnflag = '{x}' THEN {kind} END) AS \"O_{c}@{x}_{kind}\"" for c in CHANNELS for x in "ANR"]
    return f"SELECT l_suppkey, {', '.join(parts)} FROM ({_distribution_sql(kind)}) GROUP BY 1"


@query(_wide_distances("emd"))
def extract_emd_wide(spark, d):
    return _doubles(features.extract_emd(cells(spark, d), "l_returnflag", CHANNELS, "l_suppkey", "l_linestatus", "F"))


@query(_wide_distances("jsd"))
def extract_jsd_wide(spark, d):
    return _doubles(features.extract_jsd(cells(spark, d), "l_returnflag", CHANNELS, "l_suppkey", "l_linestatus", "F"))


# sampling


@query(f"WITH {_KNN.format(k=15)}, s AS (SELECT cell_id, -avg(distance) AS x FROM k GROUP BY 1), u AS (SELECT cell_id, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x FROM s), c AS (SELECT quantile_cont(x, 0.01) AS cut FROM u) SELECT u.cell_id, e.label FROM u JOIN embeddings e ON e.vec_id = u.cell_id, c WHERE u.x > c.cut")
def downsample_density(spark, d):
    """With the densest cells' density as the bound every cell but the outliers stays, whatever is drawn."""
    v = _vec(spark, d).select("cell_id", "embedding", "label")
    return sample.downsample(v, None, "density", density_cols="embedding", target_percentile=1.0, seed=3).select("cell_id", "label")


@query("SELECT 0::BIGINT AS outliers_kept, 0::BIGINT AS sparse_lost, true AS as_many_as_expected")
def downsample_density_odds(spark, d):
    """What is drawn keeps to its odds: no outlier stays, every cell sparser than the bound does, and of the others as many as their odds add up to, give or take six deviations."""
    v = _vec(spark, d).select("cell_id", "embedding", "label")
    kept = sample.downsample(v, None, "density", density_cols="embedding", target_percentile=0.2, seed=3).select("cell_id", F.lit(True).alias("kept"))
    found = neighbors.estimate_density(v, "embedding", name="x").join(kept, "cell_id", "left")
    ends = found.agg(F.percentile("x", 0.01).alias("cut")).join(F.broadcast(found.where("x > 0").agg(F.percentile("x", 0.2).alias("bound"))), F.lit(True))  # one row each
    odds = found.join(F.broadcast(ends), F.lit(True)).withColumn("p", F.when(F.col("x") > F.col("cut"), F.least(F.lit(1.0), F.col("bound") / F.col("x"))).otherwise(0.0))
    stays = F.coalesce("kept", F.lit(False))
    return odds.agg(
        F.count_if(stays & (F.col("p") == 0)).alias("outliers_kept"), F.count_if(~stays & (F.col("p") == 1)).alias("sparse_lost"),
        (F.abs(F.sum(stays.cast("double") - F.col("p"))) <= 6 * F.sqrt(F.sum(F.col("p") * (1 - F.col("p"))))).alias("as_many_as_expected"),
    )


@query("SELECT l_suppkey, least(20, count(*) FILTER (WHERE l_linenumber > 2))::BIGINT AS n, 0::BIGINT AS without_weight FROM lineitem GROUP BY 1")
def slice_sample_weighted(spark, d):
    weighted = cells(spark, d).withColumn("w", F.when(F.col("l_linenumber") > 2, F.col("l_quantity")).otherwise(0.0))
    out = sample.slice_sample(weighted, 20, by="l_suppkey", weight_by="w", seed=2)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") <= 2).alias("without_weight"))


@query("SELECT l_suppkey, 1000::BIGINT AS n, true AS repeated FROM lineitem GROUP BY 1")
def slice_sample_replaced(spark, d):
    out = sample.slice_sample(cells(spark, d), 1000, by="l_suppkey", replace=True, seed=2)
    return out.groupBy("l_suppkey").agg(F.count("*").alias("n"), (F.count_distinct(*KEY, "l_quantity", "l_extendedprice") < F.count("*")).alias("repeated"))


# clusters that are known


def _blobs(spark, d):
    """Cells around three centres, one for each return flag, a hundred apart."""
    near = lambda c, scale: F.col(c) * scale
    return cells(spark, d).withColumns({
        "x": near("l_quantity", 1 / 50) + F.when(F.col("l_returnflag") == "N", 100.0).otherwise(0.0), "y": near("l_discount", 10.0) + F.when(F.col("l_returnflag") == "R", 100.0).otherwise(0.0),
    })


def _recovered(df, known: str, label: str):
    """(known, n, labels, spans): how many labels a known cluster has, and how many known clusters its labels span at most."""
    pairs = df.groupBy(known, F.col(f"`{label}`").alias("found")).agg(F.count("*").alias("n"))
    spans = pairs.groupBy("found").agg(F.count("*").alias("spans"))
    return pairs.join(spans, "found").groupBy(known).agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max("spans").alias("spans"))


_FLAGS = "SELECT l_returnflag, count(*)::BIGINT AS n, 1::BIGINT AS labels, 1::BIGINT AS spans FROM lineitem GROUP BY 1"


@query(_FLAGS)
def cluster_kmeans(spark, d):
    return _recovered(cluster.cluster(_blobs(spark, d), ["x", "y"], "kmeans", num_clusters=3, seed=1, max_iter=15), "l_returnflag", ".kmeans_cluster")


@query(_FLAGS)
def cluster_flowsom(spark, d):
    out = cluster.cluster(_blobs(spark, d), ["x", "y"], "flowsom", xdim=4, ydim=4, num_metaclusters=3, epochs=8, seed=1)
    return _recovered(out, "l_returnflag", ".flowsom_metacluster")


@query("SELECT l_linestatus, l_returnflag, count(*)::BIGINT AS n, 1::BIGINT AS labels, 1::BIGINT AS spans FROM lineitem GROUP BY 1, 2")
def cluster_grouped(spark, d):
    """Labels end in the group, so that none spans two."""
    out = cluster.cluster(_blobs(spark, d), ["x", "y"], "kmeans", by="l_linestatus", num_clusters=3, seed=1, max_iter=10)
    out = _recovered(out.withColumn("known", F.struct("l_linestatus", "l_returnflag")), "known", ".kmeans_cluster")
    return out.select("known.l_linestatus", "known.l_returnflag", "n", "labels", "spans")


@query("SELECT label, count(*)::BIGINT AS n, 1::BIGINT AS spans FROM embeddings GROUP BY 1")
def cluster_phenograph(spark, d):
    """Vectors with a hundred added in the place of their label: no community spans two labels."""
    apart = F.concat(F.col("embedding").cast("array<double>"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 100.0).otherwise(0.0)))
    out = cluster.cluster(_vec(spark, d).withColumn("embedding", apart), ["embedding"], "phenograph", num_neighbors=15, seed=1)
    return _recovered(out, "label", ".phenograph_cluster").select("label", "n", "spans")


def _meta(method: str, **options):
    def run(spark, d):
        c = _blobs(spark, d).withColumn("cluster", F.concat_ws("_", "l_returnflag", "l_linenumber"))
        out = metacluster.metacluster(c, "cluster", ["x", "y"], method, **options)
        made = out.groupBy("l_returnflag", "cluster", F.col(f"`.{method}_metacluster`").alias("m")).agg(F.count("*").alias("n"))
        named = made.join(made.groupBy("m").agg(F.min("cluster").alias("first"), F.count_distinct("l_returnflag").alias("spans")), "m")
        return named.select("cluster", "n", "first") if "num_metaclusters" in options and method != "flowsom" else named.select("cluster", "n", "spans")

    run.__name__ = f"metacluster_{method}"
    return run


_SEVENTHS = "SELECT l_returnflag || '_' || l_linenumber AS cluster, count(*)::BIGINT AS n, {what} FROM lineitem GROUP BY 1, l_returnflag"
for _method, _options in (("hierarchical", {"num_metaclusters": 3}), ("kmeans", {"num_metaclusters": 3}), ("phenograph", {}), ("consensus", {"num_metaclusters": 3}), ("flowsom", {"num_metaclusters": 6})):
    query(_SEVENTHS.format(what="l_returnflag || '_1' AS first" if _method in ("hierarchical", "kmeans", "consensus") else "1::BIGINT AS spans"))(_meta(_method, **_options))


# reduction


def _corr(i: int, j: int) -> str:
    return f"corr(asinh({CHANNELS[i]} / 5), asinh({CHANNELS[j]} / 5))"


_PAIRS = [(i, j) for i in range(4) for j in range(i)]
_TRIPLES = [(i, j, k) for i in range(4) for j in range(i) for k in range(j)]


@query(
    f"WITH c AS (SELECT {', '.join(f'{_corr(i, j)} AS c{i}{j}' for i, j in _PAIRS)} FROM lineitem) SELECT 4.0::DOUBLE AS sum_1, {_R('4 + 2 * (' + ' + '.join(f'c{i}{j} ** 2' for i, j in _PAIRS) + ')', 5)} AS sum_2, "
    + _R("4 + 6 * (" + " + ".join(f"c{i}{j} ** 2" for i, j in _PAIRS) + ") + 6 * (" + " + ".join(f"c{i}{j} * c{i}{k} * c{j}{k}" for i, j, k in _TRIPLES) + ")", 5)
    + " AS sum_3 FROM c"
)
def reduce_pca(spark, d):
    """The components' variances are the correlation matrix's eigenvalues: sums of their powers are traces of its powers."""
    out = reduce.reduce_dimensions(preprocess.preprocess(cells(spark, d), CHANNELS), CHANNELS, "pca", num_comp=4)
    v = out.agg(*[F.var_samp(f"`.pc{i}`").alias(f"v{i}") for i in range(1, 5)])
    return v.select(*[F.round(sum((F.col(f"v{i}") ** k for i in range(2, 5)), F.col("v1") ** k), 5).alias(f"sum_{k}") for k in (1, 2, 3)])


_UNIT = "s AS (SELECT avg(asinh({a} / 5)) AS ma, stddev_samp(asinh({a} / 5)) AS sa, avg(asinh({b} / 5)) AS mb, stddev_samp(asinh({b} / 5)) AS sb, sign(corr(asinh({a} / 5), asinh({b} / 5))) AS g FROM lineitem), z AS (SELECT l_returnflag, (asinh({a} / 5) - ma) / sa AS a, (asinh({b} / 5) - mb) / sb AS b, g FROM lineitem, s)".format(a="l_quantity", b="l_extendedprice")


@query(f"WITH {_UNIT} SELECT l_returnflag, {_R('avg(power(a + g * b, 2) / 2)', 4)} AS pc1, {_R('avg(power(a - g * b, 2) / 2)', 4)} AS pc2 FROM z GROUP BY 1")
def plot_cells_embedding(spark, d):
    """Of two channels the components are their sum and difference; squared, their signs do not matter."""
    pair = ["l_quantity", "l_extendedprice"]
    out = plotdata.cells_embedding(preprocess.preprocess(cells(spark, d), pair), compute_cols=pair, color="l_returnflag")
    return out.groupBy("l_returnflag").agg(*[F.round(F.avg(F.col(f"`.pc{i}`") ** 2), 4).alias(f"pc{i}") for i in (1, 2)])


# plots


@query(
    f"""WITH g AS (SELECT l_returnflag, count(*) AS n, stddev_samp(l_quantity) AS sd, (quantile_disc(l_quantity, 0.75) - quantile_disc(l_quantity, 0.25)) / 1.34 AS iqr FROM lineitem GROUP BY 1),
e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem),
b AS (SELECT l_returnflag, n, lo, hi, 0.9 * least(sd, iqr) * power(n, -0.2) AS band FROM g, e),
h AS (SELECT l_returnflag, least(4095, floor((l_quantity - lo) / (hi - lo) * 4096)) AS bin, count(*) AS c FROM lineitem, e GROUP BY 1, 2),
x AS (SELECT *, lo - 3 * band + i * (hi - lo + 6 * band) / 511 AS x FROM b, range(0, 512) r(i))
SELECT x.l_returnflag, {_R("x.x", 5)} AS x, {_R("sum(h.c * exp(-power((x.x - (lo + (h.bin + 0.5) * (hi - lo) / 4096)) / band, 2) / 2)) / (any_value(n) * any_value(band) * sqrt(2 * pi()))")} AS density
FROM x JOIN h USING (l_returnflag) GROUP BY x.l_returnflag, x.x"""
)
def plot_cells_density(spark, d):
    out = plotdata.cells_density(cells(spark, d), "l_quantity", "l_returnflag")
    return _round(_round(out, ["density"]), ["x"], 5)


_M = "m{0} AS (SELECT a.i, a.j, min(greatest(a1.w, a2.w)) AS w FROM m{1} a JOIN m{1} a1 ON a1.i = a.i JOIN m{1} a2 ON a2.i = a1.j AND a2.j = a.j GROUP BY 1, 2)"


@query(
    f"""WITH c AS (SELECT l_returnflag || '_' || l_linestatus || '_' || l_linenumber AS k, {", ".join(f"median(asinh({c} / 5)) AS v{i}" for i, c in enumerate(CHANNELS))} FROM lineitem GROUP BY 1),
m0 AS (SELECT a.k AS i, b.k AS j, sqrt({" + ".join(f"power(a.v{i} - b.v{i}, 2)" for i in range(4))}) AS w FROM c a, c b),
{", ".join(_M.format(i + 1, i) for i in range(6))}
SELECT m0.i AS src, m0.j AS dst, {_R("m0.w")} AS distance FROM m0 JOIN m6 USING (i, j) WHERE m0.i < m0.j AND m0.w <= m6.w"""
)
def plot_clusters_mst(spark, d):
    """An edge is in the tree if no other path between its ends has shorter edges only."""
    c = preprocess.preprocess(cells(spark, d), CHANNELS).withColumn("cluster", F.concat_ws("_", "l_returnflag", "l_linestatus", "l_linenumber"))
    edges = plotdata.clusters_mst(c, "cluster", CHANNELS)[1]
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.round("distance", 6).alias("distance"))


@query(f"WITH {_PROP} SELECT l_suppkey::VARCHAR AS row, 'prop@' || l_returnflag AS channel, {_R('prop')} AS value FROM p")
def plot_sample_features(spark, d):
    return _doubles(plotdata.sample_features(extract_proportion_wide(spark, d), "l_suppkey").select("row", "channel", "value"))


# sources


def _fcs_files(spark, d) -> str:
    where = f"{scratch_dir(spark)}/fcs-{uuid.uuid4().hex}"
    files.write_data(cells(spark, d).select("l_returnflag", *CHANNELS), where, "l_returnflag", "fcs")
    return where


@query("SELECT l_returnflag || '.fcs' AS file_name, count(*)::BIGINT AS n, " + ", ".join(f"{_R(f'avg({c}::FLOAT::DOUBLE)', 3)} AS {c}" for c in CHANNELS) + " FROM lineitem GROUP BY 1")
def fcs_round_trip(spark, d):
    """Cells written as FCS files of each cluster, which hold 32-bit floats, read back and summed up."""
    read = files.read_data(spark, _fcs_files(spark, d))["1"].df
    return _round(read.groupBy("file_name").agg(F.count("*").alias("n"), *[F.avg(F.col(f"`{c}`")).alias(c) for c in CHANNELS]), CHANNELS, 3)


@query("SELECT c AS metals, c AS antigens FROM (VALUES " + ", ".join(f"('{c}')" for c in CHANNELS) + ") t(c)")
def panel_of_files(spark, d):
    return fcs.read_fcs(spark, _fcs_files(spark, d))["1"].panel


@query("WITH s AS (SELECT l_returnflag, 'Sample_' || row_number() OVER (ORDER BY l_returnflag) AS sample FROM (SELECT DISTINCT l_returnflag FROM lineitem)) SELECT sample, l_returnflag, count(*)::BIGINT AS n, " + ", ".join(f"{_R(f'max({c})')} AS {c}" for c in CHANNELS) + " FROM lineitem JOIN s USING (l_returnflag) GROUP BY 1, 2")
def frame_set(spark, d):
    made = bundle.as_frame_set(cells(spark, d).select("l_returnflag", *CHANNELS), "l_returnflag")
    ends = made.exprs.groupBy("sample").agg(F.count("*").alias("n"), *[F.max(c).alias(c) for c in CHANNELS])
    return _round(made.metadata.join(ends, "sample"), CHANNELS)


# models of samples


def _fitted(spark, d, kind: str, outcome, predictors: list[str], customers=_customers):
    """A model without penalty to speak of, tuned on one split by a column."""
    c = customers(spark, d).withColumns({"used": F.col("c_custkey") % 3 != 0, "many": (F.col("n_orders") > 9).cast("double")})
    splits = modeling.split_data(c, split="used")
    return modeling.train_model(splits, predictors, kind, outcome, modeling.create_grid(spark, [1e-10], [0.5]))


def _same_means(spark, d):
    """Customers whose mean price is added up in the order of the prices: those with the same prices have the same mean, and are one step of a curve."""
    prices = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_totalprice")).alias("prices"))
    mean = F.aggregate("prices", F.lit(0.0), lambda a, x: a + x) / F.size("prices")
    return _customers(spark, d).drop("mean_price").join(prices.select(F.col("o_custkey").alias("c_custkey"), mean.alias("mean_price")), "c_custkey")


_ALL = "a AS (SELECT c_custkey, c_acctbal, c_mktsegment, n_orders, mean_price, rich, n_orders + share_f AS t, event, (n_orders > 9)::INTEGER AS many FROM c JOIN s ON s.o_custkey = c.c_custkey JOIN customer USING (c_custkey))"
_C = _CUSTOMERS
_LINE = """m AS (SELECT avg(c_acctbal) AS my, stddev_samp(c_acctbal) AS sy, avg(n_orders) AS m1, stddev_samp(n_orders) AS s1, avg(mean_price) AS m2, stddev_samp(mean_price) AS s2,
      corr(c_acctbal, n_orders) AS r1, corr(c_acctbal, mean_price) AS r2, corr(n_orders, mean_price) AS r12 FROM a),
b AS (SELECT *, sy * (r1 - r2 * r12) / (1 - r12 * r12) AS b1, sy * (r2 - r1 * r12) / (1 - r12 * r12) AS b2 FROM m)"""


@query(f"WITH {_C}, {_ALL}, {_LINE} SELECT NULL::VARCHAR AS outcome, f.name AS feature, {_R('CASE f.i WHEN 0 THEN my WHEN 1 THEN b1 ELSE b2 END', 3)} AS coefficient FROM b, (VALUES (0, '(Intercept)'), (1, 'n_orders'), (2, 'mean_price')) f(i, name)")
def train_model_linear(spark, d):
    return _round(_fitted(spark, d, "linear", "c_acctbal", ["n_orders", "mean_price"]).coefficient_table(spark), ["coefficient"], 3)


@query(f"WITH {_C}, {_ALL}, {_LINE} SELECT c_custkey, {_R('my + b1 * (n_orders - m1) / s1 + b2 * (mean_price - m2) / s2', 3)} AS pred FROM a, b")
def predict_model(spark, d):
    return _round(modeling.predict(_fitted(spark, d, "linear", "c_acctbal", ["n_orders", "mean_price"])).select("c_custkey", F.col("`.pred`").alias("pred")), ["pred"], 3)


_HELD = "f AS (SELECT regr_slope(c_acctbal, mean_price) AS k, regr_intercept(c_acctbal, mean_price) AS b FROM a WHERE c_custkey % 3 <> 0), h AS (SELECT c_acctbal AS truth, b + k * mean_price AS pred FROM a, f WHERE c_custkey % 3 = 0)"


@query(f"WITH {_C}, {_ALL}, {_HELD}, v AS (SELECT avg(power(truth - pred, 2)) AS mse, avg(abs(truth - pred)) AS mae FROM h) SELECT 'simple' AS split_id, 0.5::DOUBLE AS mixture, 1e-10::DOUBLE AS penalty, n.metric, {_R('CASE n.metric WHEN ' + chr(39) + 'mse' + chr(39) + ' THEN mse ELSE mae END', 2)} AS value FROM v, (VALUES ('mse'), ('mae')) n(metric)")
def tune_model(spark, d):
    return _round(_fitted(spark, d, "linear", "c_acctbal", ["mean_price"]).tuning_metrics, ["value"], 2)


@query(f"WITH {_C}, {_ALL}, {_HELD} SELECT {_R('avg(power(truth - pred, 2))', 2)} AS mse, {_R('avg(abs(truth - pred))', 3)} AS mae, {_R('corr(truth, pred)', 5)} AS correlation FROM h")
def assess_model_tuning(spark, d):
    out = modeling.assess_model(_fitted(spark, d, "linear", "c_acctbal", ["mean_price"]))["model_metrics"]
    return _tested(out, {"mse": 2, "mae": 3, "correlation": 5})


@query(f"WITH {_C}, {_ALL}, {_HELD} SELECT 'simple' AS split_id, {_R('truth', 3)} AS truth, {_R('pred', 3)} AS pred FROM h")
def cv_predictions(spark, d):
    return _round(_fitted(spark, d, "linear", "c_acctbal", ["mean_price"]).cv_predictions, ["truth", "pred"], 3)


def _newton(rounds: int = 9) -> str:
    """CTEs n0, n1, ...: Newton's steps for a logistic regression of rich on the standardised mean price."""
    out = ["q AS (SELECT avg(mean_price) AS m, stddev_samp(mean_price) AS s FROM a)", "x AS (SELECT a.*, (mean_price - m) / s AS z, (rich = 'yes')::INTEGER AS y FROM a, q)", "n0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1)"]
    for k in range(rounds):
        out.append(
            f"g{k} AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sum(y - p) AS u, sum(z * (y - p)) AS v, sum(p * (1 - p)) AS h, sum(z * p * (1 - p)) AS i, sum(z * z * p * (1 - p)) AS j FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM x, n{k})), "
            f"n{k + 1} AS (SELECT b0 + (j * u - i * v) / (h * j - i * i) AS b0, b1 + (h * v - i * u) / (h * j - i * i) AS b1 FROM g{k})"
        )
    return ", ".join(out) + f", p AS (SELECT x.*, 1 / (1 + exp(-(b0 + b1 * z))) AS p FROM x, n{rounds})"


@query(f"WITH {_C}, {_ALL}, {_newton()} SELECT NULL::VARCHAR AS outcome, f.name AS feature, {_R('CASE f.i WHEN 0 THEN b0 ELSE b1 END', 5)} AS coefficient FROM n9, (VALUES (0, '(Intercept)'), (1, 'mean_price')) f(i, name)")
def train_model_two_class(spark, d):
    return _round(_fitted(spark, d, "two-class", "rich", ["mean_price"]).coefficient_table(spark), ["coefficient"], 5)


@query(
    f"""WITH {_C}, {_ALL}, {_newton()}, r AS (SELECT y, p, (count(*) OVER (ORDER BY p) + count(*) OVER (ORDER BY p) - count(*) OVER (PARTITION BY p) + 1) / 2 AS rank FROM p),
u AS (SELECT (sum(rank) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) AS auc, avg(((p > 0.5) = (y = 1))::INTEGER) AS accuracy FROM r)
SELECT {_R("auc")} AS roc_auc, {_R("accuracy")} AS accuracy, {_R("1 - accuracy")} AS misclassification_error FROM u"""
)
def assess_model_new_data(spark, d):
    model = _fitted(spark, d, "two-class", "rich", ["mean_price"])
    return _doubles(modeling.assess_model(model, _customers(spark, d))["model_metrics"])


@query(
    f"""WITH {_C}, {_ALL}, {_newton()}, g AS (SELECT p, sum(y) AS yes, count(*) - sum(y) AS no FROM p GROUP BY 1)
SELECT {_R("sum(yes) OVER (ORDER BY p DESC) / sum(yes) OVER ()")} AS tpr, {_R("sum(no) OVER (ORDER BY p DESC) / sum(no) OVER ()")} AS fpr FROM g UNION ALL SELECT 0.0, 0.0"""
)
def plot_model(spark, d):
    model = _fitted(spark, d, "two-class", "rich", ["mean_price"], _same_means)
    return _doubles(plotdata.model_plot(model, _same_means(spark, d))["roc_curve"].select("tpr", "fpr"))


@query(f"WITH {_C}, {_ALL} SELECT a.c_custkey, " + ", ".join(f"{_R(f'avg((c_mktsegment = {chr(39)}{x}{chr(39)})::INTEGER) OVER (PARTITION BY many)', 3)} AS {x.lower()}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM a")
def train_model_multiclass(spark, d):
    """With one feature of two values the model's probabilities are the classes' shares among rows with that value."""
    model = _fitted(spark, d, "multiclass", "c_mktsegment", ["many"])
    out = modeling.predict(model, _customers(spark, d).withColumn("many", (F.col("n_orders") > 9).cast("double")))
    return _round(out.select("c_custkey", *[F.col(f"`.pred_{c}`").alias(c.lower()) for c in model.classes]), [c.lower() for c in model.classes], 3)


def _cox(rounds: int = 8) -> str:
    """CTEs: Newton's steps for Breslow's partial likelihood of time and event by the standardised mean price."""
    out = ["q AS (SELECT avg(mean_price) AS m, stddev_samp(mean_price) AS s FROM a)", "x AS (SELECT t, event, (mean_price - m) / s AS z FROM a, q)", "k0 AS (SELECT 0.0::DOUBLE AS b)"]
    for k in range(rounds):
        out.append(
            f"r{k} AS (SELECT t, any_value(b) AS b, sum(event) AS d, sum(event * z) AS dz, sum(exp(b * z)) AS e0, sum(z * exp(b * z)) AS e1, sum(z * z * exp(b * z)) AS e2 FROM x, k{k} GROUP BY t), "
            f"w{k} AS (SELECT *, sum(e0) OVER v AS s0, sum(e1) OVER v AS s1, sum(e2) OVER v AS s2 FROM r{k} WINDOW v AS (ORDER BY t DESC)), "
            f"k{k + 1} AS (SELECT any_value(b) + sum(dz - d * s1 / s0) / sum(d * (s2 / s0 - power(s1 / s0, 2))) AS b FROM w{k})"
        )
    return ", ".join(out)


@query(f"WITH {_C}, {_ALL}, {_cox()} SELECT NULL::VARCHAR AS outcome, f.name AS feature, {_R('CASE f.i WHEN 0 THEN 0 ELSE b END', 5)} AS coefficient FROM k8, (VALUES (0, '(Intercept)'), (1, 'mean_price')) f(i, name)")
def train_model_survival(spark, d):
    return _round(_fitted(spark, d, "survival", ["time", "event"], ["mean_price"]).coefficient_table(spark), ["coefficient"], 5)


@query(
    f"""WITH {_CUSTOMERS}, g AS (SELECT time, count(*) AS k, count(*) FILTER (WHERE score > 0.75) AS k1, sum(event) AS e, coalesce(sum(event) FILTER (WHERE score > 0.75), 0) AS e1 FROM c GROUP BY 1),
r AS (SELECT *, sum(k) OVER (ORDER BY time DESC) AS r, sum(k1) OVER (ORDER BY time DESC) AS r1 FROM g),
x AS (SELECT sum(e1 - e * r1 / r) AS o, sum(CASE WHEN r > 1 THEN e * r1 / r * (1 - r1 / r) * (r - e) / (r - 1) ELSE 0 END) AS v FROM r WHERE e > 0)
SELECT {_R("o * o / v", 5)} AS chisq, 1 AS df, {_R(_normal_sql("(o / sqrt(v))"), 5)} AS p_val FROM x"""
)
def log_rank_chisq(spark, d):
    return _tested(modeling.log_rank_test(_rounded(spark, d), "time", "event", F.col("score") > 0.75), {"chisq": 5, "p_val": 5})


@query(f"WITH {_C} SELECT CASE WHEN c_custkey % 3 <> 0 THEN 'analysis' ELSE 'assessment' END AS role, count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS ids FROM c GROUP BY 1")
def split_by_list(spark, d):
    """A boolean for each row, in the order of the customers' keys."""
    c = _customers(spark, d)
    keys = sorted(r[0] for r in c.select("c_custkey").collect())
    out = modeling.split_data(c, split=[k % 3 != 0 for k in keys], order_by="c_custkey")
    return out.groupBy("role").agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids"))


