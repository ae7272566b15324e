"""Differential abundance and expression of clusters.

Cells are counted or averaged for each sample and cluster in one aggregation. The tests' moments are
aggregated too; only p values, and the models with random effects, are worked out in Python, on a row
for each test or on the samples of one cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import models
from ..functions.special import benjamini_hochberg, t_two_sided
from ..table import Selector, columns, is_numeric, q
from .sample import join_groups

#: Rows of tests, or of samples times clusters, that a model reads on the driver.
MAX_TESTS = 2_000_000


def bh_adjust(df: DataFrame, p_col: str = "p_val", out_col: str = "p_adj") -> DataFrame:
    """Benjamini-Hochberg adjusted p values; ties share one, nulls stay null. The windows run over a row for each test.

    Each row is adjusted as it comes: p values that are worked out again to be looked up may differ in their last digit.
    """
    p = q(p_col)
    up, down = Window.orderBy(p.asc_nulls_first()), Window.orderBy(p.desc_nulls_last())
    raw = df.withColumn("__raw", F.when(p.isNotNull(), p * F.count(p).over(Window.partitionBy()) / F.count(p).over(up)))
    return raw.withColumn(out_col, F.when(p.isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(down)))).drop("__raw")


def p_values(df: DataFrame) -> DataFrame:
    """df with p_val from the columns t and df, in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["p_val"] = np.atleast_1d(t_two_sided(pdf["t"].to_numpy(float), pdf["df"].to_numpy(float))) if len(pdf) else []
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{kinds}, p_val double").withColumn("p_val", F.when(~F.isnan("p_val"), F.col("p_val")))


def _significant(df: DataFrame, alpha: float) -> DataFrame:
    return df.withColumn("significant", F.when(F.col("p_adj") < alpha, F.lit("*")).otherwise(F.lit("")))


def abundances(df: DataFrame, cluster_col: str, by: list[str], extra: list[str]) -> DataFrame:
    """(by, extra, cluster, n, total, prop): counts for each sample that has cells, clusters it lacks with 0."""
    names = [*by, *extra]
    keys = [q(c) for c in names]
    counts = df.groupBy(*keys, q(cluster_col)).agg(F.count("*").alias("__n"))
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    scaffold = totals.crossJoin(counts.select(q(cluster_col)).distinct())  # samples times clusters
    met = join_groups(scaffold, counts.select(*keys, q(cluster_col), "__n"), "left")
    n = F.coalesce("__n", F.lit(0)).cast("long")
    return met.select(*keys, q(cluster_col), n.alias("n"), F.col("__total").alias("total"), (n / F.col("__total")).alias("prop"))


def _ttest(values: DataFrame, keys: list[str], pair_keys: list[str], effect_col: str, value: str, levels: list[str], paired: bool, fc_shift: float) -> DataFrame:
    """t, df, mean_diff and mean_fc for each of keys, first level less second."""
    k = [q(c) for c in keys]
    first, second = [F.when(q(effect_col).cast("string") == v, q(value)) for v in levels]
    if paired:
        wide = values.groupBy(*k, *[q(c) for c in pair_keys]).agg(F.avg(first).alias("x"), F.avg(second).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
        got = wide.groupBy(*k).agg(F.count("*").alias("k"), F.avg(F.col("x") - F.col("y")).alias("mean_diff"), F.var_samp(F.col("x") - F.col("y")).alias("v"), F.avg(F.try_divide(F.col("x"), F.col("y") + 0.001)).alias("mean_fc"))
        t = F.try_divide(F.col("mean_diff"), F.sqrt(F.col("v") / F.col("k")))
        return got.select(*k, t.alias("t"), F.when(t.isNotNull(), (F.col("k") - 1).cast("double")).alias("df"), "mean_diff", "mean_fc")
    got = values.groupBy(*k).agg(*[f(c).alias(n + s) for s, c in (("1", first), ("2", second)) for n, f in (("m", F.avg), ("v", F.var_samp), ("k", F.count))])
    a, b = F.col("v1") / F.col("k1"), F.col("v2") / F.col("k2")
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b))
    dof = F.try_divide((a + b) * (a + b), F.try_divide(a * a, F.col("k1") - 1) + F.try_divide(b * b, F.col("k2") - 1))
    return got.select(*k, t.alias("t"), F.when(t.isNotNull(), dof).alias("df"), (F.col("m1") - F.col("m2")).alias("mean_diff"), F.try_divide(F.col("m1"), F.col("m2") + fc_shift).alias("mean_fc"))


def _levels(df: DataFrame, effect_col: str, given: list[str] | None) -> list[str]:
    levels = given or [r[0] for r in df.select(q(effect_col).cast("string").alias("e")).where("e IS NOT NULL").distinct().orderBy("e").limit(3).collect()]
    if len(levels) != 2:
        raise ValueError("the effect must have two levels")
    return levels


def analyze_abundance_ttest(
    df: DataFrame, cluster_col: str, effect_col: str, group_cols: Selector, test_type: str = "unpaired", effect_levels: list[str] | None = None, min_cells: int = 3, min_samples: int = 5, alpha: float = 0.05, with_p: bool = True,
) -> DataFrame:
    """t tests of clusters' proportions between two levels of an effect: p_val, p_adj, significant, t, df, mean_diff, mean_fc.

    Clusters stay if more than min_samples samples have more than min_cells of their cells. Without
    effect_levels these are in sorted order; the difference is the first less the second.
    """
    by = columns(df, group_cols)
    levels = _levels(df, effect_col, effect_levels)
    shares = abundances(df, cluster_col, [c for c in by if c != effect_col], [effect_col])
    enough = shares.groupBy(q(cluster_col)).agg(F.count_if(F.col("n") > min_cells).alias("__ok")).where(F.col("__ok") > min_samples)
    shares = join_groups(shares, enough.select(q(cluster_col), "__ok")).drop("__ok")
    got = _ttest(shares, [cluster_col], [c for c in by if c != effect_col], effect_col, "prop", levels, test_type == "paired", 0.0)
    return _significant(bh_adjust(p_values(got)), alpha) if with_p else got


def expressions(df: DataFrame, cluster_col: str, markers: list[str], by: list[str], fun: Callable[[Column], Column]) -> DataFrame:
    """(by, cluster, marker, expression), from one aggregation."""
    keys = [q(c) for c in [*by, cluster_col]]
    made = df.groupBy(*keys).agg(*[fun(q(c)).cast("double").alias(c) for c in markers], F.count("*").alias("__cells"))
    return made.unpivot([*keys, F.col("__cells")], [q(c) for c in markers], "marker", "expression")


def analyze_expression_ttest(
    df: DataFrame, cluster_col: str, effect_col: str, group_cols: Selector, marker_cols: Selector = None, test_type: str = "unpaired", fun: Callable[[Column], Column] = F.avg,
    effect_levels: list[str] | None = None, min_cells: int = 3, min_samples: int = 5, alpha: float = 0.05, with_p: bool = True,
) -> DataFrame:
    """t tests of channels in clusters; columns as for abundance, and marker. Adjusted over all tests."""
    by = [c for c in columns(df, group_cols) if c != effect_col]
    markers = [c for c in columns(df, marker_cols, is_numeric) if c not in (*by, effect_col, cluster_col)]
    levels = _levels(df, effect_col, effect_levels)
    values = expressions(df, cluster_col, markers, [*by, effect_col], fun)
    enough = values.select(q(cluster_col), "__cells", "marker").where(F.col("marker") == markers[0]).groupBy(q(cluster_col)).agg(F.count_if(F.col("__cells") > min_cells).alias("__ok")).where(F.col("__ok") > min_samples)
    values = join_groups(values, enough).drop("__ok")
    got = _ttest(values, [cluster_col, "marker"], by, effect_col, "expression", levels, test_type == "paired", 0.001)
    return _significant(bh_adjust(p_values(got)), alpha) if with_p else got


def _by_cluster(values: DataFrame, keys: list[str], fit: Callable[[pd.DataFrame], list[tuple]], schema: str) -> DataFrame:
    """fit for the samples of each cluster, in its own task: as many rows as there are samples."""
    kinds = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = fit(pdf)
        out = pd.DataFrame(rows, columns=names)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return values.groupBy(*[q(k) for k in keys]).applyInPandas(run, f"{kinds}, {schema}")


_TERMS = "term string, estimate double, std_error double, statistic double, df double, p_val double, base double"


def _random(pdf: pd.DataFrame, cols: list[str]) -> list[np.ndarray]:
    return [pdf[c].astype(str).to_numpy() for c in cols]


def analyze_abundance_glmm(
    df: DataFrame, cluster_col: str, group_cols: Selector, fixed_effect_cols: Selector, random_effect_cols: Selector = None, min_cells: int = 3, min_samples: int = 5, alpha: float = 0.05
) -> DataFrame:
    """Binomial models of proportions with fixed effects and random intercepts: a row for each cluster and term.

    A cluster goes if fewer than min_samples samples, but at least one, have more than min_cells of its cells.
    """
    fixed, random = columns(df, fixed_effect_cols), columns(df, random_effect_cols)
    by = list(dict.fromkeys([*columns(df, group_cols), *fixed, *random]))
    shares = abundances(df, cluster_col, by, [])
    ok = shares.groupBy(q(cluster_col)).agg(F.count_if(F.col("n") > min_cells).alias("__ok")).where((F.col("__ok") >= min_samples) | (F.col("__ok") == 0))
    shares = join_groups(shares, ok).drop("__ok")

    def fit(pdf: pd.DataFrame) -> list[tuple]:
        x, names = models.design([(c, pdf[c].to_numpy()) for c in fixed])
        y, total = pdf["prop"].to_numpy(float), pdf["total"].to_numpy(float)
        got = models.glmm(x, y, total, _random(pdf, random)) if random else models.binomial_glm(x, y, total)
        return [(n, float(got["beta"][i]), float(got["se"][i]), float(got["stat"][i]), None, float(got["p"][i]), float(got["beta"][0])) for i, n in enumerate(names) if i]

    out = _by_cluster(shares, [cluster_col], fit, _TERMS).withColumn("mean_fc", F.exp("estimate")).drop("base", "df")
    return _significant(bh_adjust(out), alpha)


def analyze_expression_lmm(
    df: DataFrame, cluster_col: str, group_cols: Selector, fixed_effect_cols: Selector, random_effect_cols: Selector = None, marker_cols: Selector = None, fun: Callable[[Column], Column] = F.avg,
    min_cells: int = 3, min_samples: int = 5, alpha: float = 0.05,
) -> DataFrame:
    """Linear models of channels with fixed effects and random intercepts: a row for each cluster, marker and term.

    Clusters in which a fixed or random effect has one level go.
    """
    fixed, random = columns(df, fixed_effect_cols), columns(df, random_effect_cols)
    by = list(dict.fromkeys([*columns(df, group_cols), *fixed, *random]))
    markers = [c for c in columns(df, marker_cols, is_numeric) if c not in (*by, cluster_col)]
    values = expressions(df, cluster_col, markers, by, fun).where("expression IS NOT NULL")
    ok = values.where(F.col("marker") == markers[0]).groupBy(q(cluster_col)).agg(F.count_if(F.col("__cells") > min_cells).alias("__ok")).where((F.col("__ok") >= min_samples) | (F.col("__ok") == 0))
    values = join_groups(values, ok).drop("__ok")

    def fit(pdf: pd.DataFrame) -> list[tuple]:
        if any(pdf[c].nunique() < 2 for c in (*fixed, *random)):
            return []
        x, names = models.design([(c, pdf[c].to_numpy()) for c in fixed])
        y = pdf["expression"].to_numpy(float)
        got = models.lmm(x, y, _random(pdf, random)) if random else models.ols(x, y)
        df_ = np.broadcast_to(np.asarray(got["df"], float), (len(names),))
        return [(n, float(got["beta"][i]), float(got["se"][i]), float(got["stat"][i]), float(df_[i]), float(got["p"][i]), float(got["beta"][0])) for i, n in enumerate(names) if i]

    out = _by_cluster(values, [cluster_col, "marker"], fit, _TERMS)
    out = out.withColumn("mean_diff", F.col("estimate")).withColumn("mean_fc", F.try_divide(F.col("base") + F.col("estimate"), F.col("base"))).drop("base")
    return _significant(bh_adjust(out), alpha)


def _contrasts(names: list[str]) -> list[tuple[str, np.ndarray]]:
    """omnibus over all terms, and each term by itself."""
    p = len(names)
    every = np.eye(p)[:, 1:]
    return ([("omnibus", every)] if p > 2 else []) + [(names[i], np.eye(p)[:, [i]]) for i in range(1, p)]


def _driver_table(values: DataFrame) -> pd.DataFrame:
    got = values.limit(MAX_TESTS + 1).toPandas()
    if len(got) > MAX_TESTS:
        raise ValueError(f"more than {MAX_TESTS} rows of samples and clusters")
    return got


def _test_frame(df: DataFrame, rows: list[dict], alpha: float, kinds: str) -> DataFrame:
    out = pd.DataFrame(rows)
    if not len(out):
        return df.sparkSession.createDataFrame([], kinds)
    out["p_adj"] = out.groupby("contrast")["p_val"].transform(lambda p: benjamini_hochberg(p.to_numpy()))
    out["significant"] = np.where(out["p_adj"] < alpha, "*", "")
    return df.sparkSession.createDataFrame(out[[c.split()[0] for c in kinds.split(", ")]], kinds)


def analyze_abundance_diffcyt(
    df: DataFrame, cluster_col: str, group_cols: Selector, fixed_effect_cols: Selector, random_effect_cols: Selector = None, method: str = "glmm", min_cells: int = 3, min_samples: int = 5, alpha: float = 0.05
) -> DataFrame:
    """Clusters' counts over samples by glmm, edgeR (negative binomial) or voom (weighted, moderated): (cluster, contrast, ...)."""
    fixed, random = columns(df, fixed_effect_cols), columns(df, random_effect_cols)
    if method not in ("glmm", "edgeR", "voom"):
        raise ValueError("method must be glmm, edgeR or voom")
    if method == "edgeR" and random:
        raise ValueError("edgeR has no random effects")
    by = list(dict.fromkeys([*columns(df, group_cols), *fixed, *random]))
    got = _driver_table(abundances(df, cluster_col, by, []).withColumn(cluster_col, q(cluster_col).cast("string")))
    samples = got[by].drop_duplicates().sort_values(by).reset_index(drop=True)
    counts = got.pivot_table(index=cluster_col, columns=by, values="n", aggfunc="sum").reindex(columns=pd.MultiIndex.from_frame(samples) if len(by) > 1 else samples[by[0]])
    counts = counts[(counts > min_cells).sum(axis=1) >= min_samples]
    totals = got.drop_duplicates(by).sort_values(by)["total"].to_numpy(float)
    x, names = models.design([(c, samples[c].to_numpy()) for c in fixed])
    tests = _contrasts(names)
    y = counts.to_numpy(float)
    rows = []
    if method == "glmm":
        for c, r in zip(counts.index, y, strict=True):
            fit = models.glmm(x, r / totals, totals, _random(samples, random)) if random else models.binomial_glm(x, r / totals, totals)
            rows += [{"cluster": c, "contrast": n, "effect": float(fit["beta"][i]), "statistic": float(fit["stat"][i]), "p_val": float(fit["p"][i])} for i, n in enumerate(names) if i]
    else:
        if random and method == "voom":
            x2, _ = models.design([(c, samples[c].astype(str).to_numpy()) for c in random])
            x = np.column_stack((x, x2[:, 1:]))
            tests = [(n, np.vstack((m, np.zeros((x.shape[1] - len(m), m.shape[1]))))) for n, m in tests]
        mats = [m for _, m in tests]
        if method == "edgeR":
            found = models.negative_binomial(y, totals, x, mats)
        else:
            level, weight = models.voom(y, totals, x)
            found = models.limma(level, x, mats, weight)
        for (n, _), f in zip(tests, found, strict=True):
            rows += [{"cluster": c, "contrast": n, "effect": float(f["effect"][i]), "statistic": float(f["stat"][i]), "p_val": float(f["p"][i])} for i, c in enumerate(counts.index)]
    return _test_frame(df, rows, alpha, "cluster string, contrast string, effect double, statistic double, p_val double, p_adj double, significant string")


def analyze_expression_diffcyt(
    df: DataFrame, cluster_col: str, group_cols: Selector, fixed_effect_cols: Selector, random_effect_cols: Selector = None, marker_cols: Selector = None, method: str = "lmm", min_cells: int = 3, min_samples: int = 5, alpha: float = 0.05
) -> DataFrame:
    """Clusters' median channels over samples by lmm or limma (moderated): (cluster, marker, contrast, ...)."""
    if method not in ("lmm", "limma"):
        raise ValueError("method must be lmm or limma")
    fixed, random = columns(df, fixed_effect_cols), columns(df, random_effect_cols)
    by = list(dict.fromkeys([*columns(df, group_cols), *fixed, *random]))
    markers = [c for c in columns(df, marker_cols, is_numeric) if c not in (*by, cluster_col)]
    got = _driver_table(expressions(df, cluster_col, markers, by, F.median).withColumn(cluster_col, q(cluster_col).cast("string")))
    samples = got[by].drop_duplicates().sort_values(by).reset_index(drop=True)
    wide = got.pivot_table(index=[cluster_col, "marker"], columns=by, values="expression").reindex(columns=pd.MultiIndex.from_frame(samples) if len(by) > 1 else samples[by[0]])
    cells = got.pivot_table(index=[cluster_col, "marker"], columns=by, values="__cells", fill_value=0)
    wide = wide[(cells > min_cells).sum(axis=1) >= min_samples]
    x, names = models.design([(c, samples[c].to_numpy()) for c in fixed])
    rows = []
    if method == "lmm":
        for (c, m), r in zip(wide.index, wide.to_numpy(float), strict=True):
            ok = ~np.isnan(r)
            fit = models.lmm(x[ok], r[ok], [g[ok] for g in _random(samples, random)]) if random else models.ols(x[ok], r[ok])
            rows += [{"cluster": c, "marker": m, "contrast": n, "effect": float(fit["beta"][i]), "statistic": float(fit["stat"][i]), "p_val": float(fit["p"][i])} for i, n in enumerate(names) if i]
    else:
        tests = _contrasts(names)
        if random:
            x2, _ = models.design([(c, samples[c].astype(str).to_numpy()) for c in random])
            x = np.column_stack((x, x2[:, 1:]))
            tests = [(n, np.vstack((m, np.zeros((x.shape[1] - len(m), m.shape[1]))))) for n, m in tests]
        found = models.limma(wide.to_numpy(float), x, [m for _, m in tests])
        for (n, _), f in zip(tests, found, strict=True):
            rows += [{"cluster": c, "marker": m, "contrast": n, "effect": float(f["effect"][i]), "statistic": float(f["stat"][i]), "p_val": float(f["p"][i])} for i, (c, m) in enumerate(wide.index)]
    return _test_frame(df, rows, alpha, "cluster string, marker string, contrast string, effect double, statistic double, p_val double, p_adj double, significant string")


def analyze_abundance(df: DataFrame, cluster_col: str, method: str = "ttest", **options) -> DataFrame:
    verbs = {"ttest": analyze_abundance_ttest, "glmm": analyze_abundance_glmm, "diffcyt": analyze_abundance_diffcyt}
    if method not in verbs:
        raise ValueError(f"method must be one of {sorted(verbs)}")
    return verbs[method](df, cluster_col, **_diffcyt(options))


def _diffcyt(options: dict) -> dict:
    """The method within a family of models is diffcyt_method here, as method names the family."""
    return {"method" if k == "diffcyt_method" else k: v for k, v in options.items()}


def analyze_expression(df: DataFrame, cluster_col: str, method: str = "ttest", **options) -> DataFrame:
    verbs = {"ttest": analyze_expression_ttest, "lmm": analyze_expression_lmm, "glmm": analyze_expression_lmm, "diffcyt": analyze_expression_diffcyt}
    if method not in verbs:
        raise ValueError(f"method must be one of {sorted(verbs)}")
    return verbs[method](df, cluster_col, **_diffcyt(options))


daa, daa_ttest, daa_glmm, daa_diffcyt = analyze_abundance, analyze_abundance_ttest, analyze_abundance_glmm, analyze_abundance_diffcyt
dea, dea_ttest, dea_lmm, dea_diffcyt = analyze_expression, analyze_expression_ttest, analyze_expression_lmm, analyze_expression_diffcyt

