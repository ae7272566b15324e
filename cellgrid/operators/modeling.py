"""Models of samples' outcomes from their features.

Samples are few (a row for each patient), so a fit is a task: folds and mixtures are spread over the
cluster and each task walks its penalties. Metrics that are aggregates of predictions, such as ROC
curves, survival curves and log-rank tests, are DataFrame expressions.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import penalized as pen
from ..functions.exprs import erfc
from ..functions.special import normal_two_sided
from ..storage import materialize
from ..table import Selector, columns, is_numeric, q, with_cell_id

#: Samples, and bytes of their features and outcomes (8 for each value), that one task fits.
MAX_SAMPLES, MAX_FIT = 8_000_000, 64 << 20
METRICS = {
    "linear": ("mse", False),
    "two-class": ("roc_auc", True),
    "multiclass": ("roc_auc", True),
    "survival": ("concordance_index", True),
}


def split_data(
    df: DataFrame, method: str = "k-fold", num_cv_folds: int = 10, num_cv_repeats: int = 1, num_bootstraps: int = 10, simple_prop: float = 0.75, strata: str | None = None, split: str | list[bool] | None = None, seed: int = 0, order_by: Selector = None,
) -> DataFrame:
    """df once for each split that a row is in, with split_id and role (analysis or assessment).

    k-fold: every repeat's folds, dealt evenly in each stratum; bootstrap: rows drawn with replacement for
    analysis, those never drawn for assessment; simple: one split at simple_prop; split: a boolean column,
    or a boolean for each row in the order of the columns order_by, true for analysis.
    """
    ids = Window.partitionBy(*([q(strata)] if strata else []))
    fixed = materialize(df.withColumn("__u", F.rand(seed)))
    if split is not None:
        if not isinstance(split, str):
            return _split_by_list(df, [bool(v) for v in split], columns(df, order_by))
        return df.withColumn("split_id", F.lit("simple")).withColumn("role", F.when(q(split), F.lit("analysis")).otherwise(F.lit("assessment")))
    if method == "simple":
        share = F.row_number().over(ids.orderBy("__u")) <= F.ceil(F.count("*").over(ids) * simple_prop)
        return fixed.withColumn("split_id", F.lit("simple")).withColumn("role", F.when(share, F.lit("analysis")).otherwise(F.lit("assessment"))).drop("__u")
    if method == "k-fold":
        out = None
        for r in range(num_cv_repeats):
            place = F.row_number().over(ids.orderBy(F.xxhash64(F.lit(r), "__u")))
            one = fixed.withColumn("__fold", F.pmod(place, F.lit(num_cv_folds)) + 1)
            all_ = one.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(num_cv_folds))))
            name = F.format_string("Repeat%d_Fold%02d" if num_cv_repeats > 1 else "Fold%2$02d", F.lit(r + 1), F.col("__k").cast("int"))
            part = all_.withColumn("split_id", name).withColumn("role", F.when(F.col("__k") == F.col("__fold"), F.lit("assessment")).otherwise(F.lit("analysis"))).drop("__u", "__fold", "__k")
            out = part if out is None else out.union(part)
        return out
    if method == "bootstrap":
        numbered = fixed.withColumn("__i", F.row_number().over(ids.orderBy("__u"))).withColumn("__n", F.count("*").over(ids))
        numbered = materialize(numbered.drop("__u"))
        draws = numbered.select(*([q(strata)] if strata else []), "__n", F.explode(F.sequence(F.lit(1), F.lit(num_bootstraps))).alias("__b")).withColumn("__i", (F.floor(F.rand(seed + 1) * F.col("__n")) + 1).cast("int"))
        draws = materialize(draws)
        keys = [*([strata] if strata else []), "__i"]
        name = F.format_string("Bootstrap%02d", "__b")
        taken = draws.drop("__n").join(numbered, keys).withColumn("split_id", name).withColumn("role", F.lit("analysis"))
        every = numbered.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(num_bootstraps))))
        left = every.join(draws.select(*keys, "__b").distinct(), [*keys, "__b"], "left_anti").withColumn("split_id", name).withColumn("role", F.lit("assessment"))
        return taken.select(*[q(c) for c in df.columns], "split_id", "role").union(left.select(*[q(c) for c in df.columns], "split_id", "role"))
    raise ValueError("method must be k-fold, bootstrap or simple")


def _split_by_list(df: DataFrame, values: list[bool], order: list[str]) -> DataFrame:
    """values belong to the rows in the given order, in which no two rows may tie."""
    if not order:
        raise ValueError("a list of booleans needs the columns to order rows by")
    numbered = materialize(with_cell_id(df, order, "__place"))
    n, distinct = numbered.agg(F.count("*"), F.count_distinct(F.struct(*[q(c) for c in order]))).first()
    if n != len(values) or distinct != n:
        raise ValueError(f"{len(values)} booleans for {n} rows, of which {distinct} differ in {order}")
    given = df.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "__place long, __in boolean")
    role = F.when(F.col("__in"), F.lit("analysis")).otherwise(F.lit("assessment"))
    return numbered.join(given, "__place").withColumn("split_id", F.lit("simple")).withColumn("role", role).drop("__place", "__in")


def create_grid(spark: SparkSession, penalties: Iterable[float] | None = None, mixtures: Iterable[float] | None = None, num_penalties: int = 5, num_mixtures: int = 5) -> DataFrame:
    """(penalty, mixture): every pair."""
    p = list(penalties) if penalties is not None else [float(10**e) for e in np.linspace(-10, 0, num_penalties)]
    m = list(mixtures) if mixtures is not None else [float(v) for v in np.linspace(0, 1, num_mixtures)]
    left = spark.createDataFrame([(float(v),) for v in p], "penalty double")
    return left.crossJoin(spark.createDataFrame([(float(v),) for v in m], "mixture double"))  # both are parameters


@dataclass
class Recipe:
    """What is done to features before a fit: levels become columns, gaps are filled, columns scaled."""

    numeric: list[str]
    levels: dict[str, list[str]]
    remove_nzv: bool = True
    impute: bool = False
    neighbors: int = 5
    normalize: bool = True
    names: list[str] = field(default_factory=list)
    keep: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    reference: np.ndarray | None = None

    def _raw(self, pdf: pd.DataFrame) -> np.ndarray:
        cols = [pdf[c].to_numpy(float) for c in self.numeric]
        for c, levels in self.levels.items():
            cols += [(pdf[c].astype(str) == v).to_numpy(float) for v in levels[1:]]
        return np.column_stack(cols) if cols else np.empty((len(pdf), 0))

    def prep(self, pdf: pd.DataFrame) -> Recipe:
        x = self._raw(pdf)
        names = self.numeric + [f"{c}_{v}" for c, levels in self.levels.items() for v in levels[1:]]
        keep = np.ones(x.shape[1], bool)
        if self.remove_nzv:
            for j in range(x.shape[1]):
                _, n = np.unique(x[~np.isnan(x[:, j]), j], return_counts=True)
                n = np.sort(n)[::-1]
                keep[j] = len(n) > 1 and not (n[0] / n[1] > 19 and len(n) * 100 <= 10 * len(x))
        x = x[:, keep]
        done = Recipe(self.numeric, self.levels, self.remove_nzv, self.impute, self.neighbors, self.normalize, [n for n, k in zip(names, keep, strict=True) if k], keep)
        done.mean = np.nanmean(x, axis=0) if len(x) else np.zeros(x.shape[1])
        sd = np.nanstd(x, axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
        done.scale = np.where(sd > 0, sd, 1.0)
        done.reference = x if self.impute else None
        return done

    def bake(self, pdf: pd.DataFrame) -> np.ndarray:
        x = self._raw(pdf)[:, self.keep]
        if self.impute and self.reference is not None:
            x = x.copy()
            z = (self.reference - self.mean) / self.scale
            for i in np.flatnonzero(np.isnan(x).any(1)):
                have = ~np.isnan(x[i])
                d = np.nanmean((z[:, have] - ((x[i] - self.mean) / self.scale)[have]) ** 2, axis=1)
                for j in np.flatnonzero(~have):
                    ok = np.flatnonzero(~np.isnan(self.reference[:, j]) & ~np.isnan(d))
                    near = ok[np.argsort(d[ok], kind="stable")[: self.neighbors]]
                    x[i, j] = self.reference[near, j].mean() if len(near) else self.mean[j]
        return (x - self.mean) / self.scale if self.normalize else x


def create_recipe(df: DataFrame, predictor_cols: Selector, remove_nzv: bool = True, impute_missing: bool = False, num_neighbors: int = 5, normalize: bool = True) -> Recipe:
    names = columns(df, predictor_cols, is_numeric)
    numeric = [c for c in names if is_numeric(df.schema[c])]
    levels = {c: [str(r[0]) for r in df.select(q(c)).where(q(c).isNotNull()).distinct().orderBy(q(c)).limit(1_000).collect()] for c in names if c not in numeric}
    return Recipe(numeric, levels, remove_nzv, impute_missing, num_neighbors, normalize)


def _outcome(pdf: pd.DataFrame, kind: str, cols: list[str], classes: list[str]) -> tuple:
    if kind == "survival":
        return pdf[cols[0]].to_numpy(float), pdf[cols[1]].to_numpy(float)
    if kind == "linear":
        return (pdf[cols[0]].to_numpy(float),)
    y = pd.Index(classes).get_indexer(pdf[cols[0]].astype(str))
    if (y < 0).any():
        raise ValueError(f"{cols[0]} has values that are no class")
    return (y,)


def _fit(kind: str, x: np.ndarray, y: tuple, lam: float, mix: float, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (rows: linear predictors) and intercepts."""
    if kind == "linear":
        b, b0 = pen.fit_gaussian(x, y[0], lam, mix)
    elif kind == "two-class":
        b, b0 = pen.fit_binomial(x, y[0].astype(float), lam, mix)
    elif kind == "multiclass":
        return pen.fit_multinomial(x, y[0], n_classes, lam, mix)
    else:
        b, b0 = pen.fit_cox(x, y[0], y[1], lam, mix), 0.0
    return b[None], np.array([b0])


def _metrics(kind: str, eta: np.ndarray, y: tuple) -> dict[str, float]:
    if kind == "linear":
        e = y[0] - eta[:, 0]
        return {"mse": float((e**2).mean()), "mae": float(np.abs(e).mean())}
    if kind == "two-class":
        p = np.clip(1 / (1 + np.exp(-eta[:, 0])), 1e-12, 1 - 1e-12)
        t = y[0]
        return {
            "roc_auc": pen.auc(p, t), "misclassification_error": float(((p > 0.5) != t).mean()), "accuracy": float(((p > 0.5) == t).mean()),
            "binomial_deviance": float(-2 * (t * np.log(p) + (1 - t) * np.log(1 - p)).mean()), "mse": float(2 * ((t - p) ** 2).mean()), "mae": float(2 * np.abs(t - p).mean()),
        }
    if kind == "multiclass":
        p = np.exp(eta - eta.max(1, keepdims=True))
        p = p / p.sum(1, keepdims=True)
        t = y[0]
        on = np.eye(p.shape[1])[t]
        return {
            "roc_auc": pen.hand_till(p, t), "misclassification_error": float((p.argmax(1) != t).mean()), "accuracy": float((p.argmax(1) == t).mean()),
            "multinomial_deviance": float(-2 * np.log(np.clip(p[np.arange(len(t)), t], 1e-12, None)).mean()), "mse": float(((on - p) ** 2).sum(1).mean()), "mae": float(np.abs(on - p).sum(1).mean()),
        }
    return {"concordance_index": pen.concordance(eta[:, 0], *y), "neg_log_partial_likelihood": -pen.partial_likelihood(eta[:, 0], *y)}


def _needed(df: DataFrame, recipe: Recipe, outcome_cols: list[str], *more: str) -> DataFrame:
    """The columns that a fit reads: what else the samples have does not travel."""
    return df.select(*[q(c) for c in dict.fromkeys([*more, *recipe.numeric, *recipe.levels, *outcome_cols])])


def _collected(df: DataFrame) -> pd.DataFrame:
    """df on the driver, in Arrow's columns all the way."""
    return df.toArrow().to_pandas()


def _in_one_task(df: DataFrame, f: Callable[[pd.DataFrame], Any]) -> Any:
    """f of all rows, in a task; what it returns is pickled there, and so of plain types."""
    got = df.groupBy().applyInPandas(lambda pdf: pd.DataFrame({"out": [pickle.dumps(f(pdf))]}), "out binary").first()
    if got is None:
        raise ValueError("no samples")
    return pickle.loads(bytes(got[0]))


def _bounded(n: int, values: int) -> None:
    if n > MAX_SAMPLES or n * values * 8 > MAX_FIT:
        raise ValueError(f"{n} samples of {values} values: a task fits {MAX_SAMPLES} samples and {MAX_FIT} bytes")


def tune(splits: DataFrame, recipe: Recipe, grid: DataFrame, kind: str, outcome_cols: list[str], classes: list[str]) -> DataFrame:
    """(split_id, mixture, penalty, metric, value): each fold and mixture is a task that walks all penalties."""
    got = grid.collect()
    mixtures = sorted({r.mixture for r in got})
    by = {m: sorted({r.penalty for r in got if r.mixture == m}, reverse=True) for m in mixtures}
    dealt = _needed(splits, recipe, outcome_cols, "split_id", "role").withColumn("mixture", F.explode(F.array(*[F.lit(m) for m in mixtures])))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[pdf["role"] == "analysis"], pdf[pdf["role"] == "assessment"]
        rows = []
        if len(train) and len(test):
            done = recipe.prep(train)
            x, xt = done.bake(train), done.bake(test)
            y, yt = _outcome(train, kind, outcome_cols, classes), _outcome(test, kind, outcome_cols, classes)
            for lam in by[key[1]]:
                b, b0 = _fit(kind, x, y, lam, key[1], len(classes))
                rows += [(key[0], key[1], lam, n, v) for n, v in _metrics(kind, xt @ b.T + b0, yt).items()]
        return pd.DataFrame(rows, columns=["split_id", "mixture", "penalty", "metric", "value"])

    return dealt.groupBy("split_id", "mixture").applyInPandas(run, "split_id string, mixture double, penalty double, metric string, value double")


def find_best(metrics: DataFrame, kind: str, metric: str | None = None, sparse: bool = False) -> tuple[float, float]:
    """(penalty, mixture) of the best mean metric; ties go to the larger penalty, then mixture.

    sparse: the largest penalty within a standard error of the best.
    """
    default, _ = METRICS[kind]
    metric = {"partial_likelihood_deviance": "neg_log_partial_likelihood"}.get(metric or default, metric or default)
    up = metric in ("roc_auc", "accuracy", "concordance_index")
    value = F.when(~F.isnan("value"), F.col("value"))
    mean = metrics.where(F.col("metric") == metric).groupBy("penalty", "mixture").agg(F.avg(value).alias("m"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    got = mean.where("m IS NOT NULL").toPandas()  # a row for each point of the grid
    if not len(got):
        raise ValueError(f"no values of {metric}")
    got["m"] = got["m"] if up else -got["m"]
    best = got.loc[got["m"].idxmax()]
    least = best["m"] - (np.nan_to_num(best["se"]) if sparse else 1e-12)
    row = got[got["m"] >= least].sort_values(["penalty", "mixture"]).iloc[-1]
    return float(row["penalty"]), float(row["mixture"])


@dataclass
class Model:
    """A fitted elastic net with its recipe; predicts as expressions."""

    kind: str
    penalty: float
    mixture: float
    outcome_cols: list[str]
    classes: list[str]
    recipe: Recipe
    coefficients: np.ndarray
    intercepts: np.ndarray
    training_data: DataFrame
    tuning_metrics: DataFrame | None = None
    cv_predictions: DataFrame | None = None
    baseline: tuple[np.ndarray, np.ndarray] | None = None
    log_rank_thresholds: pd.DataFrame | None = None
    best_log_rank_threshold: float | None = None

    def coefficient_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for k, (b, b0) in enumerate(zip(self.coefficients, self.intercepts, strict=True)):
            name = self.classes[k] if self.kind == "multiclass" else None
            rows += [(name, "(Intercept)", float(b0))] + [(name, n, float(v)) for n, v in zip(self.recipe.names, b, strict=True)]
        return spark.createDataFrame(rows, "outcome string, feature string, coefficient double")

    def __repr__(self) -> str:
        size = np.abs(self.coefficients).max(0)
        lines = [f"{n}: {', '.join(f'{v:.4g}' for v in self.coefficients[:, j])}" for j, n in sorted(enumerate(self.recipe.names), key=lambda t: -size[t[0]]) if size[j] > 0]
        return f"{self.kind} model, mixture {self.mixture:g}, penalty {self.penalty:.3g}\n" + "\n".join(lines)

    def predictors(self, df: DataFrame) -> list[Column]:
        """A linear predictor for each row of coefficients, from raw columns."""
        r = self.recipe
        raw = [q(c).cast("double") for c in r.numeric] + [(q(c).cast("string") == v).cast("double") for c, levels in r.levels.items() for v in levels[1:]]
        raw = [c for c, k in zip(raw, r.keep, strict=True) if k]
        out = []
        for b, b0 in zip(self.coefficients, self.intercepts, strict=True):
            total = F.lit(float(b0))
            for c, v, m, s in zip(raw, b, r.mean, r.scale, strict=True):
                if v:
                    filled = F.coalesce(c, F.lit(float(m))) if r.impute else c
                    total = total + ((filled - float(m)) * float(v / s) if r.normalize else filled * float(v))
            out.append(total)
        return out

    def x(self) -> DataFrame:
        pdf = _collected(_needed(self.training_data, self.recipe, []))
        r = self.recipe.prep(pdf)
        return self.training_data.sparkSession.createDataFrame(pd.DataFrame(r.bake(pdf), columns=r.names))

    def y(self) -> DataFrame:
        return self.training_data.select(*[q(c) for c in self.outcome_cols])

    def to_json(self) -> str:
        r = self.recipe
        return json.dumps({
            "kind": self.kind, "penalty": self.penalty, "mixture": self.mixture, "outcomes": self.outcome_cols, "classes": self.classes, "features": r.names,
            "coefficients": self.coefficients.tolist(), "intercepts": self.intercepts.tolist(), "mean": r.mean.tolist(), "scale": r.scale.tolist(),
        }, sort_keys=True)


def all_rows(splits: DataFrame) -> DataFrame:
    """The rows that were split. Any one split has each of them once, equal ones included; bootstraps repeat rows, so that there equal rows count once."""
    base = [q(c) for c in splits.columns if c not in ("split_id", "role")]
    first = splits.agg(F.min("split_id")).first()[0]
    if first is not None and first.startswith("Bootstrap"):
        return splits.select(*base).distinct()
    return splits.where(F.col("split_id") == first).select(*base) if first is not None else splits.select(*base).limit(0)


def train_model(
    splits: DataFrame, predictor_cols: Selector, kind: str, outcome_cols: str | list[str], grid: DataFrame | None = None, metric: str | None = None, sparse: bool = False,
    remove_nzv: bool = True, impute_missing: bool = False, normalize: bool = True,
) -> Model:
    """Tunes on the splits, fits the best on all rows, predicts out of fold; for survival also the best threshold of risk.

    kind: linear, two-class, multiclass (outcome: one column) or survival (outcomes: time, event).
    """
    if kind not in pen.FAMILIES:
        raise ValueError(f"kind must be one of {sorted(pen.FAMILIES)}")
    outcomes = [outcome_cols] if isinstance(outcome_cols, str) else list(outcome_cols)
    if len(outcomes) != (2 if kind == "survival" else 1):
        raise ValueError("survival needs time and event, other kinds one outcome")
    every = materialize(all_rows(splits))
    classes = [] if kind in ("linear", "survival") else [str(r[0]) for r in every.select(q(outcomes[0]).cast("string").alias("c")).distinct().orderBy("c").limit(1_001).collect()]
    if kind == "two-class" and len(classes) != 2:
        raise ValueError("a two-class outcome has two levels")
    predictors = [c for c in columns(splits, predictor_cols) if c not in outcomes]
    recipe = create_recipe(every, predictors, remove_nzv, impute_missing, 5, normalize)
    _bounded(every.count(), len(recipe.numeric) + sum(max(0, len(v) - 1) for v in recipe.levels.values()) + len(outcomes) + len(classes))
    grid = grid if grid is not None else create_grid(splits.sparkSession)
    metrics = materialize(tune(splits, recipe, grid, kind, outcomes, classes))
    penalty, mixture = find_best(metrics, kind, metric, sparse)

    def fit(pdf: pd.DataFrame) -> tuple:
        done = recipe.prep(pdf)
        x, y = done.bake(pdf), _outcome(pdf, kind, outcomes, classes)
        b, b0 = _fit(kind, x, y, penalty, mixture, len(classes))
        return done.names, done.keep, done.mean, done.scale, b, b0, pen.breslow(np.exp(x @ b[0]), *y) if kind == "survival" else None

    names, keep, mean, scale, b, b0, baseline = _in_one_task(_needed(every, recipe, outcomes), fit)
    done = replace(recipe, names=names, keep=keep, mean=mean, scale=scale)
    model = Model(kind, penalty, mixture, outcomes, classes, done, b, b0, every, metrics, baseline=baseline)
    model.cv_predictions = materialize(_cv_predictions(splits, recipe, model))
    if kind == "survival":
        cuts = model.cv_predictions.groupBy().applyInPandas(lambda oof: log_rank_thresholds(*[oof[c].to_numpy(float) for c in ("pred", "time", "event")]), "threshold double, p_val double")
        model.log_rank_thresholds = _collected(cuts)
        if len(model.log_rank_thresholds):
            model.best_log_rank_threshold = float(model.log_rank_thresholds.sort_values(["p_val", "threshold"]).iloc[0]["threshold"])
    return model


def _cv_predictions(splits: DataFrame, recipe: Recipe, model: Model) -> DataFrame:
    """(split_id, truth or time and event, pred or .pred_<class>): of rows that a fold was not fitted on."""
    kind, outcomes, classes, lam, mix = model.kind, model.outcome_cols, model.classes, model.penalty, model.mixture
    if kind == "survival":
        truth, schema = ["time", "event"], "time double, event double"
    else:
        truth, schema = ["truth"], "truth double" if kind == "linear" else "truth string"
    preds = [f".pred_{c}" for c in classes] if kind == "multiclass" else ["pred"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        train, test = pdf[pdf["role"] == "analysis"], pdf[pdf["role"] == "assessment"]
        out = pd.DataFrame({"split_id": [key[0]] * len(test)})
        if len(train) and len(test):
            done = recipe.prep(train)
            b, b0 = _fit(kind, done.bake(train), _outcome(train, kind, outcomes, classes), lam, mix, len(classes))
            eta = done.bake(test) @ b.T + b0
            for name, c in zip(truth, outcomes, strict=True):
                out[name] = test[c].astype(str).to_numpy() if classes else test[c].to_numpy(float)
            p = eta if kind in ("linear", "survival") else (1 / (1 + np.exp(-eta)) if kind == "two-class" else np.exp(eta - eta.max(1, keepdims=True)))
            if kind == "multiclass":
                p = p / p.sum(1, keepdims=True)
            for k, name in enumerate(preds):
                out[name] = p[:, k]
        return out.reindex(columns=["split_id", *truth, *preds])

    cols = ", ".join(f"`{p}` double" for p in preds)
    return _needed(splits, recipe, outcomes, "split_id", "role").groupBy("split_id").applyInPandas(run, f"split_id string, {schema}, {cols}")


def predict(model: Model, df: DataFrame | None = None, kind: str = "response") -> DataFrame:
    """df with .pred (and .pred_<class>): response, class, link, or for survival models also a curve of (time, probability)."""
    df = model.training_data if df is None else df
    eta = model.predictors(df)
    if kind == "link":
        return df.withColumns({".pred": eta[0]} if len(eta) == 1 else {f".pred_{c}": e for c, e in zip(model.classes, eta, strict=True)})
    if model.kind == "linear":
        return df.withColumn(".pred", eta[0])
    if model.kind == "survival":
        if kind == "survival curve":
            times, hazard = model.baseline
            curve = F.array(*[F.struct(F.lit(float(t)).alias("time"), F.exp(F.lit(-float(h)) * F.exp(eta[0])).alias("probability")) for t, h in zip([0.0, *times], [0.0, *hazard], strict=True)])
            return df.withColumn(".survival_curve", curve)
        return df.withColumn(".pred", F.exp(eta[0]) if kind == "response" else eta[0])
    if model.kind == "two-class":
        p = 1 / (1 + F.exp(-eta[0]))
        return df.withColumn(".pred", F.when(p > 0.5, model.classes[1]).otherwise(model.classes[0]) if kind == "class" else p)
    top = F.greatest(*eta)
    parts = [F.exp(e - top) for e in eta]
    total = sum(parts[1:], parts[0])
    if kind == "class":
        best = F.array_max(F.array(*[F.struct(e.alias("v"), F.lit(-k).alias("k")) for k, e in enumerate(eta)]))["k"]
        return df.withColumn(".pred", F.get(F.array(*[F.lit(c) for c in model.classes]), -best))
    return df.withColumns({f".pred_{c}": p / total for c, p in zip(model.classes, parts, strict=True)})


def roc_curve(df: DataFrame, truth_col: str, prob_col: str, positive: str) -> DataFrame:
    """(threshold, tpr, fpr): a row for each distinct probability, those at or above it counted positive, and one for none.

    With one class only the table is empty. The windows run over distinct probabilities.
    """
    hit = (q(truth_col).cast("string") == positive).cast("long")
    steps = df.groupBy(q(prob_col).cast("double").alias("threshold")).agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("n"))
    down, every = Window.orderBy(F.col("threshold").desc()), Window.partitionBy()
    total_p, total_n = F.sum("p").over(every), F.sum("n").over(every)
    curve = steps.select("threshold", (F.try_divide(F.sum("p").over(down), total_p)).alias("tpr"), (F.try_divide(F.sum("n").over(down), total_n)).alias("fpr")).where("tpr IS NOT NULL AND fpr IS NOT NULL")
    start = curve.agg(F.count("*").alias("k")).where("k > 0").select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return curve.union(start)


def km_curve(df: DataFrame, time_col: str, event_col: str, by: Selector = None) -> DataFrame:
    """(groups, time, at_risk, events, survival): the Kaplan-Meier curve, a row for each distinct time and one at 0."""
    groups = [q(c) for c in columns(df, by)]
    steps = df.groupBy(*groups, q(time_col).cast("double").alias("time")).agg(F.count("*").alias("left"), F.sum(q(event_col).cast("long")).alias("events"))
    w = Window.partitionBy(*groups).orderBy("time")
    whole = Window.partitionBy(*groups)
    gone = F.coalesce(F.sum("left").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    risk = steps.withColumn("at_risk", F.sum("left").over(whole) - gone)
    factor = 1 - F.col("events") / F.col("at_risk")
    dead = F.max(factor == 0).over(w)
    survival = F.when(dead, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(factor > 0, F.log(factor))).over(w)))
    curve = risk.select(*groups, "time", "at_risk", "events", survival.alias("survival"))
    start = steps.groupBy(*groups).agg(F.sum("left").alias("at_risk")).select(*groups, F.lit(0.0).alias("time"), "at_risk", F.lit(0).cast("long").alias("events"), F.lit(1.0).alias("survival"))
    return curve.union(start)


def log_rank_test(df: DataFrame, time_col: str, event_col: str, stratum: Column) -> DataFrame:
    """(chisq, df, p_val) of the two strata that a condition makes; with one of them p is 1."""
    high = F.coalesce(stratum, F.lit(False)).cast("long")
    steps = df.groupBy(q(time_col).cast("double").alias("t")).agg(
        F.count("*").alias("n"), F.sum(high).alias("n1"), F.sum(q(event_col).cast("long")).alias("d"), F.sum(q(event_col).cast("long") * high).alias("d1")
    )
    later = Window.orderBy(F.col("t").desc())
    r, r1 = F.sum("n").over(later), F.sum("n1").over(later)
    x = steps.withColumn("r", r).withColumn("r1", r1).where("d > 0")
    expected = F.col("d") * F.col("r1") / F.col("r")
    variance = F.when(F.col("r") > 1, F.col("d") * F.col("r1") / F.col("r") * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    got = x.agg(F.sum(F.col("d1") - expected).alias("o"), F.sum(variance).alias("v"))
    chisq = F.when(F.col("v") > 1e-12, F.col("o") * F.col("o") / F.col("v")).otherwise(F.lit(0.0))
    one = got.select(chisq.alias("chisq"), F.lit(1).alias("df"))
    # The upper tail of chi-squared with one degree of freedom is that of a squared normal.
    return one.withColumn("p_val", F.least(F.lit(1.0), erfc(F.sqrt(F.col("chisq") / 2))))


def log_rank_thresholds(risk: np.ndarray, time: np.ndarray, event: np.ndarray) -> pd.DataFrame:
    """(threshold, p_val) of every risk as a cut, high above it.

    From the highest risk down each sample joins the high group. What that adds to the squares of the numbers
    at risk depends on how many of the group live longer, and on the times of those who do not.
    """
    good = np.isfinite(risk)
    order = np.argsort(-risk[good], kind="stable")
    risk, time, event = risk[good][order], time[good][order], event[good][order] > 0
    at = np.unique(time[event])
    # How many of the event times a sample is at risk for.
    risky = np.searchsorted(at, time, side="right")
    n = len(time) - np.cumsum(np.bincount(risky, minlength=len(at) + 1))[: len(at)]
    d = np.bincount(np.searchsorted(at, time[event]), minlength=len(at))
    spread = np.where(n > 1, d / n * (n - d) / np.maximum(n - 1, 1), 0)
    hazard, linear, square = (np.concatenate(([0.0], np.cumsum(x)))[risky] for x in (d / n, spread, spread / n))
    before = np.arange(len(risk))
    shorter = pen.below(risky, before, risky)
    both = 2 * (pen.below(risky, before, risky, square) + square * (before - shorter)) + square
    o, v = np.cumsum(event - hazard), np.cumsum(linear - both)
    # Those at a cut, and below it, are not above it.
    first = np.flatnonzero(np.append(True, risk[1:] != risk[:-1])) if len(risk) else np.empty(0, int)
    o, v = (np.concatenate(([0.0], x))[first] for x in (o, v))
    chisq = np.divide(o * o, v, out=np.zeros(len(v)), where=v > 1e-12)
    return pd.DataFrame({"threshold": risk[first], "p_val": np.atleast_1d(normal_two_sided(np.sqrt(chisq)))})[::-1].reset_index(drop=True)


def assess_model(model: Model, data: DataFrame | str = "tuning") -> dict[str, Any]:
    """model_metrics, and by kind roc_curve, confusion_matrix, survival_curves: on new data, or "tuning" for out-of-fold predictions."""
    kind, out = model.kind, {}
    if isinstance(data, str):
        pred = model.cv_predictions
        out["tuning_metrics"] = model.tuning_metrics
        truth = "truth"
    else:
        pred = predict(model, data, "link" if kind == "survival" else "response")
        pred = pred.withColumnRenamed(".pred", "pred")
        if kind == "survival":
            pred = pred.withColumns({"time": q(model.outcome_cols[0]).cast("double"), "event": q(model.outcome_cols[1]).cast("double")})
        truth = model.outcome_cols[0]
    if kind == "linear":
        e = q(truth).cast("double") - F.col("pred")
        out["model_metrics"] = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.corr(q(truth).cast("double"), F.col("pred")).alias("correlation"))
    elif kind == "two-class":
        positive = model.classes[1]
        out["roc_curve"] = materialize(roc_curve(pred, truth, "pred", positive))
        out["confusion_matrix"] = pred.groupBy(q(truth).cast("string").alias("true_outcome"), F.when(F.col("pred") > 0.5, positive).otherwise(model.classes[0]).alias("predicted_outcome")).count()
        w = Window.orderBy("fpr", "tpr")
        area = out["roc_curve"].select(((F.col("fpr") - F.lag("fpr", 1, 0.0).over(w)) * (F.col("tpr") + F.lag("tpr", 1, 0.0).over(w)) / 2).alias("a")).agg(F.sum("a").alias("roc_auc"))
        hits = pred.agg(F.avg(((F.col("pred") > 0.5) == (q(truth).cast("string") == positive)).cast("double")).alias("accuracy"))
        out["model_metrics"] = area.join(F.broadcast(hits), F.lit(True)).withColumn("misclassification_error", 1 - F.col("accuracy"))  # one row each
    elif kind == "multiclass":
        names = [f".pred_{c}" for c in model.classes]
        best = F.array_max(F.array(*[F.struct(q(n).alias("v"), F.lit(-k).alias("k")) for k, n in enumerate(names)]))["k"]
        called = F.get(F.array(*[F.lit(c) for c in model.classes]), -best)
        out["confusion_matrix"] = pred.groupBy(q(truth).cast("string").alias("true_outcome"), called.alias("predicted_outcome")).count()
        curves = [roc_curve(pred, truth, n, c).withColumn("class", F.lit(c)) for n, c in zip(names, model.classes, strict=True)]
        out["roc_curve"] = curves[0]
        for c in curves[1:]:
            out["roc_curve"] = out["roc_curve"].union(c)
        out["model_metrics"] = pred.agg(F.avg((called == q(truth).cast("string")).cast("double")).alias("accuracy")).withColumn("misclassification_error", 1 - F.col("accuracy"))
    else:
        _bounded(pred.count(), 3)

        def measure(pdf: pd.DataFrame) -> tuple[float, float, float]:
            r, t, e = (pdf[c].to_numpy(float) for c in ("pred", "time", "event"))
            r = np.where(np.isinf(r), np.nanmax(r[np.isfinite(r)]) if np.isfinite(r).any() else 0, r)
            return float(pen.concordance(r, t, e)), float(-pen.partial_likelihood(r, t, e)), float(np.median(r))

        *values, middle = _in_one_task(pred.select("pred", "time", "event"), measure)
        out["model_metrics"] = model.training_data.sparkSession.createDataFrame([tuple(values)], "concordance_index double, neg_log_partial_likelihood double")
        cut = model.best_log_rank_threshold if model.best_log_rank_threshold is not None else middle
        high = F.col("pred") > cut
        out["survival_curves"] = km_curve(pred.withColumn("risk_group", F.when(high, F.lit("high")).otherwise(F.lit("low"))), "time", "event", "risk_group")
        out["log_rank"] = log_rank_test(pred, "time", "event", high)
    return out
