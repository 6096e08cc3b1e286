"""Learners that predictor selection can call: linear in closed form over all subsets at once, and Spark ML models."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainscope.errors import DomainError
from domainscope.operators.validation import classification_metrics, confusion, regression_metrics

MAXIMISED = {"rmse": False, "mae": False, "rsquared": True, "accuracy": True, "kappa": True}


@dataclass(frozen=True)
class Performance:
    """Of one subset of predictors: the mean over folds and its standard error, or one pooled figure."""

    value: float
    se: float | None


def gram_by_fold(df: DataFrame, predictors: list[str], response: str, fold: str) -> DataFrame:
    """fold, n, and the sums of products of (1, predictors, response): all that any linear model on a subset needs, in one aggregation."""
    names = ["1", *predictors, response]
    value = lambda c: F.lit(1.0) if c == "1" else F.col(c).cast("double")
    rows = df.dropna(subset=[*predictors, response, fold])
    sums = [F.sum(value(a) * value(b)).alias(f"g_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    return rows.groupBy(F.col(fold).alias("fold")).agg(F.count("*").alias("n"), *sums)


class LinearEvaluator:
    """Least squares for any subset from per-fold Gram matrices; the held-out error of a fold comes from its own matrix.

    Columns are centred and scaled by the pooled moments first, which keeps the normal equations well conditioned."""

    def __init__(self, df: DataFrame, predictors: list[str], response: str, fold: str, metric: str = "rmse", pooled: bool = False):
        if metric not in ("rmse", "rsquared"):
            raise DomainError("lm is judged by rmse or rsquared")
        self.predictors, self.metric, self.pooled = predictors, metric, pooled
        rows = gram_by_fold(df, predictors, response, fold).orderBy("fold").collect()  # one row for each fold
        if len(rows) < 2:
            raise DomainError("at least two folds are needed")
        p = len(predictors) + 2
        self.grams = np.zeros((len(rows), p, p))
        for r, g in zip(rows, self.grams, strict=True):
            for i in range(p):
                for j in range(i, p):
                    g[i, j] = g[j, i] = r[f"g_{i}_{j}"]
        total = self.grams.sum(axis=0)
        mean = total[0] / total[0, 0]
        sd = np.sqrt(np.maximum(np.diag(total) / total[0, 0] - mean**2, 1e-300))
        change = np.diag(np.r_[1.0, 1 / sd[1:-1], 1.0])
        change[0, 1:] = np.r_[-mean[1:-1] / sd[1:-1], -mean[-1]]
        self.grams = np.einsum("ji,fjk,kl->fil", change, self.grams, change)

    def __call__(self, subset: tuple[str, ...]) -> Performance:
        at = [0, *(1 + self.predictors.index(v) for v in subset)]
        y = self.grams.shape[1] - 1
        total, sse, moments = self.grams.sum(axis=0), [], []
        for g in self.grams:
            train = total - g
            b = np.linalg.lstsq(train[np.ix_(at, at)], train[at, y], rcond=None)[0]
            sse.append(max(0.0, g[y, y] - 2 * b @ g[at, y] + b @ g[np.ix_(at, at)] @ b))
            moments.append((g[0, 0], g[0, at] @ b, g[0, y], b @ g[np.ix_(at, at)] @ b, g[y, y], b @ g[at, y]))
        m = np.array(moments)
        if self.pooled:
            m, sse = m.sum(axis=0, keepdims=True), [sum(sse)]
        if self.metric == "rmse":
            each = np.sqrt(np.array(sse) / m[:, 0])
        else:
            n, sp, sy, spp, syy, spy = m.T
            top, bottom = (n * spy - sp * sy) ** 2, (n * spp - sp**2) * (n * syy - sy**2)
            each = np.where(bottom > 0, top / np.where(bottom > 0, bottom, 1), np.nan)
        each = each[np.isfinite(each)]
        if not len(each):
            return Performance(float("nan"), None)
        return Performance(float(each.mean()), float(each.std(ddof=1) / np.sqrt(len(each))) if len(each) > 1 else None)


#: Fits of one table that run at once.
FITS = 5


class MlEvaluator:
    """Any Spark ML estimator: fitted once for each fold and setting of the grid, on a table tagged with folds."""

    def __init__(self, df: DataFrame, response: str, fold: str, method: str, metric: str, grid: list[dict] | None = None, pooled: bool = False, **options):
        self.df, self.response, self.fold, self.method, self.metric = df, response, fold, method, metric
        self.grid, self.pooled, self.options = grid or [{}], pooled, options
        self.folds = [r[0] for r in df.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]
        estimator(method, **options)

    def __call__(self, subset: tuple[str, ...]) -> Performance:
        best: Performance | None = None
        for setting in self.grid:
            held = held_out(self.df, list(subset), self.response, self.fold, self.folds, self.method, **self.options, **setting)
            now = judged(held, self.fold, self.metric, self.pooled)
            if best is None or (now.value > best.value) == MAXIMISED[self.metric] and now.value != best.value:
                best = now
        return best


def estimator(method: str, **options):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    known = {"lm": LinearRegression, "rf": RandomForestRegressor, "gbt": GBTRegressor, "logistic": LogisticRegression, "rf_class": RandomForestClassifier}
    if method not in known:
        raise DomainError(f"learner {method!r}: one of {', '.join(known)}")
    return known[method](featuresCol="__x", labelCol="__y", predictionCol="pred", **options)


def assembled(df: DataFrame, variables: list[str], response: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    rows = df.dropna(subset=[*variables, response]).withColumn("__y", F.col(response).cast("double"))
    return VectorAssembler(inputCols=variables, outputCol="__x").transform(rows)


def held_out(df: DataFrame, variables: list[str], response: str, fold: str, folds: list, method: str, **options) -> DataFrame:
    """The rows with the prediction of the model that their fold did not train. A few folds are fitted at once: one fit is many small jobs."""
    rows, out = assembled(df, variables, response), None

    def fitted(f):
        return estimator(method, **options).fit(rows.where(F.col(fold) != f))

    with ThreadPoolExecutor(max(1, min(len(folds), FITS))) as pool:
        models = list(pool.map(fitted, folds))
    for f, model in zip(folds, models, strict=True):
        found = model.transform(rows.where(F.col(fold) == f)).select(*df.columns, F.col("__y").alias("obs"), "pred")
        out = found if out is None else out.unionByName(found)
    return out


def judged(held: DataFrame, fold: str, metric: str, pooled: bool) -> Performance:
    if metric in ("accuracy", "kappa"):
        rows = held.groupBy(fold, F.col("obs").cast("string").alias("obs"), F.col("pred").cast("string").alias("pred")).count().collect()
        parts: dict = {}
        for r in rows:
            parts.setdefault(None if pooled else r[fold], []).append((r["obs"], r["pred"], r["count"]))
        each = np.array([classification_metrics(v)[metric] for v in parts.values()])
    else:
        value = regression_metrics()[metric].alias("v")
        each = np.array([r["v"] for r in (held.agg(value) if pooled else held.groupBy(fold).agg(value)).collect() if r["v"] is not None])
    return Performance(float(each.mean()), float(each.std(ddof=1) / np.sqrt(len(each))) if len(each) > 1 else None)


def importance_weights(model, variables: list[str]) -> dict[str, float]:
    """Variable importances of a fitted Spark ML model as weights; one variable: 1."""
    if len(variables) == 1:
        return {variables[0]: 1.0}
    if hasattr(model, "featureImportances"):
        return dict(zip(variables, model.featureImportances.toArray().tolist(), strict=True))
    if hasattr(model, "coefficients"):
        return dict(zip(variables, np.abs(model.coefficients.toArray()).tolist(), strict=True))
    raise DomainError("this model has no importances")


__all__ = ["MAXIMISED", "LinearEvaluator", "MlEvaluator", "Performance", "assembled", "confusion", "estimator", "gram_by_fold", "held_out", "importance_weights", "judged"]
