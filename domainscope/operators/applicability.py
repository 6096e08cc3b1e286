"""Dissimilarity index, local point density and area of applicability.

Training rows are z-scored, weighted and compared with each other: ``dbar`` is the mean over rows of the mean distance to all others, and a
row's DI is its distance to the nearest row that may train its fold, divided by dbar. The threshold is the upper whisker of the training
DI. A new row is inside the area of applicability if its DI, by the nearest training row, does not exceed the threshold; its LPD counts the
training rows closer than the threshold.

The training table is the bounded side (see plans.neighbours); new rows stream past it in one map-only stage and keep all their columns.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainscope.errors import DomainError, DomainWarning
from domainscope.functions.distributions import kernel_density, upper_whisker
from domainscope.functions.metrics import Metric, whitening
from domainscope.functions.scaling import Dummies, Scaler, is_categorical
from domainscope.operators.folds import FoldLists, Folds
from domainscope.plans.neighbours import Features, nearest, rows_that_travel
from domainscope.plans.stable import numbered


def checked_weights(weights: dict[str, float] | None, variables: list[str]) -> dict[str, float]:
    """One weight for each variable; malformed ones are all 1, negative ones 0; not all may be 0."""
    if weights is None:
        return dict.fromkeys(variables, 1.0)
    if set(weights) != set(variables) or any(w is None or w != w for w in weights.values()):
        warnings.warn("weights don't name the variables: all are 1", DomainWarning, stacklevel=3)
        return dict.fromkeys(variables, 1.0)
    if any(w < 0 for w in weights.values()):
        warnings.warn("negative weights are 0", DomainWarning, stacklevel=3)
    out = {v: max(0.0, float(weights[v])) for v in variables}
    if not any(out.values()):
        raise DomainError("all weights are 0 or less")
    return out


@dataclass(frozen=True)
class Space:
    """The feature space of a training table: dummies for categories, z-scores, weights."""

    variables: list[str]
    dummies: Dummies
    scaler: Scaler
    weights: dict[str, float]

    @classmethod
    def fit(cls, train: DataFrame, variables: list[str], weights: dict[str, float] | None) -> Space:
        categorical = [v for v in variables if is_categorical(train, v)]
        given = checked_weights(weights, variables)
        dummies = Dummies.fit(train, categorical)
        wide = train.select(*(c.alias(n) for n, c in {**{v: F.col(v) for v in variables if v not in categorical}, **dummies.columns()}.items()))
        scaler = Scaler.fit(wide, wide.columns)
        scaler.check()
        owner = {n: c for c, levels in dummies.levels.items() for n in (f"{c}_{v}" for v in levels)}
        return cls(variables, dummies, scaler, {n: given[owner.get(n, n)] for n in wide.columns})

    def columns(self) -> list[Column]:
        dummies = self.dummies.columns()
        return [(self.scaler.of(n, dummies.get(n)) * F.lit(self.weights[n])).alias(n) for n in self.scaler.mean]

    def features(self) -> Features:
        return Features(self.columns())


@dataclass(frozen=True)
class TrainDI:
    """What ``aoa`` needs of a training table, and the training rows' own values (rows: row_id, avg_dist, min_dist, train_di, lpd)."""

    train: DataFrame
    row_id: str
    space: Space
    metric: Metric
    n: int
    dbar: float
    threshold: float
    rows: DataFrame
    avg_lpd: int | None = None
    has_folds: bool = False
    kept: DataFrame | None = field(default=None, repr=False)

    def summary(self) -> DataFrame:
        row = (", ".join(self.space.variables), self.n, self.metric.name, self.dbar, self.threshold, self.avg_lpd)
        return self.train.sparkSession.createDataFrame([row], "variables string, n long, method string, avg_distance double, threshold double, avg_lpd long")

    def free(self) -> None:
        """Lets go of the training rows' results, which are kept in memory; they still work, and are computed again."""
        if self.kept is not None:
            self.kept.unpersist()

    def plot_data(self, points: int = 512) -> DataFrame:
        """x, density of the training DI, and the threshold in each row."""
        return kernel_density(self.rows, "train_di", points).withColumn("threshold", F.lit(self.threshold))

    def __repr__(self) -> str:
        return f"TrainDI({self.n} rows, {len(self.space.variables)} variables, {self.metric.name}, threshold {self.threshold:.6g})"


def train_di(
    train: DataFrame, row_id: str, variables: list[str] | None = None, weights: dict[str, float] | None = None, folds: Folds | FoldLists | None = None, fold: str | None = None,
    method: str = "L2", use_weight: bool = True, lpd: bool = False, response: str | None = None,
) -> TrainDI:
    """folds: a Folds of one variable, or FoldLists; or fold: a column of fold numbers. Without: every row has all others to be near to.

    A row that misses a variable has no values; one that no fold tests has no DI."""
    if method not in ("L2", "MD"):
        raise DomainError(f"method {method!r}: L2 or MD")
    variables = variables or [c for c in train.columns if c not in (row_id, response, fold)]
    if missing := [v for v in variables if v not in train.columns]:
        raise DomainError(f"not in the training table: {', '.join(missing)}")
    n = train.count()
    if n < 2:
        raise DomainError("at least two training rows are needed")
    space = Space.fit(train, variables, weights if use_weight else None)
    features = space.features()
    metric = Metric("euclidean")
    if method == "MD":
        names = list(space.scaler.mean)
        scaled = train.select(*space.columns()).dropna()
        covariance = scaled.agg(*(F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names))).first()
        metric = Metric("mahalanobis", whiten=whitening(np.array(covariance, float).reshape(len(names), -1)))
    base = train.select(F.col(row_id).cast("long").alias("row_id"), *features.columns("__"), *([F.col(fold).cast("long").alias("__given")] if fold else []))
    inner = Features([F.col(f"__f{i}") for i in range(len(features.numeric))])
    averages = nearest(base, base, inner, metric, "row_id", rule="other").select(*base.columns, (F.col("sum_dist") / F.col("n_dist")).alias("avg_dist"), F.col("nn_dist").alias("__self"))
    first = averages = averages.persist()
    dbar = averages.agg(F.avg("avg_dist")).first()[0]
    rule, apart = "other", None
    if isinstance(folds, FoldLists):
        tested = folds.fold_of()
        rule, apart = "apart", folds.allowed()
        given = train.sparkSession.createDataFrame(list(tested.items()), "__r long, __test long")
        averages = averages.join(given, averages["row_id"] == given["__r"], "left").drop("__r")
    elif isinstance(folds, Folds):
        rule = "out_of_fold"
        given = folds.assigned.select(F.col("row_id").cast("long").alias("__r"), F.col("test_fold").cast("long").alias("__test"))
        if folds.both:
            lists = folds.table.where("role = 'train'").groupBy("fold").agg(F.collect_list(F.col("row_id").cast("long")).alias("ids")).collect()  # k lists of the bounded training side
            rule, apart = "apart", {r["fold"]: np.array(r["ids"], np.int64) for r in lists}
        averages = averages.join(given, averages["row_id"] == given["__r"], "left").drop("__r")
    elif fold:
        rule, averages = "out_of_fold", averages.withColumnRenamed("__given", "__test")
    has_folds = rule != "other"
    shown = averages.withColumn("__test", F.col("__test") if has_folds else F.lit(1).cast("long"))
    if has_folds:
        # a row that no fold tests has no DI, but may be a neighbour
        low = nearest(shown, shown, inner, metric, "row_id", rule=rule, fold="__test", apart=apart, sums=False)
        least = F.when(F.col("__test").isNotNull(), F.col("nn_dist"))
        rows = low.select("row_id", "avg_dist", least.alias("min_dist"), *inner_names(inner), "__test")
    else:
        rows = shown.select("row_id", "avg_dist", F.col("__self").alias("min_dist"), *inner_names(inner), "__test")
    held = rows = rows.withColumn("train_di", F.col("min_dist") / F.lit(dbar)).persist()
    threshold = upper_whisker(rows, "train_di")
    first.unpersist()  # rows are kept from here on
    if threshold is None:
        raise DomainError("no training row has a dissimilarity")
    average = None
    if lpd:
        counted = nearest(rows, rows, inner, metric, "row_id", rule=rule, fold="__test", apart=apart, threshold=threshold * dbar, sums=False)
        rows = counted.withColumn("lpd", F.when(F.col("min_dist").isNotNull(), F.col("n_under"))).select("row_id", "avg_dist", "min_dist", "train_di", "lpd")
        average = rows.agg(F.bround(F.avg("lpd"))).first()[0]
    else:
        rows = rows.select("row_id", "avg_dist", "min_dist", "train_di", F.lit(None).cast("long").alias("lpd"))
    return TrainDI(train, row_id, space, metric, n, dbar, threshold, rows, None if average is None else int(average), has_folds, held)


def inner_names(features: Features) -> list[str]:
    return [f"__f{i}" for i in range(len(features.numeric))]


@dataclass(frozen=True)
class Aoa:
    """rows: the new rows with di, aoa (1 inside, 0 outside, null where a variable is missing) and, if asked for, lpd and nn_ids."""

    rows: DataFrame
    model: TrainDI
    threshold: float
    max_lpd: int | None = None
    train_di: DataFrame | None = field(default=None, repr=False)

    def largest_lpd(self) -> int | None:
        """The largest local density met, the max_lpd to use next time."""
        return None if self.max_lpd is None else self.rows.agg(F.max("lpd")).first()[0]

    def plot_data(self, variable: str = "di", points: int = 512) -> DataFrame:
        """what (train or target), x, density of the DI or LPD of both, and the threshold in each row."""
        if variable not in ("di", "lpd") or variable == "lpd" and (self.max_lpd is None or self.model.avg_lpd is None):
            raise DomainError(f"no {variable} to plot")
        own = self.train_di.select(F.col("train_di" if variable == "di" else "lpd").alias("v"))
        curves = [kernel_density(df, "v", points).withColumn("what", F.lit(what)) for what, df in (("train", own), ("target", self.rows.select(F.col(variable).alias("v"))))]
        return curves[0].unionByName(curves[1]).withColumn("threshold", F.lit(self.threshold if variable == "di" else None).cast("double"))

    def __repr__(self) -> str:
        return f"Aoa(threshold {self.threshold:.6g}, {'with' if self.max_lpd else 'without'} local density)"

    def summary(self) -> DataFrame:
        lpd = [F.avg("lpd").alias("mean_lpd"), F.max("lpd").alias("max_lpd")] if self.max_lpd else []
        return self.rows.agg(F.count("*").alias("n"), F.count("di").alias("scored"), F.sum("aoa").alias("inside"), F.avg("di").alias("mean_di"), F.max("di").alias("max_di"), *lpd).withColumn("threshold", F.lit(self.threshold))


def checked_max_lpd(max_lpd: float, n: int) -> int:
    """A share of the training rows if at most 1, else their number."""
    if isinstance(max_lpd, bool) or not isinstance(max_lpd, (int, float)):
        raise DomainError("max_lpd must be a number")
    if max_lpd <= 0:
        raise DomainError("max_lpd must be over 0")
    if max_lpd <= 1:
        whole = round(max_lpd * n)
        if whole <= 1:
            raise DomainError("max_lpd is too small: it must come to more than one row")
        return whole
    if max_lpd != int(max_lpd):
        raise DomainError("max_lpd over 1 must be a whole number")
    if max_lpd > n:
        raise DomainError("max_lpd is more than there are training rows")
    return int(max_lpd)


def aoa(newdata: DataFrame, model: TrainDI, lpd: bool = False, max_lpd: float = 1, indices: bool = False) -> Aoa:
    """DI, AOA and LPD of new rows. newdata may be a stream, if the training rows travel with the tasks. Results replace columns of the same names.

    A category that training has not seen is 0 in all dummies; a row that misses a variable gets nulls."""
    if missing := [v for v in model.space.variables if v not in newdata.columns]:
        raise DomainError(f"not in the new table: {', '.join(missing)}")
    most = checked_max_lpd(max_lpd, model.n) if lpd else None
    features = model.space.features()
    k = most if indices and most else 0
    clean = newdata.drop("di", "aoa", "lpd", "nn_ids")
    if model.n > (most_rows := rows_that_travel(*features.shape)):  # the way by blocks joins its results back on a key, which must hold from one evaluation to the next
        if clean.isStreaming:
            raise DomainError(f"a stream can't be scored against more than {most_rows} training rows")
        clean = numbered(clean, "__row")
        names = clean.columns[:-1]
    else:
        names = clean.columns
        clean = clean.withColumn("__row", F.lit(0).cast("long"))
    found = nearest(clean, model.train, features, model.metric, "__row", k=k, threshold=model.threshold * model.dbar, reference_id=model.row_id, sums=False)
    di = F.col("nn_dist") / F.lit(model.dbar)
    out = [di.alias("di"), F.when(di.isNotNull(), F.when(di > F.lit(model.threshold), 0).otherwise(1)).alias("aoa")]
    if lpd:
        count = F.when(di.isNotNull(), F.least("n_under", F.lit(most)))
        out.append(count.alias("lpd"))
        if indices:
            out.append(F.slice("nn_ids", F.lit(1), count.cast("int")).alias("nn_ids"))
    return Aoa(found.select(*names, *out), model, model.threshold, most, model.rows)


def masked(result: Aoa, layer: str, columns: tuple[str, ...] = ("di", "aoa", "lpd")) -> DataFrame:
    """For grid tables: results are null where the layer has no value."""
    return result.rows.withColumns({c: F.when(F.col(layer).isNotNull(), F.col(c)) for c in columns if c in result.rows.columns})


def normalised(result: Aoa) -> Aoa:
    """DI and training DI in units of the threshold, which becomes 1. A threshold of 0, as where most training rows are alike, leaves no number: a DI over it is infinite."""

    def units(name: str) -> Column:
        di = F.col(name)
        if result.threshold:
            return di / F.lit(result.threshold)
        return F.when(di.isNotNull(), F.when(di > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan"))))

    rows = result.model.rows.withColumn("train_di", units("train_di"))
    return replace(result, rows=result.rows.withColumn("di", units("di")), threshold=1.0, train_di=rows)
