"""A fitted model as the one thing to pass around: its training rows, folds, held-out predictions and weights go where they are needed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainscope.errors import DomainError
from domainscope.operators import applicability, learners, profiles, validation


@dataclass(frozen=True)
class Model:
    """predictions: row_id, fold, obs and pred of each row, by the model that its fold did not train. weights: of the variables, from the model of all rows."""

    train: DataFrame
    row_id: str
    variables: list[str]
    response: str
    fold: str
    method: str
    setting: dict
    metric: str
    predictions: DataFrame
    weights: dict[str, float]
    fitted: object = field(repr=False)

    def predict(self, new: DataFrame) -> DataFrame:
        """new, of its rows those that miss no variable, with pred, which replaces a column of this name."""
        new = new.drop("pred")
        rows = learners.assembled(new.withColumn("__none", F.lit(0.0)), self.variables, "__none")
        return self.fitted.transform(rows).select(*new.columns, "pred")

    def train_di(self, lpd: bool = False, use_weight: bool = True, method: str = "L2") -> applicability.TrainDI:
        return applicability.train_di(self.train, self.row_id, self.variables, self.weights, fold=self.fold, method=method, use_weight=use_weight, lpd=lpd)

    def aoa(self, new: DataFrame, lpd: bool = False, max_lpd: float = 1, use_weight: bool = True) -> applicability.Aoa:
        return applicability.aoa(new, self.train_di(lpd, use_weight), lpd=lpd, max_lpd=max_lpd)

    def global_validation(self) -> DataFrame:
        return validation.global_validation(self.predictions, classification=self.metric in ("accuracy", "kappa"))

    def error_profile(self, variable: str = "di", use_weight: bool = True, **how) -> validation.ErrorModel:
        """The error of the held-out predictions over their dissimilarity or local density."""
        own = self.train_di(variable == "lpd", use_weight)
        found = own.rows.select(F.col("row_id").alias(self.row_id), F.col("train_di").alias("di"), "lpd")
        joined = self.predictions.join(found, self.predictions[self.row_id].cast("long") == found[self.row_id]).select(self.predictions[self.row_id], "obs", "pred", "di", "lpd")
        return profiles.error_profile(joined, self.row_id, variable, own.threshold, **how)


def fitted(train: DataFrame, row_id: str, variables: list[str], response: str, fold: str, method: str = "lm", metric: str = "rmse", grid: list[dict] | None = None, **options) -> Model:
    """Cross-validates over the folds for each setting of the grid, keeps the held-out predictions of the best, and fits it to all rows."""
    if metric not in learners.MAXIMISED:
        raise DomainError(f"metric {metric!r}: one of {', '.join(learners.MAXIMISED)}")
    folds = [r[0] for r in train.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect()]  # one row a fold
    if len(folds) < 2:
        raise DomainError("at least two folds are needed")
    slim = train.select(*dict.fromkeys([row_id, fold, *variables]), F.col(response).alias("__response"))  # no column that a learner writes
    best = None
    for setting in grid or [{}]:
        held = learners.held_out(slim, variables, "__response", fold, folds, method, **options, **setting)
        found = learners.judged(held, fold, metric, False)
        if best is None or (found.value > best[0].value if learners.MAXIMISED[metric] else found.value < best[0].value):
            best = found, setting, held
    _, setting, held = best
    whole = learners.estimator(method, **options, **setting).fit(learners.assembled(slim, variables, "__response"))
    return Model(train, row_id, variables, response, fold, method, setting, metric, held.select(row_id, fold, "obs", "pred"), learners.importance_weights(whole, variables), whole)
