"""Error profiles from held-out predictions, also over several cross-validations of growing extrapolation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainscope.errors import DomainError
from domainscope.operators import cluster
from domainscope.operators.applicability import train_di
from domainscope.operators.geodist import Comparer, Geo, cv_distances
from domainscope.operators.learners import held_out
from domainscope.operators.validation import ErrorModel, error_model, inside


def error_profile(
    predictions: DataFrame, row_id: str, variable: str = "di", threshold: float | None = None, *, metric: str = "rmse", window: int = 5, calibration: str = "spline", k: int = 6, m: int = 2,
) -> ErrorModel:
    """predictions: row_id, obs, pred and the variable (di, lpd or geodist) of each held-out row; only rows inside the area of applicability count."""
    if variable not in predictions.columns:
        raise DomainError(f"no {variable} in the predictions")
    if variable == "di" and threshold is None:
        raise DomainError("the threshold is needed for di")
    return error_model(inside(predictions, variable, threshold), variable, [row_id], metric=metric, window=window, calibration=calibration, threshold=threshold, k=k, m=m)


def _lm_held_out(x: np.ndarray, y: np.ndarray, clusters: np.ndarray) -> np.ndarray:
    """The prediction of each row by least squares on the rows of all other clusters, from sums of products by cluster, without a refit."""
    n = int(clusters.max()) + 1
    design = np.column_stack([np.ones(len(x)), x])
    grams, moments = np.zeros((n, design.shape[1], design.shape[1])), np.zeros((n, design.shape[1]))
    centre = y.mean()
    np.add.at(grams, clusters, design[:, :, None] * design[:, None, :])
    np.add.at(moments, clusters, design * (y - centre)[:, None])
    rest, right = grams.sum(axis=0) - grams, moments.sum(axis=0) - moments
    fitted = np.stack([np.linalg.lstsq(g, m, rcond=None)[0] for g, m in zip(rest, right, strict=True)])
    return (design * fitted[clusters]).sum(axis=1) + centre


def multi_cv_predictions(
    train: DataFrame, row_id: str, variables: list[str], response: str, *, method: str = "lm", length: int = 10, weights: dict[str, float] | None = None, lpd: bool = False, seed: int = 1, most: int = 20_000, variable: str = "di", geo: Geo | None = None,
) -> tuple[DataFrame, float]:
    """Pooled held-out rows (row_id, obs, pred, n_clusters, and di, lpd or geodist) of leave-cluster-out fits for a growing number of k-means clusters,
    and the threshold of the last of them. Every cluster is held out by itself: lm needs no refit for that, other learners are fitted once a cluster.

    variable: di keeps the rows within the threshold, lpd those of density over 0; geodist, the distance to the nearest row of another cluster
    where geo says, keeps all, and its threshold is not a number. Each round clusters a bounded training sample in memory."""
    if variable not in ("di", "lpd", "geodist"):
        raise DomainError(f"variable {variable!r}: di, lpd or geodist")
    geo = geo or Geo()
    places = [c for c in (geo.x, geo.y) if variable == "geodist" and c not in variables]
    rows = train.dropna(subset=[*variables, response]).select(F.col(row_id).cast("long").alias(row_id), *variables, *places, response)
    n = rows.count()
    if n > most:
        raise DomainError(f"{n} training rows; clusters are made of at most {most}")
    table = rows.orderBy(row_id).toArrow()
    x = np.stack([table.column(v).to_numpy().astype(float) for v in variables], axis=1)
    sd = x.std(axis=0, ddof=1)
    z = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
    ids, y = table.column(row_id).to_numpy(), table.column(response).to_numpy().astype(float)
    out, threshold = None, float("nan")
    counts = sorted({int(round(c)) for c in np.linspace(3, min(n, len(np.unique(z, axis=0))), length)})
    for count in counts:
        clusters = cluster.kmeans(z, count, seed)
        folds = clusters + 1
        spark = rows.sparkSession
        placed = spark.createDataFrame(pd.DataFrame({row_id: ids, "__held": folds}), f"{row_id} long, __held long")
        tagged = rows.join(F.broadcast(placed), row_id).persist()
        if method == "lm":
            held = spark.createDataFrame(pd.DataFrame({row_id: ids, "obs": y, "pred": _lm_held_out(z, y, clusters)}), f"{row_id} long, obs double, pred double")
        else:
            held = held_out(tagged, variables, response, "__held", sorted(set(folds.tolist())), method).select(row_id, "obs", "pred")
        if variable == "geodist":
            comparer = Comparer.geographical(geo, "great_circle" if geo.lonlat else "euclidean")
            far = cv_distances(tagged, comparer, row_id, fold="__held").select(F.col("row_id").alias(row_id), F.col("dist").alias("geodist"))
            found = held.join(far, row_id).select(row_id, "obs", "pred", "geodist", F.lit(count).alias("n_clusters"))
        else:
            model = train_di(tagged, row_id, variables, weights, fold="__held", lpd=lpd or variable == "lpd")
            found = held.join(model.rows.select(F.col("row_id").alias(row_id), F.col("train_di").alias("di"), "lpd"), row_id).select(row_id, "obs", "pred", "di", "lpd", F.lit(count).alias("n_clusters"))
            found, threshold = inside(found, variable, model.threshold), model.threshold
        names = found.schema
        found = spark.createDataFrame(found.toArrow(), names)  # no more rows than the bounded sample has
        tagged.unpersist()
        out = found if out is None else out.unionByName(found)
    return out, threshold
