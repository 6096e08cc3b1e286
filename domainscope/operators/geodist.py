"""Nearest-neighbour distance distributions in geographic, feature and time space, and how far apart they are."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainscope.errors import DomainError, DomainWarning
from domainscope.functions.distributions import ecdf, kernel_density, union, wasserstein_to
from domainscope.functions.metrics import TIME_UNITS, Metric, check, time_value, whitening
from domainscope.functions.scaling import Scaler, is_categorical
from domainscope.operators.folds import FoldLists
from domainscope.plans.cells import nearest_in_plane
from domainscope.plans.neighbours import Features, nearest, ranges, rows_that_travel
from domainscope.plans.ordered import nearest_1d, nearest_other
from domainscope.sources.grid import Domain


@dataclass(frozen=True)
class Geo:
    """Where the coordinates of a table are, and their reference system. crs None is taken as projected."""

    x: str = "x"
    y: str = "y"
    crs: str | None = None

    @property
    def lonlat(self) -> bool:
        return self.crs in ("EPSG:4326", "OGC:CRS84")

    def columns(self) -> list[Column]:
        return [F.col(self.x), F.col(self.y)]


def same_crs(a: Geo, b: Geo) -> None:
    if a.crs != b.crs:
        raise DomainError(f"coordinates in {a.crs} and {b.crs}")


@dataclass(frozen=True)
class Comparer:
    """Features and metric of one space, learned from the training rows, for any table with these columns."""

    features: Features
    metric: Metric
    categorical: list[str]
    variables: list[str]
    place: Geo | None = None

    @classmethod
    def geographical(cls, geo: Geo, metric: str) -> Comparer:
        check("geographical", metric, False, geo.lonlat)
        return cls(Features(geo.columns()), Metric(metric), [], [geo.x, geo.y], geo)

    @classmethod
    def feature(cls, train: DataFrame, variables: list[str], metric: str, scale: bool = True, other: DataFrame | None = None) -> Comparer:
        """other: the table whose values widen the ranges for Gower, too."""
        for name, df in (("training", train), ("prediction", other)):
            if df is not None and (missing := [v for v in variables if v not in df.columns]):
                raise DomainError(f"not in the {name} table: {', '.join(missing)}")
        categorical = [v for v in variables if is_categorical(train, v)]
        check("feature", metric, bool(categorical), False)
        numeric = [v for v in variables if v not in categorical]
        if scale:
            scaler = Scaler.fit(train, numeric)
            scaler.check()
            columns = [scaler.of(v) for v in numeric]
        else:
            columns = [F.col(v).cast("double") for v in numeric]
        learned = Metric(metric)
        if metric == "gower":
            learned = Metric(metric, ranges=ranges(train, other, columns))
        elif metric == "mahalanobis":
            row = train.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).dropna().agg(*(F.covar_samp(f"c{i}", f"c{j}").alias(f"{i}_{j}") for i in range(len(columns)) for j in range(len(columns)))).first()
            learned = Metric(metric, whiten=whitening(np.array(row, float).reshape(len(columns), -1)))
        return cls(Features(columns, [F.col(v) for v in categorical]), learned, categorical, variables)

    def planar(self, references: DataFrame) -> bool:
        """Whether a search by cells of the plane is the better way: points, Euclidean, and too many references to travel."""
        return self.metric.name == "euclidean" and self.place is not None and references.count() > rows_that_travel(2)

    def nearest(self, queries: DataFrame, references: DataFrame, row_id: str, **how) -> DataFrame:
        return nearest(queries, references, self.features, self.metric, row_id, sums=False, **how)


def self_distances(x: DataFrame, comparer: Comparer, row_id: str) -> DataFrame:
    """row_id, dist: to the nearest other row."""
    if comparer.planar(x):
        return nearest_in_plane(x, x, row_id, comparer.place.x, comparer.place.y, other=True).select(F.col(row_id).alias("row_id"), "dist")
    return comparer.nearest(x, x, row_id, rule="other", keep=[row_id]).select(F.col(row_id).alias("row_id"), F.col("nn_dist").alias("dist"))


def distances_to(queries: DataFrame, x: DataFrame, comparer: Comparer, row_id: str, x_id: str | None = None) -> DataFrame:
    """row_id, dist: of each query to the nearest training row."""
    if x_id in (None, row_id) and comparer.planar(x):
        return nearest_in_plane(queries, x, row_id, comparer.place.x, comparer.place.y).select(F.col(row_id).alias("row_id"), "dist")
    return comparer.nearest(queries, x, row_id, reference_id=x_id, keep=[row_id]).select(F.col(row_id).alias("row_id"), F.col("nn_dist").alias("dist"))


def cv_distances(x: DataFrame, comparer: Comparer, row_id: str, fold: str | None = None, lists: FoldLists | None = None) -> DataFrame:
    """row_id, fold, dist: of each row that a fold tests to the nearest row that this fold trains on; never to itself."""
    if (fold is None) == (lists is None):
        raise DomainError("one of fold and lists is needed")
    if fold is not None:
        tested = x.where(F.col(fold).isNotNull())
        return comparer.nearest(tested, x, row_id, rule="out_of_fold", fold=fold, keep=[row_id, fold]).select(F.col(row_id).alias("row_id"), F.col(fold).alias("fold"), F.col("nn_dist").alias("dist"))
    pairs = x.sparkSession.createDataFrame([(i, f) for f, ids in lists.test.items() for i in ids], "__r long, __fold_no long")
    tested = x.join(pairs, F.col(row_id).cast("long") == pairs["__r"]).drop("__r")
    return comparer.nearest(tested, x, row_id, rule="apart", fold="__fold_no", apart=lists.allowed(), keep=[row_id, "__fold_no"]).select(F.col(row_id).alias("row_id"), F.col("__fold_no").alias("fold"), F.col("nn_dist").alias("dist"))


def time_distances(queries: DataFrame, references: DataFrame | None, time: str, row_id: str, unit: str) -> DataFrame:
    """row_id, dist in time units to the nearest reference, by one ordered pass instead of pairs; references None: the other queries."""
    q = queries.select(F.col(row_id).alias("row_id"), time_value(F.col(time), unit).alias("t"))
    if references is None:
        both = nearest_1d(q.where("t is not null").withColumn("ref", F.lit(True)), "t", "ref")
        # among equal times the order decides who stands before; either neighbour is at 0
        rows = both
    else:
        r = references.select(F.lit(None).cast(q.schema["row_id"].dataType).alias("row_id"), time_value(F.col(time), unit).alias("t"))
        both = q.withColumn("ref", F.lit(False)).unionByName(r.withColumn("ref", F.lit(True))).where("t is not null")
        rows = nearest_1d(both, "t", "ref").where("not ref")
    dist = F.least(F.col("t") - F.col("below"), F.col("above") - F.col("t"))
    return rows.select("row_id", dist.alias("dist")).unionByName(q.where("t is null").select("row_id", F.lit(None).cast("double").alias("dist")))


def time_cv_distances(x: DataFrame, time: str, row_id: str, fold: str, unit: str) -> DataFrame:
    """row_id, fold, dist: to the nearest time in another fold, by one ordered pass instead of pairs; only rows with a fold are tested."""
    if unit not in TIME_UNITS:
        raise DomainError(f"time unit {unit!r}: one of {', '.join(TIME_UNITS)}")
    t = x.select(F.col(row_id).alias("row_id"), F.col(fold).alias("fold"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"))  # whole numbers: differences are exact
    dist = F.least(F.col("t") - F.col("below"), F.col("above") - F.col("t")).cast("double") / (1e6 * TIME_UNITS[unit])
    found = nearest_other(t.where("t is not null"), "t", "fold").select("row_id", "fold", dist.alias("dist"))
    return found.unionByName(t.where("t is null").select("row_id", "fold", F.lit(None).cast("double").alias("dist"))).where("fold is not null")


@dataclass(frozen=True)
class GeoDist:
    """rows: dist, what, dist_type, kept in memory until free(). w: Wasserstein-1 of each kind against the prediction-to-sample distances."""

    rows: DataFrame
    w_sample: float | None
    w_test: float | None
    w_cv: float | None
    unit: str | None = None

    def free(self) -> None:
        """Lets go of the distances; rows still works, and computes them again."""
        self.rows.unpersist()

    def summary(self) -> DataFrame:
        return self.rows.groupBy("what", "dist_type").agg(F.count("dist").alias("n"), F.avg("dist").alias("mean"), F.min("dist").alias("min"), F.max("dist").alias("max"))

    def plot_data(self, stat: str = "density", km: bool = False) -> DataFrame:
        """what and the curve (x, density) or (v, f) of each kind."""
        frames = []
        for what in [r["what"] for r in self.rows.select("what").distinct().orderBy("what").collect()]:
            some = self.rows.where(F.col("what") == what).select((F.col("dist") / (1000.0 if km else 1.0)).alias("dist"))
            frames.append((kernel_density(some, "dist") if stat == "density" else ecdf(some, "dist")).withColumn("what", F.lit(what)))
        return union(frames)


def prediction_rows(x: DataFrame, pred: DataFrame | None, domain: Domain | None, n: int, sampling: str, row_id: str, seed: int = 1) -> DataFrame:
    """The prediction rows given, or a sample of the model domain."""
    if pred is not None:
        return pred
    if domain is None:
        raise DomainError("prediction rows or a model domain are needed")
    return domain.points(x.sparkSession, n, sampling, seed, row_id)


def geodist(
    x: DataFrame, preddata: DataFrame | None, row_id: str, *, modeldomain: Domain | None = None, samplesize: int = 2000, sampling: str = "regular", space: str = "geographical", metric: str | None = None, geo: Geo | None = None, pred_geo: Geo | None = None, variables: list[str] | None = None,
    testdata: DataFrame | None = None, fold: str | None = None, lists: FoldLists | None = None, time: str | None = None, time_unit: str = "auto", scale: bool = True, pred_id: str | None = None,
) -> GeoDist:
    """The distances sample-to-sample, prediction-to-sample and, if given, test-to-sample and CV."""
    space = {"geo": "geographical"}.get(space, space)
    if space not in ("geographical", "feature", "time"):
        raise DomainError(f"space {space!r}: geographical, feature or time")
    pred_id = pred_id or row_id
    preddata = prediction_rows(x, preddata, modeldomain, samplesize, sampling, pred_id)
    unit = None
    if space == "time":
        if metric not in (None, "abs_time"):
            warnings.warn("time is compared by abs_time", DomainWarning, stacklevel=2)
        if time is None:
            raise DomainError("time space needs a time column")
        unit = ("days" if x.schema[time].dataType.typeName() == "date" else "secs") if time_unit == "auto" else time_unit
        if unit not in TIME_UNITS:
            raise DomainError(f"time unit {unit!r}: one of {', '.join(TIME_UNITS)}")
        own = time_distances(x, None, time, row_id, unit)
        pred = time_distances(preddata, x, time, pred_id, unit)
        test = time_distances(testdata, x, time, row_id, unit) if testdata is not None else None
        comparer = Comparer(Features([time_value(F.col(time), unit)]), Metric("euclidean"), [], [time])
    else:
        if space == "geographical":
            geo = geo or Geo()
            if pred_geo is not None:
                same_crs(geo, pred_geo)
            if geo.crs is None:
                warnings.warn("no reference system: taken as projected", DomainWarning, stacklevel=2)
            comparer = Comparer.geographical(geo, metric or ("great_circle" if geo.lonlat else "euclidean"))
        else:
            variables = variables or [c for c in preddata.columns if c not in (pred_id, fold)]
            comparer = Comparer.feature(x, variables, metric or "euclidean", scale, preddata)
        own = self_distances(x, comparer, row_id)
        pred = distances_to(preddata, x, comparer, pred_id, row_id)
        test = distances_to(testdata, x, comparer, row_id) if testdata is not None else None
    cv = time_cv_distances(x, time, row_id, fold, unit) if space == "time" and fold else cv_distances(x, comparer, row_id, fold, lists) if fold or lists else None
    parts = {"sample-to-sample": own, "prediction-to-sample": pred, "test-to-sample": test, "CV-distances": cv}
    rows = union([d.select("dist", F.lit(what).alias("what"), F.lit(space).alias("dist_type")) for what, d in parts.items() if d is not None]).persist()
    w = wasserstein_to(rows, "dist", "what", "prediction-to-sample")
    return GeoDist(rows, w.get("sample-to-sample"), w.get("test-to-sample"), w.get("CV-distances"), unit)
