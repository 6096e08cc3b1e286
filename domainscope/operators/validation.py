"""Performance on pooled held-out predictions, and error as a function of dissimilarity."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from domainscope.errors import DomainError
from domainscope.plans.ordered import with_rank


def regression_metrics(obs: str = "obs", pred: str = "pred", frame: WindowSpec | None = None) -> dict[str, Column]:
    """Over a group, or over the rows of a frame."""
    o, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    over = lambda c: c if frame is None else c.over(frame)
    return {"rmse": F.sqrt(over(F.avg((o - p) * (o - p)))), "rsquared": F.pow(over(F.corr(o, p)), 2), "mae": over(F.avg(F.abs(o - p)))}


def confusion(predictions: DataFrame, obs: str = "obs", pred: str = "pred") -> DataFrame:
    """obs, pred, n."""
    return predictions.where(F.col(obs).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(obs).cast("string").alias("obs"), F.col(pred).cast("string").alias("pred")).agg(F.count("*").alias("n"))


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def _upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for a binomial."""
    if p <= 0:
        return 1.0 if k <= 0 else 0.0
    if p >= 1:
        return 1.0
    return min(1.0, sum(math.exp(_log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(max(k, 0), n + 1)))


def _bisect(f, target: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


def classification_metrics(counts: list[tuple[str, str, int]]) -> dict[str, float | None]:
    """Accuracy with its exact binomial interval, kappa, the accuracy of the largest class and the p-value against it, McNemar's p-value."""
    n = sum(c for *_, c in counts)
    if not n:
        raise DomainError("no predictions")
    classes = sorted({x for o, p, _ in counts for x in (o, p)})
    table = {(o, p): c for o, p, c in counts}
    right = sum(table.get((c, c), 0) for c in classes)
    row = {c: sum(table.get((c, p), 0) for p in classes) for c in classes}
    col = {c: sum(table.get((o, c), 0) for o in classes) for c in classes}
    chance = sum(row[c] * col[c] for c in classes) / n**2
    accuracy, null = right / n, max(row.values()) / n
    kappa = (accuracy - chance) / (1 - chance) if chance < 1 else 0.0
    lower = 0.0 if right == 0 else _bisect(lambda p: _upper_tail(right, n, p), 0.025)
    upper = 1.0 if right == n else _bisect(lambda p: _upper_tail(right + 1, n, p), 0.975)
    chi, df = 0.0, 0
    for i, a in enumerate(classes):
        for b in classes[i + 1 :]:
            x, y = table.get((a, b), 0), table.get((b, a), 0)
            if x + y:
                chi, df = chi + (abs(x - y) - (1 if len(classes) == 2 else 0)) ** 2 / (x + y), df + 1
    return {"accuracy": accuracy, "kappa": kappa, "accuracy_lower": lower, "accuracy_upper": upper, "accuracy_null": null, "accuracy_p_value": _upper_tail(right, n, null), "mcnemar_p_value": _chi_tail(chi, df) if df else None}


def _chi_tail(x: float, df: int) -> float:
    """The upper tail of a chi-square distribution, by the series of the incomplete gamma function."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    term = total = 1 / a
    for i in range(1, 2000):
        term *= z / (a + i)
        total += term
        if term < total * 1e-15:
            break
    return max(0.0, 1 - total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def best_tune(predictions: DataFrame, tune: dict | None) -> DataFrame:
    """The held-out predictions of the best tuning values."""
    for c, v in (tune or {}).items():
        predictions = predictions.where(F.col(c) == F.lit(v))
    return predictions


def global_validation(predictions: DataFrame | None, obs: str = "obs", pred: str = "pred", tune: dict | None = None, classification: bool | None = None) -> DataFrame:
    """One row of metrics over all held-out rows pooled; classification: None reads it off the observed column's type."""
    if predictions is None:
        raise DomainError("no held-out predictions were kept")
    rows = best_tune(predictions, tune)
    if classification is None:
        classification = rows.schema[obs].dataType.typeName() in ("string", "boolean")
    if not classification:
        return rows.where(F.col(obs).isNotNull() & F.col(pred).isNotNull()).agg(*(v.alias(k) for k, v in regression_metrics(obs, pred).items()))
    found = classification_metrics([tuple(r) for r in confusion(rows, obs, pred).collect()])  # classes squared
    return rows.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{k} double" for k in found))


def per_fold(predictions: DataFrame, fold: str, obs: str = "obs", pred: str = "pred") -> DataFrame:
    """fold and its metrics."""
    return predictions.groupBy(F.col(fold).alias("fold")).agg(*(v.alias(k) for k, v in regression_metrics(obs, pred).items()))


def mean_and_se(metrics: DataFrame, metric: str) -> DataFrame:
    """The mean over folds and its standard error."""
    return metrics.agg(F.avg(metric).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("se"))


#: Ranks that one partition of moving windows holds, beside a halo of less than a window.
_STRETCH = 100_000


def _windows(rows: DataFrame, variable: str, window: int, ties: list[str], obs: str, pred: str) -> DataFrame:
    """rank, v, obs, pred, home (the stretch of ranks that a row is in) and stretch: each row in its own stretch, and those at the edges beside it, too."""
    if window < 1:
        raise DomainError("the window must hold at least one row")
    ranked = with_rank(rows.where(F.col(variable).isNotNull()).select(F.col(variable).alias("v"), F.col(obs).alias("obs"), F.col(pred).alias("pred"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(ties))), "v", [f"t{i}" for i in range(len(ties))])
    size = max(_STRETCH, window)
    own = F.floor((F.col("rank") - 1) / size)
    place = (F.col("rank") - 1) % size
    near = F.array(own, F.when(place < window, own - 1), F.when(place >= size - window, own + 1))
    return ranked.select("rank", "v", "obs", "pred", own.alias("home"), F.explode(F.array_compact(near)).alias("stretch"))


def moving_error(rows: DataFrame, variable: str, window: int, ties: list[str], obs: str = "obs", pred: str = "pred", metric: str = "rmse") -> DataFrame:
    """rank, variable, and the metric over a centred window of rows in the order of the variable; incomplete windows are left out.

    Windows run within stretches of ranks that overlap by a window: no window function over all rows in one task."""
    frame = Window.partitionBy("stretch").orderBy("rank").rowsBetween(-((window - 1) // 2), window // 2)
    metrics = regression_metrics(frame=frame) | {"accuracy": F.avg((F.col("obs") == F.col("pred")).cast("double")).over(frame)}
    if metric == "kappa":
        raise DomainError("kappa by window: take moving_kappa")
    if metric not in metrics:
        raise DomainError(f"metric {metric!r}: one of {', '.join(metrics)}, kappa")
    spread = _windows(rows, variable, window, ties, obs, pred)
    found = spread.select("rank", "v", "stretch", "home", F.count(F.lit(1)).over(frame).alias("n"), metrics[metric].alias(metric))
    return found.where((F.col("stretch") == F.col("home")) & (F.col("n") == window)).select("rank", F.col("v").alias(variable), metric)


def moving_kappa(rows: DataFrame, variable: str, window: int, ties: list[str], obs: str = "obs", pred: str = "pred") -> DataFrame:
    """The same for kappa; 0 where a window holds one class alone."""
    ranked = with_rank(rows.where(F.col(variable).isNotNull()).select(F.col(variable).alias("v"), F.col(obs).cast("string").alias("obs"), F.col(pred).cast("string").alias("pred"), *(F.col(t).alias(f"t{i}") for i, t in enumerate(ties))), "v", [f"t{i}" for i in range(len(ties))])
    back, ahead = (window - 1) // 2, window // 2
    spread = ranked.select("*", F.explode(F.sequence(F.col("rank") - ahead, F.col("rank") + back)).alias("at"))
    base = spread.groupBy("at").agg(F.count("*").alias("n"), F.max(F.when(F.col("rank") == F.col("at"), F.col("v"))).alias(variable), F.sum((F.col("obs") == F.col("pred")).cast("double")).alias("right"))
    sides = spread.select("at", F.explode(F.array(F.struct(F.col("obs").alias("c"), F.lit(1.0).alias("o"), F.lit(0.0).alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0.0).alias("o"), F.lit(1.0).alias("p")))).alias("s")).groupBy("at", "s.c").agg(F.sum("s.o").alias("o"), F.sum("s.p").alias("p"))
    chance = sides.groupBy("at").agg(F.sum(F.col("o") * F.col("p")).alias("both"))
    accuracy, expected = F.col("right") / F.col("n"), F.col("both") / (F.col("n") * F.col("n"))
    kappa = F.when(expected < 1, (accuracy - expected) / (1 - expected)).otherwise(0.0)
    return base.join(chance, "at").where((F.col("n") == window) & F.col(variable).isNotNull()).select(F.col("at").alias("rank"), variable, kappa.alias("kappa"))


@dataclass(frozen=True)
class ErrorModel:
    """The windows' metric, kept in memory until free(), and its fitted curve. kind: lm, exp (on the logarithm), isotonic, or spline (monotone).

    Without a complete window there is no curve: no knots, or a line of nulls, and no point; the error is null everywhere."""

    points: DataFrame
    variable: str
    metric: str
    kind: str
    knots: tuple[tuple[float, float], ...]
    threshold: float | None = None

    def free(self) -> None:
        """Lets go of the points, which still work."""
        self.points.unpersist()

    def predict(self, df: DataFrame, column: str | None = None, name: str = "error") -> DataFrame:
        """df with the error that the curve gives for its variable; beyond the fitted range a curve other than a line stays at its end."""
        v = F.col(column or self.variable).cast("double")
        if self.kind in ("lm", "exp"):
            (intercept, slope), = self.knots
            return df.withColumn(name, F.lit(intercept).cast("double") + F.lit(slope).cast("double") * (F.log(v) if self.kind == "exp" else v))
        if not self.knots:
            return df.withColumn(name, F.lit(None).cast("double"))
        out = F.lit(self.knots[-1][1])
        for (x0, y0), (x1, y1) in reversed(list(zip(self.knots, self.knots[1:]))):
            out = F.when(v < x1, F.lit(y0) + (v - x0) * ((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)).otherwise(out)
        return df.withColumn(name, F.when(v.isNotNull(), F.when(v < self.knots[0][0], F.lit(self.knots[0][1])).otherwise(out)))

    def plot_data(self) -> DataFrame:
        """The points with the fitted value beside them."""
        return self.predict(self.points, self.variable, "fitted")


def pool_adjacent(y: np.ndarray, w: np.ndarray, increasing: bool) -> np.ndarray:
    """The monotone sequence closest to y."""
    sign = 1 if increasing else -1
    blocks: list[list[float]] = []
    for v, n in zip(sign * y, w, strict=True):
        blocks.append([v, n, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return sign * np.concatenate([np.full(int(c), v) for v, _, c in blocks])


def monotone_spline(x: np.ndarray, y: np.ndarray, w: np.ndarray, increasing: bool, k: int = 6, m: int = 2, penalty: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a monotone P-spline: I-spline coefficients kept at 0 or more, second differences penalised, by projected gradient."""
    grid = np.linspace(x.min(), x.max(), 50)
    inner = np.linspace(x.min(), x.max(), max(2, k - m + 1))
    step = inner[1] - inner[0] or 1.0

    def basis(v: np.ndarray) -> np.ndarray:
        cols = [np.ones_like(v)]
        for c in np.linspace(x.min() - step, x.max(), k):
            t = np.clip((v - c) / (2 * step), 0, 1)
            cols.append(t * t * (3 - 2 * t))
        return np.stack(cols, axis=1)

    b, sign = basis(x), 1 if increasing else -1
    d = np.diff(np.eye(k), n=m, axis=0) if k > m else np.zeros((1, k))
    a = (b * w[:, None]).T @ b / w.sum()
    a[1:, 1:] += penalty * d.T @ d / max(1, len(d))
    rhs = (b * w[:, None]).T @ (sign * y) / w.sum()
    rate, coef = 1 / np.linalg.eigvalsh(a).max(), np.zeros(k + 1)
    coef[0] = (sign * y @ w) / w.sum()
    prev, t0 = coef.copy(), 1.0
    for _ in range(4000):
        t1 = (1 + math.sqrt(1 + 4 * t0 * t0)) / 2
        z = coef + (t0 - 1) / t1 * (coef - prev)
        new = z - rate * (a @ z - rhs)
        new[1:] = np.maximum(new[1:], 0)
        prev, coef, t0 = coef, new, t1
        if np.abs(coef - prev).max() < 1e-10:
            break
    return grid, sign * (basis(grid) @ coef)


def error_model(rows: DataFrame, variable: str, ties: list[str], *, metric: str = "rmse", window: int = 5, calibration: str = "spline", maximise: bool | None = None, threshold: float | None = None, k: int = 6, m: int = 2) -> ErrorModel:
    """Fits the windows' metric against DI, LPD or geodist. Error grows with DI and distance and falls with LPD; for a metric that is
    maximised the other way round."""
    if calibration not in ("lm", "exp", "isotonic", "spline"):
        raise DomainError(f"calibration {calibration!r}: lm, exp, isotonic or spline")
    if calibration == "exp" and variable != "lpd":
        raise DomainError("exp is for the local point density")
    maximise = metric in ("rsquared", "accuracy", "kappa") if maximise is None else maximise
    points = (moving_kappa(rows, variable, window, ties) if metric == "kappa" else moving_error(rows, variable, window, ties, metric=metric)).persist()
    if calibration in ("lm", "exp"):
        v = F.log(F.col(variable).cast("double")) if calibration == "exp" else F.col(variable).cast("double")
        r = points.agg(F.regr_intercept(metric, v), F.regr_slope(metric, v)).first()
        return ErrorModel(points, variable, metric, calibration, ((r[0], r[1]),), threshold)
    # the curve is fitted on at most 2,000 cells of the variable, each its mean with its number of windows
    low, high = points.agg(F.min(variable), F.max(variable)).first()
    if low is None:
        return ErrorModel(points, variable, metric, calibration, (), threshold)
    cell = F.floor((F.col(variable) - F.lit(low)) / F.lit((high - low) / 2000 or 1.0))
    table = points.where(F.col(metric).isNotNull()).groupBy(cell.alias("cell")).agg(F.avg(variable).alias("v"), F.avg(metric).alias("y"), F.count("*").alias("w")).orderBy("v").toPandas()
    x, y, w = table["v"].to_numpy(float), table["y"].to_numpy(float), table["w"].to_numpy(float)
    increasing = (variable != "lpd") != maximise
    if calibration == "isotonic" or len(x) < 4:
        fx, fy = x, pool_adjacent(y, w, increasing)
    else:
        fx, fy = monotone_spline(x, y, w, increasing, k, m)
    keep = np.r_[True, np.diff(fy) != 0] | np.r_[np.diff(fy) != 0, True]
    keep[[0, -1]] = True
    return ErrorModel(points, variable, metric, calibration, tuple(zip(fx[keep].tolist(), fy[keep].tolist(), strict=True)), threshold)


def inside(rows: DataFrame, variable: str, threshold: float | None) -> DataFrame:
    """The predictions that an error profile uses: DI at most the threshold, LPD over 0; others all."""
    if variable == "di":
        return rows.where(F.col("di") <= F.lit(threshold))
    return rows.where(F.col("lpd") > 0) if variable == "lpd" else rows
