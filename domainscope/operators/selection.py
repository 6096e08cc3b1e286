"""Choosing predictors by cross-validated performance: forward (ffs) and over all subsets (bss).

An evaluator maps a subset to its performance; see operators.learners. Subsets of one round are independent and run in a pool of driver threads,
whose Spark jobs share the cluster; the linear evaluator needs no jobs at all after its one aggregation.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession

from domainscope.errors import DomainError, DomainWarning
from domainscope.operators.learners import Performance

Evaluator = Callable[[tuple[str, ...]], Performance]


@dataclass(frozen=True)
class Tried:
    variables: tuple[str, ...]
    performance: Performance


@dataclass(frozen=True)
class Selection:
    """selected: in the order chosen. tried: all subsets in the order tried. path: the best of each size up to the selected one."""

    selected: tuple[str, ...]
    performance: Performance
    tried: list[Tried]
    path: list[Tried]
    predictors: list[str]
    metric: str
    min_var: int

    def perf_all(self, spark: SparkSession) -> DataFrame:
        """run, var1.., the metric, se, nvar."""
        p = max(len(t.variables) for t in self.tried)
        rows = [(i + 1, *t.variables, *[None] * (p - len(t.variables)), t.performance.value, t.performance.se, len(t.variables)) for i, t in enumerate(self.tried)]
        return spark.createDataFrame(rows, "run long, " + ", ".join(f"var{i + 1} string" for i in range(p)) + f", {self.metric} double, se double, nvar long")

    def best_per_size(self, spark: SparkSession) -> DataFrame:
        """nvar, the metric, variables: the best of each size, ties kept."""
        better = max if self.maximised else min
        rows = []
        for size in sorted({len(t.variables) for t in self.tried}):
            some = [t for t in self.tried if len(t.variables) == size and not math.isnan(t.performance.value)]
            if some:
                top = better(t.performance.value for t in some)
                rows += [(size, top, ", ".join(t.variables)) for t in some if t.performance.value == top]
        return spark.createDataFrame(rows, f"nvar long, {self.metric} double, variables string")

    @property
    def maximised(self) -> bool:
        from domainscope.operators.learners import MAXIMISED

        return MAXIMISED[self.metric]

    def summary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(", ".join(self.selected), float(self.performance.value), self.performance.se, len(self.tried))], f"selected string, {self.metric} double, se double, models long")

    def plot_data(self, spark: SparkSession) -> DataFrame:
        """step, label (the variables up to it), the metric, se along the path."""
        rows = [(i + 1, " + ".join(t.variables), t.performance.value, t.performance.se) for i, t in enumerate(self.path)]
        return spark.createDataFrame(rows, f"step long, label string, {self.metric} double, se double")


def budget(n: int, min_var: int = 2) -> int:
    """The most models that forward selection fits."""
    return math.comb(n, min_var) + (n - min_var) * (n - min_var + 1) // 2


def _run(subsets: list[tuple[str, ...]], evaluate: Evaluator, threads: int) -> list[Tried]:
    if threads == 1:
        return [Tried(s, evaluate(s)) for s in subsets]
    with ThreadPoolExecutor(threads) as pool:
        return [Tried(s, p) for s, p in zip(subsets, pool.map(evaluate, subsets), strict=True)]


def _best(tried: list[Tried], maximise: bool) -> Tried:
    """The first of the best; figures that are no number are the worst."""
    sign = 1 if maximise else -1
    found = [t for t in tried if not math.isnan(t.performance.value)]
    if not found:
        raise DomainError("no subset could be judged")
    return max(found, key=lambda t: sign * t.performance.value)


def forward(predictors: list[str], evaluate: Evaluator, metric: str, maximise: bool, *, min_var: int = 2, within_se: bool = False, early_stopping: bool = True, threads: int = 4) -> Selection:
    """Forward selection from the best subset of min_var predictors.

    A predictor joins if the round's best is better than what has been selected, with within_se by more than the standard error of that. With
    early_stopping the first round that adds none ends the search; without, it goes on from the best of each size until all predictors are in, and the best of
    all sizes is selected."""
    if not 1 <= min_var <= len(predictors):
        raise DomainError("min_var is over the number of predictors")
    sign = 1 if maximise else -1
    tried = _run(list(combinations(predictors, min_var)), evaluate, threads)
    best = here = _best(tried, maximise)
    path = [best]
    if within_se and best.performance.se is None:
        warnings.warn("there is no standard error: within_se is off", DomainWarning, stacklevel=2)
        within_se = False
    while len(here.variables) < len(predictors):
        rest = [v for v in predictors if v not in here.variables]
        now = _run([(*here.variables, v) for v in rest], evaluate, threads)
        tried += now
        top = _best(now, maximise)
        bar = best.performance.value + sign * ((best.performance.se or 0.0) if within_se else 0.0)
        better = sign * top.performance.value > sign * bar
        if better:
            best = top
        elif early_stopping:
            break
        here = top
        path.append(top)
    path = [t for t in path if len(t.variables) <= len(best.variables)]
    return Selection(best.variables, best.performance, tried, path, predictors, metric, min_var)


def all_subsets(predictors: list[str], evaluate: Evaluator, metric: str, maximise: bool, *, threads: int = 4, most: int = 1 << 20) -> Selection:
    """The best of all subsets of two predictors or more: 2^n - (n + 1) models; the first of equals."""
    n = len(predictors)
    if 2**n - (n + 1) > most:
        raise DomainError(f"{2**n - (n + 1)} models; at most {most} are tried")
    subsets = [s for size in range(2, n + 1) for s in combinations(predictors, size)]
    if not subsets:
        raise DomainError("at least two predictors are needed")
    tried = _run(subsets, evaluate, threads)
    best = _best(tried, maximise)
    path = [_best([t for t in tried if len(t.variables) == size], maximise) for size in range(2, len(best.variables) + 1)]
    return Selection(best.variables, best.performance, tried, path, predictors, metric, 2)
