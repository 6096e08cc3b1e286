"""Cross-validation folds as a table: fold, row_id, role (train, test or exclude)."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domainscope.errors import DomainError, DomainWarning
from domainscope.functions.scaling import is_categorical
from domainscope.plans.ordered import hash_rank


@dataclass(frozen=True)
class Folds:
    """assigned: row_id and the fold that tests it (null: none does), one row for each row. table: the long form, made when asked for."""

    assigned: DataFrame
    k: int
    both: bool = False

    @property
    def table(self) -> DataFrame:
        """fold, row_id, role; k rows for each row."""
        folds = F.explode(F.sequence(F.lit(1), F.lit(self.k))).alias("fold")
        if self.both:
            inside = (F.col("space_fold") == F.col("fold")).cast("int") + (F.col("time_fold") == F.col("fold")).cast("int")
            role = F.when(inside == 2, "test").when(inside == 0, "train").otherwise("exclude")
        else:
            role = F.when(F.col("fold") == F.col("test_fold"), "test").otherwise("train")
        return self.assigned.select("*", folds).select("fold", "row_id", role.alias("role"))

    def lists(self) -> DataFrame:
        """fold, train, test: sorted row ids as arrays; for tables that fit."""
        ids = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.col("row_id")))).alias(role)
        return self.table.groupBy("fold").agg(ids("train"), ids("test"))


def dealt(units: DataFrame, unit: str, k: int, seed: int, name: str) -> DataFrame:
    """units with a fold from 1 to k, near-equal in size, in the order of md5(seed:unit)."""
    return hash_rank(units, unit, seed, "__rank").withColumn(name, ((F.col("__rank") - 1) % k + 1).cast("int")).drop("__rank")


def stratified(units: DataFrame, unit: str, by: str, k: int, seed: int, name: str) -> DataFrame:
    """The same within each class, so that every fold has its share of it."""
    order = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")).cast("binary")), unit)
    return units.withColumn(name, ((F.row_number().over(order) - 1) % k + 1).cast("int"))


def spacetime_folds(x: DataFrame, row_id: str, space: str | None = None, time: str | None = None, k: int = 10, by_class: str | None = None, seed: int = 1) -> Folds:
    """Leave-location-out, leave-time-out, or both.

    With one of space and time, a fold tests the rows of its units and trains on all others. With both, it tests rows in its places *and*
    its times, and trains on rows in neither; rows in one of the two are left out. by_class: units are dealt within the classes of this
    categorical column, and the folds found so are the space units. k is lowered to the number of units. A null unit is a unit."""
    if space is None and time is None:
        raise DomainError("neither a space nor a time variable")
    if by_class is not None:
        if space is None:
            raise DomainError("by_class needs a space variable")
        if not is_categorical(x, by_class):
            raise DomainError("by_class must be categorical")
    base = x.select(F.col(row_id).alias("row_id"), *([F.col(space).cast("string").alias("s")] if space else []), *([F.col(time).cast("string").alias("t")] if time else []), *([F.col(by_class).cast("string").alias("c")] if by_class else []))
    if by_class is not None:
        units = stratified(base.select("s", "c").distinct().withColumn("u", F.concat_ws("|", "s", "c")), "u", "c", k, seed, "f")
        base = base.join(units.select("s", "c", "f"), base["s"].eqNullSafe(units["s"]) & base["c"].eqNullSafe(units["c"])).select(base["row_id"], F.col("f").cast("string").alias("s"), *([base["t"]] if time else []))
    columns, most = [], k
    units = {}
    for c in (["s"] if space else []) + (["t"] if time else []):
        units[c] = base.select(c).distinct()
        n = units[c].count()
        if n < most:
            warnings.warn(f"k is {n}, as {space if c == 's' else time} has no more units", DomainWarning, stacklevel=2)
            most = n
    out = base
    for c, name in (("s", "space_fold"), ("t", "time_fold")):
        if c in units:
            placed = dealt(units[c], c, most, seed, name).withColumnRenamed(c, f"__{c}")
            out = out.join(placed, out[c].eqNullSafe(placed[f"__{c}"]), "left").drop(f"__{c}")
            columns.append(name)
    test = F.when(F.col("space_fold") == F.col("time_fold"), F.col("space_fold")) if len(columns) == 2 else F.col(columns[0])
    return Folds(out.select("row_id", test.alias("test_fold"), *(columns if len(columns) == 2 else [])), most, len(columns) == 2)


def random_folds(x: DataFrame, row_id: str, k: int, seed: int = 1) -> Folds:
    """Balanced random folds."""
    placed = dealt(x.select(F.col(row_id).alias("row_id")), "row_id", k, seed, "test_fold")
    return Folds(placed, k)


def folds_of_column(x: DataFrame, row_id: str, fold: str) -> Folds:
    """Folds given as a column of fold numbers from 1; null: tested by none."""
    assigned = x.select(F.col(row_id).alias("row_id"), F.col(fold).cast("int").alias("test_fold"))
    return Folds(assigned, assigned.agg(F.max("test_fold")).first()[0] or 0)


def fold_sizes(folds: Folds) -> DataFrame:
    """test_fold, n, share of all rows; null: rows that no fold tests."""
    counts = folds.assigned.groupBy("test_fold").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("test_fold", "n", (F.col("n") / F.col("total")).alias("share"))


@dataclass(frozen=True)
class FoldLists:
    """Explicit folds: for each fold the ids that it tests and those that it trains on. For training tables of bounded size."""

    test: dict[int, list[int]]
    train: dict[int, list[int]]

    @classmethod
    def of(cls, ids: list[int], test: dict[int, list[int]] | None, train: dict[int, list[int]] | None) -> FoldLists:
        """One given, the other is its complement within all ids."""
        if test is None and train is None:
            raise DomainError("neither test nor training rows")
        rest = lambda given: {f: sorted(set(ids) - set(v)) for f, v in given.items()}
        return cls(test if test is not None else rest(train), train if train is not None else rest(test))

    def fold_of(self) -> dict[int, int]:
        """The fold that tests a row; an error if two do."""
        found: dict[int, int] = {}
        for f, ids in self.test.items():
            for i in ids:
                if found.setdefault(i, f) != f:
                    raise DomainError(f"row {i} is tested in more than one fold")
        return found

    def allowed(self) -> dict[int, np.ndarray]:
        return {f: np.array(sorted(v), np.int64) for f, v in self.train.items()}

    def table(self, spark) -> DataFrame:
        rows = [(f, i, role) for role, given in (("test", self.test), ("train", self.train)) for f, ids in given.items() for i in ids]
        return spark.createDataFrame(rows, "fold int, row_id long, role string")
