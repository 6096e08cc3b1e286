"""Z-scores and dummy variables learned from training rows, and applied as Column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainscope.errors import DomainError


def number(column: str | Column) -> Column:
    """As double, NaN read as null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nanvl(c.cast("double"), F.lit(None))


@dataclass(frozen=True)
class Scaler:
    """Means and sample standard deviations of columns."""

    mean: dict[str, float]
    sd: dict[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Scaler:
        if not columns:
            return cls({}, {})
        r = df.agg(*(f(number(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
        return cls({c: r[f"m{i}"] for i, c in enumerate(columns)}, {c: r[f"s{i}"] for i, c in enumerate(columns)})

    def check(self) -> None:
        flat = [c for c, s in self.sd.items() if s is None or not s or math.isnan(s)]
        if flat:
            raise DomainError(f"no variance in {', '.join(flat)}")

    def of(self, column: str, value: Column | None = None) -> Column:
        return ((number(column) if value is None else value) - F.lit(self.mean[column])) / F.lit(self.sd[column])

    def apply(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return df.withColumns({c: self.of(c) for c in (self.mean if columns is None else columns)})

    def table(self, df: DataFrame) -> DataFrame:
        """variable, mean, sd as rows."""
        return df.sparkSession.createDataFrame([(c, self.mean[c], self.sd[c]) for c in self.mean], "variable string, mean double, sd double")


@dataclass(frozen=True)
class Dummies:
    """The levels of categorical columns; a level is one 0/1 column, an unseen level is 0 in all, a missing one null."""

    levels: dict[str, tuple[str, ...]]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], most: int = 10_000) -> Dummies:
        found = {}
        for c in columns:
            rows = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(most + 1).collect()
            if len(rows) > most:
                raise DomainError(f"{c} has over {most} levels")
            found[c] = tuple(r["v"] for r in rows)
        return cls(found)

    def columns(self) -> dict[str, Column]:
        """Name of the dummy variable: its 0/1 expression."""
        return {f"{c}_{v}": F.when(F.col(c).isNotNull(), (F.col(c).cast("string") == v).cast("double")) for c, levels in self.levels.items() for v in levels}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns()).drop(*self.levels)


def is_categorical(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("string", "char", "varchar", "boolean")
