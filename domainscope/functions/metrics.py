"""Distances between rows, as numpy kernels over blocks and as Column expressions for single pairs."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from domainscope.errors import DomainError

#: Metres; the sphere of the great-circle metric.
EARTH_RADIUS = 6_371_010.0
METRICS = ("euclidean", "mahalanobis", "gower", "great_circle", "abs_time")


class Rows(NamedTuple):
    """A block of rows: numeric (n, d) float64 with NaN for missing, categories (n, c) int64 hashes."""

    numeric: np.ndarray
    categories: np.ndarray

    def __len__(self) -> int:
        return len(self.numeric)

    def slice(self, a: int, b: int) -> Rows:
        return Rows(self.numeric[a:b], self.categories[a:b])


class Metric(NamedTuple):
    """A distance with what it has learned: ranges for Gower (0: the column is constant), a whitening matrix for Mahalanobis."""

    name: str
    ranges: tuple[float, ...] = ()
    whiten: tuple[tuple[float, ...], ...] = ()

    def prepared(self, rows: Rows) -> Rows:
        """rows in the space in which ``distances`` works, computed once a block."""
        if self.name == "mahalanobis":
            return Rows(rows.numeric @ np.array(self.whiten), rows.categories)
        if self.name == "great_circle":
            return Rows(np.radians(rows.numeric), rows.categories)
        return rows

    def distances(self, a: Rows, b: Rows) -> np.ndarray:
        """(len(a), len(b)) distances of prepared rows, by direct differences, so that equal rows are at exactly 0."""
        return self.between(a.numeric[:, None], a.categories[:, None], b.numeric[None], b.categories[None])

    def between(self, an: np.ndarray, ac: np.ndarray, bn: np.ndarray, bc: np.ndarray) -> np.ndarray:
        """The same of any two arrays of prepared rows that go together but for their last axis, the features."""
        if self.name == "great_circle":
            lon, lat = an[..., 0] - bn[..., 0], an[..., 1] - bn[..., 1]
            h = np.sin(lat / 2) ** 2 + np.cos(an[..., 1]) * np.cos(bn[..., 1]) * np.sin(lon / 2) ** 2
            return 2 * EARTH_RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
        out = np.zeros(np.broadcast_shapes(an.shape[:-1], bn.shape[:-1]))
        if self.name == "gower":
            for j, r in enumerate(self.ranges):
                if r > 0:
                    out += np.abs(an[..., j] - bn[..., j]) / r
            for j in range(ac.shape[-1]):
                out += ac[..., j] != bc[..., j]
            return out / max(1, len(self.ranges) + ac.shape[-1])
        for j in range(an.shape[-1]):
            out += np.square(an[..., j] - bn[..., j])
        return np.sqrt(out)

    # -- boxes: rows in a space where no two are farther apart than by the metric, and how far a box is there

    def levels(self, rows: Rows) -> list[np.ndarray]:
        """The categories that ``embedded`` knows."""
        return [np.unique(c) for c in rows.categories.T] if self.name == "gower" else []

    def embedded(self, rows: Rows, levels: list[np.ndarray]) -> np.ndarray:
        """Prepared rows as points; categories are indicators of a half, so that two of them are 1 apart, and unknown ones a half."""
        if self.name == "great_circle":
            lon, lat = rows.numeric[:, 0], rows.numeric[:, 1]
            return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
        if self.name != "gower":
            return rows.numeric
        parts = [rows.numeric[:, j] / r for j, r in enumerate(self.ranges) if r > 0] + [(c == v) * 0.5 for c, known in zip(rows.categories.T, levels, strict=True) for v in known]
        return np.stack(parts or [np.zeros(len(rows))], axis=1) / max(1, len(self.ranges) + rows.categories.shape[1])

    def box(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The distance of points to a box each."""
        out = np.zeros(len(at))
        for j in range(at.shape[1]):
            gap = np.maximum(np.maximum(low[:, j] - at[:, j], at[:, j] - high[:, j]), 0)
            out += gap if self.name == "gower" else np.square(gap)
        return out if self.name == "gower" else np.sqrt(out)

    def reach(self, d: np.ndarray) -> np.ndarray:
        """The farthest that rows at a distance d may be apart as points, beside rounding."""
        if self.name == "great_circle":
            return 2 * np.sin(np.minimum(d / (2 * EARTH_RADIUS), np.pi / 2)) * (1 + 1e-9) + 1e-12
        return d * (1 + 1e-9) + 1e-12 if self.name == "gower" else d * (1 + 1e-12)


def whitening(covariance: np.ndarray) -> tuple[tuple[float, ...], ...]:
    """The square root of the pseudo-inverse: L2 after it is the Mahalanobis distance. Directions without variance are left out."""
    values, vectors = np.linalg.eigh(np.atleast_2d(covariance))
    keep = values > max(values.max(), 0.0) * np.sqrt(np.finfo(float).eps)
    root = vectors[:, keep] / np.sqrt(values[keep]) @ vectors[:, keep].T
    return tuple(map(tuple, root.tolist()))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a, b, c, d = map(F.radians, (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((d - b) / 2), 2) + F.cos(b) * F.cos(d) * F.pow(F.sin((c - a) / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


#: Seconds of a time unit.
TIME_UNITS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86_400, "weeks": 604_800}


def time_value(column: Column, unit: str) -> Column:
    """A DATE or TIMESTAMP as a number of units since the epoch."""
    if unit not in TIME_UNITS:
        raise DomainError(f"time unit {unit!r}: one of {', '.join(TIME_UNITS)}")
    return F.unix_micros(column.cast("timestamp")).cast("double") / (1e6 * TIME_UNITS[unit])


def check(space: str, metric: str, categorical: bool, lonlat: bool) -> None:
    """Which metrics go with which space."""
    if metric not in METRICS:
        raise DomainError(f"metric {metric!r}: one of {', '.join(METRICS)}")
    if space == "feature" and metric in ("great_circle", "abs_time"):
        raise DomainError(f"{metric} is no distance between features")
    if space == "geographical" and metric not in ("euclidean", "great_circle"):
        raise DomainError(f"{metric} is no distance between places")
    if categorical and metric != "gower":
        raise DomainError("categorical variables need the gower metric")
    if space == "geographical" and lonlat and metric != "great_circle":
        raise DomainError("longitudes and latitudes need the great_circle metric")
