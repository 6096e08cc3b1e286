"""Nearest-neighbour joins: each query row against a set of reference rows, without any shuffle of the queries where that can be.

The reference side of these operators is a training sample. Its different rows, each with the number of rows that are alike, travel with the tasks if they are
at most ``rows_that_travel``, and the queries stream past them: a map-only stage that keeps all columns of the queries. Each block of queries goes down
a k-d tree (``plans.tree``), or meets all references where they have too many dimensions for one (``Flat``). Beyond that size the references are cut
into blocks, the queries (a packed block at a time) meet each reference block in an equi-join on its number, and partial
results are combined by query. Either way distances are computed a block at a time and never become rows. Sums of distances to all others are of all pairs by
their nature: they are those of pairs of different rows, dealt over all cores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainscope.functions.metrics import Metric, Rows
from domainscope.plans.tree import LEAF, TREE_DIMENSIONS, Tree

#: What references that travel may take of memory, SMALL_BYTES: inputs that are dealt over all cores first.
REFERENCE_BYTES, SMALL_BYTES = 96 << 20, 32 << 20
#: Neighbours whose distances agree to so many decimals are ties, and go to the smaller id.
TIES = 9
_CELLS = 1 << 20
_NONE = np.iinfo(np.int64).min


def rows_that_travel(numbers: int, kinds: int = 0) -> int:
    """How many different references fit REFERENCE_BYTES."""
    return REFERENCE_BYTES // (24 + 8 * (numbers + kinds) * (2 if numbers <= TREE_DIMENSIONS else 1))


class Shape(NamedTuple):
    """How many numbers and categories a row is compared by; goes to the tasks, where Columns can't."""

    numbers: int
    kinds: int

    @property
    def names(self) -> list[str]:
        return [*(f"f{i}" for i in range(self.numbers)), *(f"c{i}" for i in range(self.kinds))]

    def rows(self, table: pa.Table | pa.RecordBatch) -> tuple[Rows, np.ndarray]:
        """The features of a table that has ``Features.columns``, and which rows miss none."""
        whole = np.ones(table.num_rows, bool)

        def column(name: str) -> pa.Array:
            c = table.column(table.schema.get_field_index(name))
            return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c

        numeric, categories = np.empty((table.num_rows, self.numbers)), np.empty((table.num_rows, self.kinds), np.int64)
        for i in range(self.numbers):
            numeric[:, i] = column(f"__nf{i}").to_numpy(zero_copy_only=False)
            whole &= ~np.isnan(numeric[:, i])
        for i in range(self.kinds):
            c = column(f"__nc{i}")
            whole &= c.is_valid().to_numpy(zero_copy_only=False)
            categories[:, i] = c.fill_null(0).to_numpy(zero_copy_only=False)
        return Rows(numeric, categories), whole


@dataclass(frozen=True)
class Features:
    """What a row is compared by: Columns of numbers, and of categories."""

    numeric: list[Column]
    categories: list[Column] = field(default_factory=list)

    @property
    def shape(self) -> Shape:
        return Shape(len(self.numeric), len(self.categories))

    def columns(self, prefix: str = "__n") -> list[Column]:
        """The features under fixed names: numbers as double, categories as a hash, null where missing."""
        return [
            *(F.nanvl(c.cast("double"), F.lit(None)).alias(f"{prefix}f{i}") for i, c in enumerate(self.numeric)),
            *(F.when(c.isNotNull(), F.xxhash64(c.cast("string"))).alias(f"{prefix}c{i}") for i, c in enumerate(self.categories)),
        ]


@dataclass(frozen=True)
class References:
    """Reference rows in memory. Rows that miss a feature are left out. ids, folds: int64; groups: the group that a row is held out in, see ``rule``."""

    ids: np.ndarray
    folds: np.ndarray
    rows: Rows

    @classmethod
    def collect(cls, df: DataFrame, features: Features, row_id: str, fold: str | None = None) -> References:
        table = df.select(F.col(row_id).cast("long").alias("__id"), (F.col(fold).cast("long") if fold else F.lit(None).cast("long")).alias("__fold"), *features.columns()).orderBy("__id").toArrow()
        rows, whole = features.shape.rows(table)
        folds = table.column("__fold").fill_null(np.iinfo(np.int64).min).to_numpy()
        return cls(table.column("__id").to_numpy()[whole], folds[whole], Rows(rows.numeric[whole], rows.categories[whole]))


def partial(metric: Metric, queries: Rows, refs: Rows, banned, k: int, threshold: float | None, cells: int = _CELLS) -> Iterator[tuple[np.ndarray, ...]]:
    """For chunks of prepared queries: least distance (inf: none), sum and count of distances, count under the threshold, and k nearest (distances, places).

    banned(a, b): which references the queries a to b can't use, or None. Ties go to the earlier reference."""
    step = max(1, cells // max(1, len(refs)))
    for a in range(0, len(queries), step):
        d = metric.distances(queries.slice(a, a + step), refs)
        if (no := banned(a, min(a + step, len(queries)))) is not None:
            d[no] = np.inf
        n = d.shape[1]
        finite = np.isfinite(d)
        least = d.min(axis=1) if n else np.full(len(d), np.inf)
        total = np.where(finite, d, 0).sum(axis=1)
        under = (d < threshold).sum(axis=1) if threshold is not None else np.zeros(len(d), np.int64)
        if k:
            top = _smallest(np.round(d, TIES), min(k, n))
            near = np.take_along_axis(d, top, axis=1)
        else:
            top, near = np.empty((len(d), 0), np.int64), np.empty((len(d), 0))
        yield least, total, finite.sum(axis=1), under, near, top


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """The places of the k smallest of each row, in order; of equals the earlier."""
    if k >= d.shape[1]:
        return np.argsort(d, axis=1, kind="stable")
    limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
    out = np.empty((len(d), k), np.int64)
    for i, row in enumerate(d):
        places = np.flatnonzero(row <= limit[i, 0])
        out[i] = places[np.argsort(row[places], kind="stable")][:k]
    return out


#: Which references a query row may use.
#: all; other: all but the row of the same id; out_of_fold: those with another fold (not null); apart: those that ``train`` allows for the query's fold.
RULES = ("all", "other", "out_of_fold", "apart")


def _banned(rule: str, q_ids: np.ndarray, q_folds: np.ndarray, refs: References, apart: dict[int, np.ndarray] | None):
    if rule == "all":
        return lambda a, b: None
    if rule == "other":
        return lambda a, b: q_ids[a:b, None] == refs.ids[None, :]
    if rule == "out_of_fold":
        return lambda a, b: (q_folds[a:b, None] == refs.folds[None, :]) | (q_ids[a:b, None] == refs.ids[None, :])
    none = np.ones(len(refs.ids), bool)
    masks = {f: ~np.isin(refs.ids, ids) for f, ids in (apart or {}).items()}
    return lambda a, b: np.stack([masks.get(f, none) for f in q_folds[a:b].tolist()]) | (q_ids[a:b, None] == refs.ids[None, :])


_RESULT = [("nn_dist", "double"), ("sum_dist", "double"), ("n_dist", "long"), ("n_under", "long"), ("nn_dists", "array<double>"), ("nn_ids", "array<long>")]
#: More neighbours than this are found by comparison with all references.
_MOST_NEAR = 64


def alike(rows: Rows, *also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each different row (in features and what is given beside), and for each row the number of its kind."""
    columns = [c + 0 for c in (*rows.numeric.T, *rows.categories.T, *also)]
    order = np.lexsort([np.arange(len(rows)), *columns])
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in columns], axis=0) if columns else False
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


@dataclass(frozen=True)
class Points:
    """The different references, prepared: how many rows each stands for, the fold that they are in, and, flat, the smallest ids of each."""

    rows: Rows
    counts: np.ndarray
    folds: np.ndarray | None = None
    ids: np.ndarray | None = None
    first: np.ndarray | None = None

    @classmethod
    def of(cls, rows: Rows, counts: np.ndarray, folds: np.ndarray | None, ids: np.ndarray | None, metric: Metric, k: int) -> Points:
        """rows: not prepared, alike ones several times; ids: of each row, where k of them are wanted."""
        at, kind = alike(rows, *([] if folds is None else [folds]))
        first = chosen = None
        if ids is not None:
            order = np.lexsort([ids, kind])
            start = np.searchsorted(kind[order], np.arange(len(at)))
            near = np.arange(len(order)) - start[kind[order]] < k
            chosen = ids[order][near]
            first = np.concatenate([[0], np.cumsum(np.bincount(kind[order][near], minlength=len(at)))])
        totals = np.bincount(kind, weights=counts, minlength=len(at)).astype(np.int64)
        return cls(metric.prepared(Rows(rows.numeric[at], rows.categories[at])), totals, None if folds is None else folds[at], chosen, first)

    @classmethod
    def gather(cls, df: DataFrame, features: Features, metric: Metric, row_id: str, fold: str | None, k: int, n: int, limit: int) -> Points | None:
        """Of n rows; None: more than limit of them are different. Rows that miss a feature are left out."""
        names = [f"__n{c}" for c in features.shape.names]
        keyed = df.select(F.col(row_id).cast("long").alias("__id"), *([F.coalesce(F.col(fold).cast("long"), F.lit(_NONE)).alias("__fold")] if fold else []), *features.columns()).dropna(subset=names)
        by = [*names, *(["__fold"] if fold else [])]
        if n <= limit:
            table = keyed.withColumn("__w", F.lit(1).cast("long")).toArrow()
        else:
            alike = keyed.groupBy(*by).agg(F.count("*").alias("__w"))
            if features.shape.numbers > TREE_DIMENSIONS or alike.count() > limit:
                return None
            table = alike.toArrow()
        column = lambda t, c: t.column(c).to_numpy()
        own = lambda t: features.shape.rows(t)[0]
        folds = column(table, "__fold") if fold else None
        if not k or n <= limit:
            return cls.of(own(table), column(table, "__w"), folds, column(table, "__id") if k else None, metric, k)
        least = keyed.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy("__id"))).where(F.col("__place") <= k).drop("__place").toArrow()
        every = cls.of(own(table), column(table, "__w"), folds, None, metric, 0)
        named = cls.of(own(least), np.ones(least.num_rows, np.int64), column(least, "__fold") if fold else None, column(least, "__id"), metric, k)
        return cls(every.rows, every.counts, every.folds, named.ids, named.first)

    def search(self, metric: Metric, k: int = 0) -> Tree | Flat | None:
        """None: there are no references."""
        if not len(self.rows):
            return None
        dimensions = metric.embedded(self.rows.slice(0, 1), metric.levels(self.rows)).shape[1]
        return Tree(self.rows, metric, self.folds, max(LEAF, k)) if dimensions <= TREE_DIMENSIONS else Flat(self.rows, metric, self.folds)


class Flat:
    """What ``Tree`` does by comparison with all references. Squared Euclidean distances are first those of a product of matrices, whose rounding is
    allowed for; what may be near enough is then compared by the metric itself."""

    def __init__(self, rows: Rows, metric: Metric, labels: np.ndarray | None = None):
        self.rows, self.metric, self.labels = rows, metric, labels
        self.centre = rows.numeric.mean(axis=0)
        at = rows.numeric - self.centre
        norm = np.square(at).sum(axis=1)
        self.top = norm.max()
        self.kind = np.float32 if 1e-12 < self.top < 1e24 else np.float64
        self.at, self.norm = at.astype(self.kind), norm.astype(self.kind)

    def _squares(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances, and how far each query's may be from the true ones."""
        if self.metric.name not in ("euclidean", "mahalanobis"):
            return np.square(self.metric.distances(rows, self.rows)), np.zeros(len(rows))
        q = rows.numeric - self.centre
        norm = np.square(q).sum(axis=1)
        large = self.kind is np.float32 and norm.max(initial=0.0) > 1e24
        kind = np.float64 if large else self.kind
        out = q.astype(kind) @ (-2 * self.at.T.astype(kind, copy=False))
        out += self.norm.astype(kind, copy=False)
        out += norm.astype(kind)[:, None]
        return out, 8 * (q.shape[1] + 8) * float(np.finfo(self.kind).eps) * (norm + self.top)

    def _pairs(self, rows: Rows, mine: np.ndarray | None, limit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """limit(a, b, squares, errors): up to which squared distance the pairs of queries a to b count."""
        step = max(1, _CELLS // len(self.rows))
        for a in range(0, len(rows), step):
            b = min(a + step, len(rows))
            squares, errors = self._squares(rows.slice(a, b))
            if mine is not None:
                squares[mine[a:b, None] == self.labels[None, :]] = np.inf
            i, j = np.nonzero((squares <= limit(a, b, squares, errors)[:, None]) & (squares < np.inf))
            for c in range(0, len(i), 1 << 14):
                x, y = i[c : c + (1 << 14)] + a, j[c : c + (1 << 14)]
                yield x, y, self.metric.between(rows.numeric[x], rows.categories[x], self.rows.numeric[y], self.rows.categories[y])

    def within(self, rows: Rows, bound: np.ndarray, mine: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for q, r, d in self._pairs(rows, mine, lambda a, b, squares, errors: np.where(bound[a:b] >= 0, np.square(bound[a:b]) * (1 + 1e-6) + errors, -np.inf)):
            some = d <= bound[q]
            yield q[some], r[some], d[some]

    def nearest(self, rows: Rows, k: int = 1, mine: np.ndarray | None = None, beyond: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = min(k, len(self.rows))

        def limit(a: int, b: int, squares: np.ndarray, errors: np.ndarray) -> np.ndarray:
            kth = squares.min(axis=1) if k == 1 else np.partition(squares, k - 1, axis=1)[:, k - 1]
            return np.square(np.sqrt(np.maximum(kth.astype(float) + errors, 0)) + beyond) * (1 + 1e-6) + errors

        q, r, d = (np.concatenate(x) for x in zip((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), *self._pairs(rows, mine, limit), strict=True))
        by = np.lexsort((d, q))
        q, r, d = q[by], r[by], d[by]
        start = np.searchsorted(q, np.arange(len(rows)))
        last = np.minimum(start + k - 1, np.searchsorted(q, np.arange(len(rows)), "right") - 1)
        near = d <= d[last[q]] + beyond
        return q[near], r[near], d[near]

    least = Tree.least


def nearest(
    queries: DataFrame, references: DataFrame, features: Features, metric: Metric, row_id: str, *, rule: str = "all", fold: str | None = None, apart: dict[int, np.ndarray] | None = None,
    k: int = 0, threshold: float | None = None, reference_features: Features | None = None, reference_id: str | None = None, limit: int | None = None,
    keep: list[str] | None = None, sums: bool = True,
) -> DataFrame:
    """queries (of their columns those in keep, None: all; the others are never read) with nn_dist (null: no reference allowed, or a feature is missing), sum_dist, n_dist, n_under, nn_dists, nn_ids.

    apart: for each fold the ids of the references that its test rows may use. sums: without them sum_dist is null. limit: of different references that travel.
    By out_of_fold a query that is a reference, too, has its fold there."""
    own, ref_id = reference_features or features, reference_id or row_id
    limit = limit or rows_that_travel(*own.shape)
    n = references.count()
    same = queries is references and own is features and ref_id == row_id
    if k <= (_MOST_NEAR if rule == "all" else 0) and (not sums or same and rule == "other") and (rule in ("all", "out_of_fold") or same and rule == "other"):
        points = Points.gather(references, own, metric, ref_id, fold if rule == "out_of_fold" else None, k, n, limit)
        if points is not None:
            totals = point_sums(queries.sparkSession, points, metric) if sums else None
            return _searched(queries, features, metric, row_id, fold, points, rule, k, threshold, keep, totals)
    if n > limit:
        return _blocked(queries, references, features, own, metric, row_id, ref_id, rule, fold, apart, k, threshold, n, limit, keep, sums)
    refs = References.collect(references, own, ref_id, fold if rule == "out_of_fold" else None)
    prepared = References(refs.ids, refs.folds, metric.prepared(refs.rows))
    return _mapped(queries, features, metric, row_id, fold, prepared, rule, apart, k, threshold, keep)


def point_sums(spark, points: Points, metric: Metric) -> np.ndarray:
    """Of each different row the distances to all rows, summed: a job over all pairs of them, in memory a block at a time."""
    rows, counts = points.rows, points.counts.astype(float)
    step = 1024
    parts = -(-len(rows) // step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                some = rows.slice(part * step, (part + 1) * step)
                out = np.zeros(len(some))
                for i in range(0, len(some), 32):
                    for j in range(0, len(rows), 4096):
                        out[i : i + 32] += metric.distances(some.slice(i, i + 32), rows.slice(j, j + 4096)) @ counts[j : j + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([out], pa.list_(pa.float64()))], names=["part", "sums"])

    found = spark.range(0, parts, 1, max(1, min(parts, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "part long, sums array<double>").collect()
    return np.concatenate([np.array(r["sums"]) for r in sorted(found, key=lambda r: r["part"])]) if found else np.empty(0)


def _searched(queries, features, metric, row_id, fold, points: Points, rule, k, threshold, keep, totals) -> DataFrame:
    names = queries.columns if keep is None else keep
    wide = _spread(queries.select(*names, *([F.coalesce(F.col(fold).cast("long"), F.lit(_NONE)).alias("__fold")] if rule == "out_of_fold" else []), *features.columns()))
    shape = features.shape
    schema = T.StructType([*(queries.schema[c] for c in names), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in _RESULT)])
    search = points.search(metric, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, whole = shape.rows(b)
            place = np.flatnonzero(whole)
            some = metric.prepared(Rows(rows.numeric[place], rows.categories[place]))
            mine = b.column(b.schema.get_field_index("__fold")).to_numpy(zero_copy_only=False)[place] if rule == "out_of_fold" else None
            out = _found(some, place, b.num_rows, points, search, rule, mine, k, threshold, totals)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *out], names=[*names, *(c for c, _ in _RESULT)])

    return wide.mapInArrow(run, schema)


def _found(some: Rows, place: np.ndarray, n: int, points: Points, search: Tree | Flat | None, rule: str, mine: np.ndarray | None, k: int, threshold: float | None, totals: np.ndarray | None) -> list[pa.Array]:
    """The results of n queries, of which some, at place, miss nothing."""
    m = len(some)
    least, under, total = np.full(m, np.inf), np.zeros(m, np.int64), np.zeros(m)
    count = np.full(m, points.counts.sum(), np.int64)
    sizes, dists, ids = np.zeros(m, np.int64), np.empty(0), np.empty(0, np.int64)
    if search is not None and m:
        if rule == "other":  # each query is a reference: the nearest is its own
            q, r, d = search.nearest(some, 2)
            first = np.searchsorted(q, np.arange(m))
            there = first + 1 < np.searchsorted(q, np.arange(m), "right")
            least[there] = d[first[there] + 1]
            least[points.counts[r[first]] > 1] = 0.0
            count -= 1
            if totals is not None:
                total = totals[r[first]]
        elif k:
            q, r, d = search.nearest(some, k, mine, 2 * 10.0**-TIES)
            least = search_least(q, d, m)
            each = points.first[r + 1] - points.first[r]
            at = np.repeat(points.first[r] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            q, d, i = np.repeat(q, each), np.repeat(d, each), points.ids[at]
            by = np.lexsort((i, np.round(d, TIES), q))
            q, d, i = q[by], d[by], i[by]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            sizes, dists, ids = np.bincount(q[best], minlength=m), d[best], i[best]
        else:
            least = search.least(some, mine)
        if rule == "out_of_fold":
            known, at = np.unique(points.folds, return_inverse=True)
            own = np.bincount(at, weights=points.counts, minlength=len(known))
            here = np.minimum(np.searchsorted(known, mine), len(known) - 1)
            count -= np.where(known[here] == mine, own[here], 0).astype(np.int64)
        if threshold is not None and threshold > 0:
            for q, r, _ in search.within(some, np.full(m, np.nextafter(threshold, -np.inf)), mine):
                under += np.bincount(q, weights=points.counts[r], minlength=m).astype(np.int64)
            under -= rule == "other"
    missing = np.ones(n, bool)
    missing[place] = False
    back = np.zeros(n, np.int64)
    back[place] = np.arange(m)
    if not m:
        least, total, count, under = (np.zeros(1, x.dtype) for x in (least, total, count, under))
    empty = missing | ~np.isfinite(least[back])
    lists = [pa.nulls(n, pa.list_(pa.float64())), pa.nulls(n, pa.list_(pa.int64()))]
    if k:
        length = np.zeros(n, np.int64)
        length[place] = sizes
        offsets = np.concatenate([[0], np.cumsum(length)])
        offsets = pa.array(offsets.astype(np.int32), pa.int32(), mask=np.r_[missing, False])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(dists)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64()))]
    return [pa.array(least[back], mask=empty), pa.array(total[back], mask=empty if totals is not None else np.ones(n, bool)), pa.array(count[back], mask=missing), pa.array(under[back], mask=missing), *lists]


def search_least(q: np.ndarray, d: np.ndarray, m: int) -> np.ndarray:
    """The first distance of each of m queries of pairs in order; inf: none."""
    out = np.full(m, np.inf)
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    out[q[first]] = d[first]
    return out


def _mapped(queries, features, metric, row_id, fold, refs, rule, apart, k, threshold, keep) -> DataFrame:
    names = queries.columns if keep is None else keep
    wide = queries.select(*names, F.col(row_id).cast("long").alias("__id"), (F.col(fold).cast("long") if fold else F.lit(None).cast("long")).alias("__fold"), *features.columns())
    wide = _spread(wide)
    shape = features.shape
    schema = T.StructType([*(queries.schema[c] for c in names), *(T.StructField(c, T._parse_datatype_string(t)) for c, t in _RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, whole = shape.rows(b)
            at = {f: b.column(b.schema.get_field_index(f)).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False) for f in ("__id", "__fold")}
            place = np.flatnonzero(whole)
            some = metric.prepared(Rows(rows.numeric[place], rows.categories[place]))
            out = _results(some, place, b.num_rows, refs, _banned(rule, at["__id"][place], at["__fold"][place], refs, apart), metric, k, threshold)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), *out], names=[*names, *(c for c, _ in _RESULT)])

    return wide.mapInArrow(run, schema)


def _spread(df: DataFrame) -> DataFrame:
    """A small input, which may be a single split, is dealt over all cores first: its distances cost more than the exchange. A large one has splits enough."""
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _results(some: Rows, place: np.ndarray, n: int, refs: References, banned, metric: Metric, k: int, threshold: float | None) -> list[pa.Array]:
    least, total, count, under = np.full(n, np.inf), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    dists: list = [None] * n
    ids: list = [None] * n
    at = 0
    for low, s, c, u, near, top in partial(metric, some, refs.rows, banned, k, threshold):
        here = place[at : at + len(low)]
        least[here], total[here], count[here], under[here] = low, s, c, u
        if k:
            for i, d, t in zip(here.tolist(), near, top, strict=True):
                there = np.isfinite(d)
                dists[i], ids[i] = d[there], refs.ids[t[there]]
        at += len(low)
    missing = np.ones(n, bool)
    missing[place] = False
    empty = missing | ~np.isfinite(least)
    return [pa.array(least, mask=empty), pa.array(total, mask=empty), pa.array(count, mask=missing), pa.array(under, mask=missing), pa.array(dists, pa.list_(pa.float64())), pa.array(ids, pa.list_(pa.int64()))]


def _blocked(queries, references, features, own, metric, row_id, ref_id, rule, fold, apart, k, threshold, n, limit, keep, sums=True) -> DataFrame:
    """The same by an equi-join of packed blocks; query rows need an id of their own."""
    blocks, shape, own_shape = -(-n // limit), features.shape, own.shape
    packed_schema = "block int, data binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            data = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([data] * blocks, pa.binary())], names=["block", "data"])

    def keyed(df: DataFrame, f: Features, key: str) -> DataFrame:
        return df.select(F.col(key).cast("long").alias("__id"), (F.col(fold).cast("long") if fold else F.lit(None).cast("long")).alias("__fold"), *f.columns())

    def gather(table: pa.Table) -> pa.Table:
        block, table = table.column("block")[0].as_py(), table.drop_columns(["block"]).combine_chunks().sort_by("__id")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        return pa.table({"block": pa.array([block], pa.int32()), "refs": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = keyed(references, own, ref_id).withColumn("block", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int"))
    right = dealt.groupBy("block").applyInArrow(gather, "block int, refs binary")
    left = keyed(queries, features, row_id).mapInArrow(pack, packed_schema)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each block's tree is made once for the queries that follow each other. Rows are held out by their ids, or by their folds."""
        known = points = search = None
        label = "__id" if rule == "other" else "__fold"
        for b in batches:
            for block, data, packed in zip(*b.columns, strict=True):
                q = pa.ipc.open_stream(data.as_buffer()).read_all()
                col = lambda t, c: t.column(c).fill_null(_NONE).to_numpy()
                if known != block.as_py():
                    r = pa.ipc.open_stream(packed.as_buffer()).read_all()
                    ref_rows, whole = own_shape.rows(r)
                    points = Points.of(Rows(ref_rows.numeric[whole], ref_rows.categories[whole]), np.ones(int(whole.sum()), np.int64), None if rule == "all" else col(r, label)[whole], col(r, "__id")[whole] if k else None, metric, k)
                    known, search = block.as_py(), points.search(metric, k)
                rows, whole = shape.rows(q)
                place = np.flatnonzero(whole)
                out = _found(metric.prepared(Rows(rows.numeric[place], rows.categories[place])), place, q.num_rows, points, search, "all" if rule == "all" else "out_of_fold", None if rule == "all" else col(q, label)[place], k, threshold, None)
                yield pa.RecordBatch.from_arrays([q.column("__id").combine_chunks(), *out], names=["__id", *(c for c, _ in _RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, packed in zip(b.column(1), b.column(2), strict=True):
                q, r = (pa.ipc.open_stream(x.as_buffer()).read_all() for x in (data, packed))
                rows, whole = shape.rows(q)
                ref_rows, ref_whole = own_shape.rows(r)
                col = lambda t, c: t.column(c).fill_null(np.iinfo(np.int64).min).to_numpy()
                refs = References(col(r, "__id")[ref_whole], col(r, "__fold")[ref_whole], metric.prepared(Rows(ref_rows.numeric[ref_whole], ref_rows.categories[ref_whole])))
                place = np.flatnonzero(whole)
                banned = _banned(rule, col(q, "__id")[place], col(q, "__fold")[place], refs, apart)
                out = _results(metric.prepared(Rows(rows.numeric[place], rows.categories[place])), place, q.num_rows, refs, banned, metric, k, threshold)
                yield pa.RecordBatch.from_arrays([q.column("__id").combine_chunks(), *out], names=["__id", *(c for c, _ in _RESULT)])

    found = left.join(right, "block").select("block", "data", "refs").mapInArrow(searched if not sums and rule != "apart" and k <= (_MOST_NEAR if rule == "all" else 0) else run, "__id long, " + ", ".join(f"{c} {t}" for c, t in _RESULT))
    nearest_k = F.slice(F.array_sort(F.flatten(F.collect_list(F.zip_with(F.coalesce("nn_dists", F.array()), F.coalesce("nn_ids", F.array()), lambda d, i: F.struct(F.round(d, TIES).alias("r"), i.alias("i"), d.alias("d")))))), 1, max(1, k))
    merged = found.groupBy("__id").agg(F.min("nn_dist").alias("nn_dist"), F.sum("sum_dist").alias("sum_dist"), F.sum("n_dist").alias("n_dist"), F.sum("n_under").alias("n_under"), nearest_k.alias("__near"))
    merged = merged.select("__id", "nn_dist", "sum_dist", "n_dist", "n_under", F.when(F.lit(k > 0) & F.col("n_dist").isNotNull(), F.transform("__near", lambda s: s["d"])).alias("nn_dists"), F.when(F.lit(k > 0) & F.col("n_dist").isNotNull(), F.transform("__near", lambda s: s["i"])).alias("nn_ids"))
    found = queries.join(merged, queries[row_id].cast("long").eqNullSafe(merged["__id"]), "left").drop("__id")
    return found if keep is None else found.select(*keep, *(c for c, _ in _RESULT))


def ranges(a: DataFrame, b: DataFrame | None, columns: list[Column], b_columns: list[Column] | None = None) -> tuple[float, ...]:
    """The range of each number over both sides, for Gower."""
    def ends(df: DataFrame, cols: list[Column]) -> list:
        return list(df.agg(*(f(F.nanvl(c.cast("double"), F.lit(None))).alias(f"{f.__name__}{i}") for i, c in enumerate(cols) for f in (F.min, F.max))).first()) if cols else []

    one, two = ends(a, columns), ends(b, b_columns or columns) if b is not None else []
    both = [x for x in (one, two) if x]
    out = []
    for i in range(len(columns)):
        low, high = [x[2 * i] for x in both if x[2 * i] is not None], [x[2 * i + 1] for x in both if x[2 * i + 1] is not None]
        out.append(max(high) - min(low) if low else 0.0)
    return tuple(out)
