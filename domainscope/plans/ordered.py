"""Global order without a single task: ranks, running sums and fills in range buckets.

A window without a partition key pulls all rows into one task. Ranks come from a range partitioning by the ordering value and its ties together, so that
rows of one value spread over partitions, too; its rows are sorted, numbered and written once, and the sizes of the partitions give their offsets. Running
sums and fills deal rows to ranges of the value, whose totals give each range its offset, and the window runs within a range; the split
points come from ``percentile_approx`` and only balance the work: any split points give the same result. Totals are one row a range, so safe to collect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainscope.plans.stable import numbered

#: The most ranges, and the rows of a range while there are fewer.
BUCKETS, BUCKET_ROWS = 4096, 50_000
_B, _NO_GROUP = "__bucket", -(1 << 63)


def _splits(df: DataFrame, value: str) -> list:
    """Points that cut the values into parts of about BUCKET_ROWS rows, at most BUCKETS; none for as few rows as one task sorts at ease."""
    parts = min(BUCKETS, -(-df.count() // BUCKET_ROWS))
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return sorted(set(df.agg(F.percentile_approx(value, shares, 10 * parts)).first()[0] or ()))


def _bucketed(df: DataFrame, value: str, splits: list) -> DataFrame:
    """df with the number of split points that are not above the value; equal values share a bucket, nulls are in the first."""
    if not splits:
        return df.withColumn(_B, F.lit(0))
    points = F.array(*(F.lit(s) for s in splits))
    # a binary search: a dozen halvings reach the place
    low, width = F.lit(0), 1 << (len(splits) - 1).bit_length()
    at: Column = low
    while width:
        probe = at + F.lit(width)
        at = F.when((probe <= len(splits)) & (F.get(points, probe - 1) <= F.col(value)), probe).otherwise(at)
        df = df.withColumn(_B, at)
        at, width = F.col(_B), width >> 1
    return df.withColumn(_B, F.coalesce(F.col(_B), F.lit(0)))


def with_rank(df: DataFrame, value: str, ties: list[str], name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in the order of (value, ties)."""
    parts = -(-df.count() // BUCKET_ROWS)
    if parts < 2:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(value, *ties)).cast("long"))
    dealt = numbered(df.repartitionByRange(parts, value, *ties).sortWithinPartitions(value, *ties), "__at")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(dealt.groupBy(part.alias("p")).count().collect())
    before, total = [], 0
    for p in range(max(sizes) + 1):
        before.append(total)
        total += sizes.get(p, 0)
    return dealt.withColumn(name, place + F.get(F.lit(before).cast("array<bigint>"), part.cast("int")) + 1).drop("__at")


def hash_rank(df: DataFrame, unit: str, seed: int, name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in the order of md5(seed:unit), unit: a reproducible shuffle."""
    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")).cast("binary")))
    return with_rank(hashed, "__h", [unit], name).drop("__h")


def _by_bucket(values: dict, kind) -> Column:
    """The value of a bucket, by its number."""
    return F.get(F.lit([values.get(b) for b in range(max(values, default=0) + 1)]).cast(T.ArrayType(kind)), F.col(_B)) if any(v is not None for v in values.values()) else F.lit(None).cast(kind)


def running_totals(df: DataFrame, value: str, counters: list[str], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One row for each distinct value: value, next (the next larger value, null at the end), and the running sums of the counters.

    keep: persists the sums, where the caller knows when they can go."""
    sums = keep(df.groupBy(value).agg(*(F.sum(c).cast("double").alias(c) for c in counters)))
    dealt = _bucketed(sums, value, _splits(sums, value))
    rows = sorted(dealt.groupBy(_B).agg(F.min(value).alias("least"), *(F.sum(c).alias(c) for c in counters)).collect(), key=lambda r: r[_B])
    before, following = {c: {} for c in counters}, {}
    for i, r in enumerate(rows):
        for c in counters:
            before[c][r[_B]] = 0.0 if not i else before[c][rows[i - 1][_B]] + rows[i - 1][c]
        following[r[_B]] = rows[i + 1]["least"] if i + 1 < len(rows) else None
    within = Window.partitionBy(_B).orderBy(value)
    return dealt.select(
        value, F.coalesce(F.lead(value).over(within), _by_bucket(following, df.schema[value].dataType)).alias("next"),
        *((F.sum(c).over(within) + _by_bucket(before[c], T.DoubleType())).alias(c) for c in counters),
    )


def nearest_1d(df: DataFrame, value: str, is_reference: str) -> DataFrame:
    """df with ``below`` and ``above``: the nearest reference value at or under, and at or over, each row's value.

    A row that is itself a reference looks at the other references: equal values of another row count."""
    dealt = _bucketed(df, value, _splits(df, value))
    ref = F.when(F.col(is_reference), F.col(value))
    rows = sorted(dealt.groupBy(_B).agg(F.min(ref).alias("least"), F.max(ref).alias("most")).collect(), key=lambda r: r[_B])
    under, over, known = {}, {}, None
    for r in rows:
        under[r[_B]], known = known, r["most"] if r["most"] is not None else known
    known = None
    for r in reversed(rows):
        over[r[_B]], known = known, r["least"] if r["least"] is not None else known
    kind = df.schema[value].dataType
    fixed = lambda d: _by_bucket(d, kind)
    # both ways as running frames, which take linear time; the second runs exactly against the first, ties included
    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy(_B).orderBy(value, F.col(is_reference).cast("int"))))
    before = lambda order: F.last(ref, ignorenulls=True).over(Window.partitionBy(_B).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(*df.columns, F.coalesce(before(F.col("__at")), fixed(under)).alias("below"), F.coalesce(before(F.desc("__at")), fixed(over)).alias("above"))


def nearest_other(df: DataFrame, value: str, group: str) -> DataFrame:
    """df with ``below`` and ``above``: the nearest value at or under, and at or over, each row's value, of the rows of another group; a null group is one, too.

    In the order of the values the last row of another group is the one before the run of rows of the own group. What stands in the buckets before is known from
    two rows of different groups."""
    dealt = _bucketed(df.withColumn("__g", F.coalesce(F.col(group).cast("long"), F.lit(_NO_GROUP))), value, _splits(df, value))
    ends = dealt.groupBy(_B, "__g").agg(F.min(value).alias("least"), F.max(value).alias("most"))
    two = lambda order: F.row_number().over(Window.partitionBy(_B).orderBy(order, "__g"))
    ends = ends.withColumns({"low": two(F.col("least")), "high": two(F.desc("most"))}).where("low <= 2 or high <= 2").collect()  # four of a bucket
    kind = df.schema[value].dataType

    def carried(rows: list, name: str, sign: int) -> Column:
        """The nearest value of another group in the buckets before (sign -1) or behind a row's own."""
        buckets: dict = {}
        for r in rows:
            buckets.setdefault(r[_B], []).append((r[name], r["__g"]))
        first, group_of, second, known = {}, {}, {}, []
        for b in sorted(buckets, reverse=sign > 0):
            first[b], group_of[b], second[b] = (known[0][0] if known else None), (known[0][1] if known else None), (known[1][0] if len(known) > 1 else None)
            best: dict = {}
            for v, g in sorted([*known, *buckets[b]], key=lambda p: sign * p[0]):
                best.setdefault(g, v)
            known = [(v, g) for g, v in best.items()][:2]
        return F.when(F.col("__g") == _by_bucket(group_of, T.LongType()), _by_bucket(second, kind)).otherwise(_by_bucket(first, kind))

    placed = dealt.withColumn("__at", F.row_number().over(Window.partitionBy(_B).orderBy(value, "__g")))

    def before(order: Column) -> Column:
        window = Window.partitionBy(_B).orderBy(order)
        return F.when(F.lag("__g").over(window) != F.col("__g"), F.lag(value).over(window))

    starts = placed.withColumns({"__b": before(F.col("__at")), "__a": before(F.desc("__at"))})
    run = lambda c, order: F.last(c, ignorenulls=True).over(Window.partitionBy(_B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return starts.select(*df.columns, F.coalesce(run("__b", F.col("__at")), carried(ends, "most", -1)).alias("below"), F.coalesce(run("__a", F.desc("__at")), carried(ends, "least", 1)).alias("above"))


__all__ = ["hash_rank", "nearest_1d", "nearest_other", "running_totals", "with_rank"]
