"""Grids and points as tables: cells with a number, lookups at points, sampling, polygons, simulated clusters.

A grid table has a row for each cell: cell_id (row-major from the upper left corner), row, col, x, y (the cell's centre) and one column for each layer, null for no data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domainscope.errors import DomainError
from domainscope.plans.ordered import with_rank

Ring = Sequence[tuple[float, float]]
Polygon = Ring | Sequence[Ring]


@dataclass(frozen=True)
class Grid:
    xmin: float
    ymax: float
    res: float
    rows: int
    cols: int

    def cells(self, spark: SparkSession) -> DataFrame:
        n = self.rows * self.cols
        at = spark.range(n).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / self.cols).cast("long").alias("row"), F.pmod("id", F.lit(self.cols)).alias("col"))
        return at.select("*", (F.lit(self.xmin) + (F.col("col") + 0.5) * self.res).alias("x"), (F.lit(self.ymax) - (F.col("row") + 0.5) * self.res).alias("y"))

    def cell_id(self, x: Column, y: Column) -> Column:
        """The cell of a point; null outside. Points on the outer right and lower edge belong to the last cells."""
        col = F.when(x == self.xmin + self.cols * self.res, self.cols - 1).otherwise(F.floor((x - self.xmin) / self.res))
        row = F.when(y == self.ymax - self.rows * self.res, self.rows - 1).otherwise(F.floor((F.lit(self.ymax) - y) / self.res))
        return F.when((col >= 0) & (col < self.cols) & (row >= 0) & (row < self.rows), (row * self.cols + col).cast("long"))

    def extract(self, points: DataFrame, grid: DataFrame, layers: list[str], x: str = "x", y: str = "y") -> DataFrame:
        """points with the layers of their cells, by an equi-join on the cell's number; null outside."""
        if clash := [c for c in layers if c in points.columns]:
            raise DomainError(f"points have columns named {', '.join(clash)}")
        values = grid.select(F.col("cell_id").alias("__cell"), *layers)
        return points.withColumn("__at", self.cell_id(F.col(x), F.col(y))).join(values, F.col("__at") == F.col("__cell"), "left").drop("__at", "__cell")

    def to_grid(self, table: DataFrame, values: list[str]) -> DataFrame:
        """All cells of the grid with the table's values (by cell_id), null where it has no row."""
        return self.cells(table.sparkSession).join(table.select("cell_id", *values), "cell_id", "left")


def footprint(grid: DataFrame, layers: list[str]) -> DataFrame:
    """The cells where any layer has a value."""
    some = F.lit(False)
    for c in layers:
        some = some | F.col(c).isNotNull()
    return grid.where(some)


def uniform(n: Column | str, seed: int, stream: int = 0) -> Column:
    """A number in [0, 1) that depends on the row's number and the seed alone: the same in any partitioning."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.lit(stream), (F.col(n) if isinstance(n, str) else n).cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(16**12)


def regular_points(spark: SparkSession, box: tuple[float, float, float, float], n: int) -> DataFrame:
    """id, x, y: about n points on a square lattice over (xmin, ymin, xmax, ymax)."""
    x0, y0, x1, y1 = box
    step = math.sqrt((x1 - x0) * (y1 - y0) / n)
    cols, rows = max(1, round((x1 - x0) / step)), max(1, round((y1 - y0) / step))
    return spark.range(rows * cols).select("id", (x0 + (F.pmod("id", F.lit(cols)) + 0.5) * ((x1 - x0) / cols)).alias("x"), (y0 + (F.floor(F.col("id") / cols) + 0.5) * ((y1 - y0) / rows)).alias("y"))


def random_points(spark: SparkSession, box: tuple[float, float, float, float], n: int, seed: int = 1) -> DataFrame:
    """id, x, y: n uniform points."""
    x0, y0, x1, y1 = box
    return spark.range(n).select("id", (x0 + uniform("id", seed, 0) * (x1 - x0)).alias("x"), (y0 + uniform("id", seed, 1) * (y1 - y0)).alias("y"))


#: The golden ratio less one.
GOLDEN = (math.sqrt(5) - 1) / 2


def fibonacci_points(spark: SparkSession, n: int) -> DataFrame:
    """id, x (longitude), y (latitude): n points spread evenly over the sphere."""
    lon = F.pmod(F.col("id") * F.lit(360 * GOLDEN) + 180, F.lit(360.0)) - 180
    return spark.range(n).select("id", lon.alias("x"), F.degrees(F.asin((F.col("id") * 2 + 1) / n - 1)).alias("y"))


def sample_points(spark: SparkSession, box: tuple[float, float, float, float], n: int, sampling: str = "regular", ring: Polygon | None = None, seed: int = 1, tries: int = 20) -> DataFrame:
    """id, x, y: points of a box, or of the polygon in it; random sampling gives n of them, regular about n."""
    if sampling not in ("regular", "random", "fibonacci"):
        raise DomainError(f"sampling {sampling!r}: regular, random or fibonacci")
    if sampling == "fibonacci":
        points = fibonacci_points(spark, n)
        return points if ring is None else points.where(in_polygon(F.col("x"), F.col("y"), ring))
    if ring is None:
        return regular_points(spark, box, n) if sampling == "regular" else random_points(spark, box, n, seed)
    share = polygon_area(ring) / ((box[2] - box[0]) * (box[3] - box[1]))
    if share <= 0:
        raise DomainError("the polygon has no area")
    many = math.ceil(n / share)
    if sampling == "regular":
        return regular_points(spark, box, many).where(in_polygon(F.col("x"), F.col("y"), ring))
    for _ in range(tries):
        points = random_points(spark, box, many, seed).where(in_polygon(F.col("x"), F.col("y"), ring)).orderBy("id").limit(n)
        if points.count() == n:
            return points
        many *= 2
    raise DomainError("too few random points fall into the polygon")


def sample_cells(grid: DataFrame, layers: list[str], n: int, seed: int = 1) -> DataFrame:
    """n cells with values, in the order of a seeded hash; all, if there are fewer."""
    return footprint(grid, layers).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("cell_id").cast("string")).cast("binary")), "cell_id").limit(n)


def rings(polygon: Polygon) -> list[list[tuple[float, float]]]:
    """The rings of a polygon: one, or several. What lies in an odd number of rings is inside: parts stand apart, a hole is a ring within a part."""
    return [list(polygon)] if isinstance(polygon[0][0], (int, float)) else [list(r) for r in polygon]


def _edges(ring: list[tuple[float, float]]):
    return zip(ring, [*ring[1:], ring[0]], strict=True)


def polygon_area(polygon: Polygon) -> float:
    """Parts less holes; a ring is a hole if an odd number of the others hold its first point."""
    every, total = rings(polygon), 0.0
    for ring in every:
        x, y = ring[0]
        depth = sum(sum((y < y0) != (y < y1) and x < (y - y0) * ((x1 - x0) / (y1 - y0)) + x0 for (x0, y0), (x1, y1) in _edges(other) if y0 != y1) % 2 for other in every if other is not ring)
        total += (-1) ** depth * abs(sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in _edges(ring))) / 2
    return total


def in_polygon(x: Column, y: Column, polygon: Polygon) -> Column:
    """Whether a point is inside, by counting the edges above it. A box test goes first, and can be pushed to a scan.

    Points on an edge: those on a lower edge or on a vertical one to the right are inside, those on an upper one or a vertical one to the left aren't. Sides
    are told by products, so that whole numbers are exact."""
    every = rings(polygon)
    xs, ys = [p[0] for r in every for p in r], [p[1] for r in every for p in r]
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in (sorted(edge) for ring in every for edge in _edges(ring)):
        if x0 != x1:
            crosses = (x > x0) & (x <= x1) & ((y - y0) * (x1 - x0) < (x - x0) * (y1 - y0))
            crossings = crossings + crosses.cast("int")
    return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & (crossings % 2 == 1)


@dataclass(frozen=True)
class Domain:
    """Where predictions will be made: a box, a polygon (its ring, or its rings), or the cells of a grid table in which any of the layers has a value."""

    box: tuple[float, float, float, float] | None = None
    ring: Polygon | None = None
    cells: DataFrame | None = None
    layers: tuple[str, ...] = ()

    def points(self, spark: SparkSession, n: int, sampling: str = "regular", seed: int = 1, row_id: str = "id") -> DataFrame:
        """About n points (exactly n at random) with their x and y; of a grid, cells with all their columns, fewer if there are fewer."""
        if self.cells is not None:
            if not self.layers:
                raise DomainError("a grid domain needs its layers")
            if sampling == "random":
                found = sample_cells(self.cells, list(self.layers), n, seed)
            else:
                some = footprint(self.cells, list(self.layers))
                step = max(1, round(math.sqrt(some.count() / n)))
                found = some.where((F.col("row") % step == step // 2) & (F.col("col") % step == step // 2))
            return found.withColumn(row_id, F.col("cell_id"))
        if self.ring is None and self.box is None:
            raise DomainError("a domain needs a box, a ring or cells")
        corners = [p for r in rings(self.ring) for p in r] if self.ring else []
        box = self.box or (min(x for x, _ in corners), min(y for _, y in corners), max(x for x, _ in corners), max(y for _, y in corners))
        return sample_points(spark, box, n, sampling, self.ring, seed).withColumnRenamed("id", row_id)


def clustered_points(spark: SparkSession, box: tuple[float, float, float, float], n: int, parents: int, radius: float, ring: Polygon | None = None, seed: int = 1, tries: int = 200) -> DataFrame:
    """id, x, y, parent: parents uniform in the area, then round((n - parents) / parents) children of each within radius of it and in the area.

    A child takes the first of ``tries`` seeded draws that lies in the area; one without any stands on its parent."""
    if parents < 1 or n < parents or radius <= 0:
        raise DomainError("at least one parent, no fewer points than parents, and a radius over 0 are needed")
    children = round((n - parents) / parents)
    tops = sample_points(spark, box, parents, "random", ring, seed).select(F.col("id").alias("__id"), "x", "y")
    tops = with_rank(tops, "__id", [], "parent").select("parent", "x", "y")
    own = tops.select((F.col("parent") - 1).alias("id"), "x", "y", "parent")
    drawn = tops.select("parent", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.sequence(F.lit(0), F.lit(children - 1))).alias("child")) if children else None
    if drawn is None:
        return own
    key = F.concat_ws("-", "parent", "child")
    x0, y0, x1, y1 = box

    def draw(i: Column) -> Column:
        r, a = F.sqrt(uniform(F.concat_ws("-", key, i), seed, 2)) * radius, uniform(F.concat_ws("-", key, i), seed, 3) * (2 * math.pi)
        x, y = F.col("px") + r * F.cos(a), F.col("py") + r * F.sin(a)
        good = x.between(x0, x1) & y.between(y0, y1)
        return F.struct(x.alias("x"), y.alias("y"), (good & in_polygon(x, y, ring) if ring else good).alias("good"))

    draws = F.filter(F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), draw), lambda d: d["good"])
    placed = drawn.withColumn("d", F.get(draws, 0)).select((F.lit(parents) + (F.col("parent") - 1) * children + F.col("child")).cast("long").alias("id"), F.coalesce("d.x", "px").alias("x"), F.coalesce("d.y", "py").alias("y"), "parent")
    return own.unionByName(placed)


def write_grid(grid: DataFrame, path: str, tile: int | None = None, cols: int | None = None) -> None:
    """Parquet; with tile (cells on a side) partitioned by tile, so that readers of an area skip the rest."""
    if tile is None:
        grid.write.mode("errorifexists").parquet(path)
        return
    tiled = grid.withColumn("tile_row", F.floor(F.col("row") / tile)).withColumn("tile_col", F.floor(F.col("col") / tile))
    tiled.write.mode("errorifexists").partitionBy("tile_row", "tile_col").parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
