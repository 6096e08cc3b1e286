"""Rasters and vector features from open text formats: Esri ASCII grids as grid tables, and GeoJSON features, one to a line, as points or polygons.

Rasters of other kinds are turned into these by any GIS tool; what has been read is best written as Parquet (grid.write_grid).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domainscope.errors import DomainError
from domainscope.plans.ordered import with_rank
from domainscope.sources.grid import Grid, Polygon

_HEADER = ("ncols", "nrows", "cellsize", "nodata_value", "xllcorner", "yllcorner", "xllcenter", "yllcenter")


def read_raster(spark: SparkSession, path: str, layer: str) -> tuple[Grid, DataFrame]:
    """The grid of an Esri ASCII raster and its cells (cell_id, row, col, x, y and the layer, null for no data).

    A line of values is a row of cells; lines are numbered by their place in the file, whichever tasks read them."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where("line <> ''")
    named = lines.where(F.col("line").rlike("^[A-Za-z_]+\\s")).select(F.split("line", r"\s+").alias("p")).limit(len(_HEADER)).collect()
    head = {r["p"][0].lower(): float(r["p"][1]) for r in named}
    if missing := [k for k in ("ncols", "nrows", "cellsize") if k not in head]:
        raise DomainError(f"{path}: no {', '.join(missing)} in the header")
    rows, cols, size = int(head["nrows"]), int(head["ncols"]), head["cellsize"]
    x0 = head["xllcorner"] if "xllcorner" in head else head.get("xllcenter", 0.0) - size / 2
    y0 = head["yllcorner"] if "yllcorner" in head else head.get("yllcenter", 0.0) - size / 2
    numbered = with_rank(lines.where(~F.col("line").rlike("^[A-Za-z_]+\\s")), "block", ["at"], "n")
    values = numbered.select((F.col("n") - 1).alias("row"), F.posexplode(F.split("line", r"\s+")).alias("col", "value"))
    wrong = numbered.agg(F.count("*").alias("n"), F.max(F.size(F.split("line", r"\s+"))).alias("most"), F.min(F.size(F.split("line", r"\s+"))).alias("least")).first()
    if wrong["n"] != rows or not wrong["most"] == wrong["least"] == cols:
        raise DomainError(f"{path}: {wrong['n']} lines of {wrong['least']} to {wrong['most']} values, not {rows} of {cols}")
    value = F.col("value").cast("double")
    if "nodata_value" in head:
        value = F.when(value != F.lit(head["nodata_value"]), value)
    grid = Grid(x0, y0 + rows * size, size, rows, cols)
    place = [(F.col("row") * cols + F.col("col")).alias("cell_id"), "row", F.col("col").cast("long").alias("col"), (F.lit(x0) + (F.col("col") + 0.5) * size).alias("x"), (F.lit(grid.ymax) - (F.col("row") + 0.5) * size).alias("y")]
    return grid, values.select(*place, F.nanvl(value, F.lit(None)).alias(layer))


def read_rasters(spark: SparkSession, paths: dict[str, str]) -> tuple[Grid, DataFrame]:
    """Several layers of one grid, by name."""
    found = {layer: read_raster(spark, path, layer) for layer, path in paths.items()}
    grids = {g for g, _ in found.values()}
    if len(grids) != 1:
        raise DomainError("the rasters are not of one grid")
    tables = [cells if i == 0 else cells.select("cell_id", layer) for i, (layer, (_, cells)) in enumerate(found.items())]
    return grids.pop(), reduce(lambda a, b: a.join(b, "cell_id"), tables)


def _features(spark: SparkSession, path: str, coordinates: str, properties: str) -> DataFrame:
    line = F.regexp_replace(F.trim("value"), "^\u001e|,$", "")
    feature = F.from_json(line, f"type string, geometry struct<type: string, coordinates: {coordinates}>, properties struct<{properties}>").alias("f")
    return spark.read.text(path).where(F.trim("value") != "").select(feature).where("f.type = 'Feature'").select("f.geometry.type", "f.geometry.coordinates", "f.properties.*")


def read_points(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """x, y and the properties (such as "id: bigint, soil: string") of the point features of newline-delimited GeoJSON. Other features have no x and y."""
    c: Column = F.when(F.col("type") == "Point", F.col("coordinates"))
    return _features(spark, path, "array<double>", properties).select(F.get(c, 0).alias("x"), F.get(c, 1).alias("y"), "*").drop("type", "coordinates")


def read_polygon(spark: SparkSession, path: str, most: int = 10_000) -> Polygon:
    """All rings of the polygon features, for a Domain; at most so many features."""
    one = _features(spark, path, "array<array<array<double>>>", "id: string").where("type = 'Polygon'").select("coordinates").limit(most + 1).collect()
    many = _features(spark, path, "array<array<array<array<double>>>>", "id: string").where("type = 'MultiPolygon'").select("coordinates").limit(most + 1).collect()
    if len(one) + len(many) > most:
        raise DomainError(f"more than {most} polygons")
    rings = [r for p in one for r in p["coordinates"]] + [r for m in many for p in m["coordinates"] for r in p]
    if not rings:
        raise DomainError(f"{path}: no polygon")
    return [[(p[0], p[1]) for p in (r[:-1] if r[0] == r[-1] else r)] for r in rings]
