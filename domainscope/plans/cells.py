"""Exact nearest neighbours in the plane for reference sets that are too many to travel with the tasks.

Both sides are put on a square grid; a query meets the references of its own and the eight cells around in an equi-join, and its nearest
of these is the nearest of all if it is no farther than a cell is wide. Queries without such a one go on to cells twice as wide. The first
cells are fine, so that crowded places are settled while their cells hold few rows; what reaches the wide cells stands in empty country.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainscope.plans.stable import stable

#: The first cells hold a reference for every FIRST on average.
FIRST = 16


def _cell(c: str, low: float, h: float):
    return F.floor((F.col(c) - F.lit(low)) / F.lit(h)).cast("long")


def nearest_in_plane(queries: DataFrame, references: DataFrame, row_id: str, x: str = "x", y: str = "y", other: bool = False, rounds: int = 60) -> DataFrame:
    """row_id, dist; null where there is no reference or a coordinate is missing. other: not the reference of the same id. Query ids must be unique."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    left = queries.select(F.col(row_id).alias("id"), number(x).alias("qx"), number(y).alias("qy"))
    right = references.select(F.col(row_id).alias("rid"), number(x).alias("rx"), number(y).alias("ry")).where("rx is not null and ry is not null")
    n, x0, x1, y0, y1 = right.agg(F.count("*"), F.min("rx"), F.max("rx"), F.min("ry"), F.max("ry")).first()
    nothing = left.select("id", F.lit(None).cast("double").alias("dist"))
    if not n:
        return nothing.withColumnRenamed("id", row_id)
    missing = left.where("qx is null or qy is null")
    extent = max(x1 - x0, y1 - y0)
    q0, q1, q2, q3 = left.agg(F.min("qx"), F.max("qx"), F.min("qy"), F.max("qy")).first()
    if q0 is None:
        return nothing.withColumnRenamed("id", row_id)
    reach = max(extent, abs(q1 - x0), abs(x1 - q0), abs(q3 - y0), abs(y1 - q2)) or 1.0
    h = max(extent / math.sqrt(FIRST * n), reach * 2.0**-40)
    open_, done = left.where("qx is not null and qy is not null"), [missing.select("id", F.lit(None).cast("double").alias("dist"))]
    for _ in range(rounds):
        last = h > reach
        cells = right.select("rid", "rx", "ry", _cell("rx", x0, h).alias("cx"), _cell("ry", y0, h).alias("cy"))
        steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("s")
        around = open_.select("id", "qx", "qy", _cell("qx", x0, h).alias("ox"), _cell("qy", y0, h).alias("oy"), steps).select("id", "qx", "qy", (F.col("ox") + F.col("s.i")).alias("cx"), (F.col("oy") + F.col("s.j")).alias("cy"))
        met = around.join(cells, ["cx", "cy"])
        if other:
            met = met.where("id <> rid")
        dx, dy = F.col("qx") - F.col("rx"), F.col("qy") - F.col("ry")
        near = met.groupBy("id").agg(F.min(F.sqrt(dx * dx + dy * dy)).alias("dist"))
        found = stable(open_.join(near, "id", "left"))
        settled = F.coalesce(F.col("dist") <= F.lit(h), F.lit(False)) | F.lit(last)
        done.append(found.where(settled).select("id", "dist"))
        open_ = found.where(~settled).select("id", "qx", "qy")
        if last or open_.isEmpty():
            break
        h *= 2
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("id", row_id)
