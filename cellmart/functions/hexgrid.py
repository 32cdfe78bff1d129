"""A hexagonal grid of its own in plain column arithmetic (no UDF): axial coordinates on longitude and latitude in degrees.

The ids are not those of any published global hexagon index: the grid is planar, its resolutions shrink by the square root of
seven, and an id is `resolution:q:r`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOLUTIONS = (4, 5, 6, 7, 8, 9)


def edge(resolution: int) -> float:
    """A hexagon's edge in degrees."""
    return 0.25 / math.sqrt(7.0) ** (resolution - 4)


def with_hexagon(rows: DataFrame, resolutions: tuple[int, ...] = RESOLUTIONS) -> DataFrame:
    """C20: each row once per resolution with the id of the hexagon that holds its point (longitude, latitude).

    The steps are columns of their own, so that no expression is repeated inside another."""
    sizes = F.array(*[F.struct(F.lit(r).alias("resolution"), F.lit(edge(r)).alias("size")) for r in resolutions])
    own = [F.col(f"`{c}`") for c in rows.columns]
    q = (F.col("longitude") * (math.sqrt(3.0) / 3) - F.col("latitude") / 3) / F.col("_s.size")
    r = F.col("latitude") * (2.0 / 3) / F.col("_s.size")
    out = rows.withColumn("_s", F.explode(sizes)).withColumns({"_q": q, "_r": r})
    out = out.withColumns({"_x": F.floor(F.col("_q") + 0.5), "_z": F.floor(F.col("_r") + 0.5), "_y": F.floor(0.5 - F.col("_q") - F.col("_r"))})
    out = out.withColumns({"_dx": F.abs(F.col("_x") - F.col("_q")), "_dy": F.abs(F.col("_y") + F.col("_q") + F.col("_r")), "_dz": F.abs(F.col("_z") - F.col("_r"))})
    # The coordinate that rounding moved most follows from the other two.
    x_most = (F.col("_dx") > F.col("_dy")) & (F.col("_dx") > F.col("_dz"))
    a = F.when(x_most, -F.col("_y") - F.col("_z")).otherwise(F.col("_x"))
    b = F.when(x_most | (F.col("_dy") > F.col("_dz")), F.col("_z")).otherwise(-F.col("_x") - F.col("_y"))
    name = F.concat_ws(":", F.col("_s.resolution").cast("string"), a.cast("long").cast("string"), b.cast("long").cast("string"))
    return out.select(*own, F.col("_s.resolution").alias("resolution"), name.alias("hexagon"))


def centre(hexagon_id: Column, resolution: Column) -> Column:
    parts = F.split(hexagon_id, ":")
    q, r = F.get(parts, F.lit(1)).cast("double"), F.get(parts, F.lit(2)).cast("double")
    size = F.lit(0.25) / F.pow(F.lit(math.sqrt(7.0)), resolution - 4)
    return F.struct((size * math.sqrt(3.0) * (q + r / 2)).alias("longitude"), (size * 1.5 * r).alias("latitude"), size.alias("edge"))


def vertices(hexagon_id: Column, resolution: Column) -> Column:
    """The six corners, as an array of [longitude, latitude]."""
    c = centre(hexagon_id, resolution)
    corner = lambda k: F.array(c["longitude"] + c["edge"] * math.cos(math.radians(60 * k - 30)), c["latitude"] + c["edge"] * math.sin(math.radians(60 * k - 30)))
    return F.array(*[corner(k) for k in range(6)])


def overlaps(hexagon_id: Column, resolution: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a hexagon's envelope meets a box (a superset of the hexagons that do)."""
    c = centre(hexagon_id, resolution)
    half = c["edge"] * (math.sqrt(3.0) / 2)
    return (c["longitude"] + half >= west) & (c["longitude"] - half <= east) & (c["latitude"] + c["edge"] >= south) & (c["latitude"] - c["edge"] <= north)
