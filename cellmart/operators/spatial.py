"""Point-in-polygon joins: both sides meet by grid square, the exact even-odd test runs as a join condition in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RINGS = "array<array<array<double>>>"
GRID = 0.25


def rings(geojson: Column) -> Column:
    """All rings of a Polygon or MultiPolygon, as arrays of [longitude, latitude]; null for anything else. Holes are rings too:
    by the even-odd rule they are outside."""
    kind = F.get_json_object(geojson, "$.type")
    one = F.from_json(F.get_json_object(geojson, "$.coordinates"), RINGS)
    many = F.flatten(F.from_json(F.get_json_object(geojson, "$.coordinates"), f"array<{RINGS}>"))
    return F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)


def envelope(r: Column) -> Column:
    part = lambda f, i: f(F.transform(F.flatten(r), lambda p: p[i]))
    return F.struct(part(F.array_min, 0).alias("west"), part(F.array_min, 1).alias("south"), part(F.array_max, 0).alias("east"), part(F.array_max, 1).alias("north"))


def contains(r: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings; points on an edge are outside."""

    def over_ring(ring: Column) -> Column:
        # A ring's edges are its points with their successors; an unclosed ring closes to its first point.
        ends = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(ring, ends, lambda a, b: F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")))

    edges = F.flatten(F.transform(r, over_ring))
    crossing = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    on = lambda e: ((e["bx"] - e["ax"]) * (y - e["ay"]) == (e["by"] - e["ay"]) * (x - e["ax"])) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"]))
    return (F.size(F.filter(edges, lambda e: F.coalesce(crossing(e), F.lit(False)))) % 2 == 1) & ~F.exists(edges, on)


def binned(polygons: DataFrame, grid: float = GRID) -> DataFrame:
    """polygons (boundary_geojson and others) with rings, once per grid square that their envelope meets."""
    p = polygons.withColumn("rings", rings(F.col("boundary_geojson"))).where("rings is not null").drop("boundary_geojson").withColumn("_e", envelope(F.col("rings")))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(f"_e.{a}") / grid), F.floor(F.col(f"_e.{b}") / grid)))
    return p.withColumn("_bx", span("west", "east")).withColumn("_by", span("south", "north")).drop("_e")


def join_points(points: DataFrame, polygons: DataFrame, grid: float = GRID) -> DataFrame:
    """Every pair of a point (longitude, latitude) and a polygon that holds it. A point meets the polygons of its
    square only; the planner broadcasts the polygons where their measured size allows, and shuffles by square else."""
    at = points.withColumns({"_px": F.floor(F.col("longitude") / grid), "_py": F.floor(F.col("latitude") / grid)})
    b = binned(polygons, grid)
    on = (at["_px"] == b["_bx"]) & (at["_py"] == b["_by"]) & contains(b["rings"], at["longitude"], at["latitude"])
    return at.join(b, on).drop("_px", "_py", "_bx", "_by", "rings")


def attribute(points: DataFrame, key: str, tracts: DataFrame, places: DataFrame, grid: float = GRID) -> DataFrame:
    """Per point the tract (of several the smallest id), the place of the smallest land (unknown land last), and the
    state and county that the tract's id begins with. Points without a hit have nulls."""
    ids = points.select(key, "longitude", "latitude")
    t = join_points(ids, tracts.select("geoid", "boundary_geojson"), grid).groupBy(key).agg(F.min("geoid").alias("tract_geoid"))
    p = join_points(ids, places.select("geoid", "land_area_sq_mi", "boundary_geojson"), grid)
    p = p.groupBy(key).agg(F.min(F.struct(F.coalesce("land_area_sq_mi", F.lit(float("inf"))), "geoid")).getField("geoid").alias("place_geoid"))
    out = points.join(t, key, "left").join(p, key, "left")
    prefix = lambda n: F.when(F.length("tract_geoid") >= n, F.substring("tract_geoid", 1, n))
    return out.withColumns({"state_fips": prefix(2), "county_geoid": prefix(5)})


def crosswalk(tracts: DataFrame, neighborhoods: DataFrame, grid: float = GRID) -> DataFrame:
    """Tracts (geoid, centroid_lon, centroid_lat) with every neighbourhood (id, boundary_geojson) that holds their centre."""
    at = tracts.select("geoid", F.col("centroid_lon").alias("longitude"), F.col("centroid_lat").alias("latitude"))
    return join_points(at, neighborhoods.select(F.col("id").alias("neighborhood_id"), "boundary_geojson"), grid).select("geoid", "neighborhood_id").distinct()


def with_neighborhood(incidents: DataFrame, links: DataFrame) -> DataFrame:
    """One neighbourhood per tract, the last by id."""
    one = links.groupBy(F.col("geoid").alias("tract_geoid")).agg(F.max("neighborhood_id").alias("neighborhood_id"))
    return incidents.drop("neighborhood_id").join(one, "tract_geoid", "left")
