"""The map queries: counts, pages, cells, hexagons, clusters. All but the page read a cube."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmart import model
from cellmart.functions import hexgrid
from cellmart.plans.filters import Counts

BOUNDARIES = {"state": "state_fips", "county": "county_geoid", "place": "place_geoid", "tract": "tract_geoid", "neighborhood": "neighborhood_id"}


def total(cube: DataFrame, p: Counts) -> DataFrame:
    """F10."""
    return cube.where(p.cells()).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))


def source_counts(cube: DataFrame, p: Counts) -> DataFrame:
    """F11."""
    return cube.where(p.cells()).groupBy("source_id").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def boundary_counts(cube: DataFrame, p: Counts, kind: str) -> DataFrame:
    """counts by one kind of boundary; another kind is an error."""
    if kind not in BOUNDARIES:
        raise ValueError(f"no such boundary: {kind}")
    key = BOUNDARIES[kind]
    return cube.where(p.cells()).where(F.col(key).isNotNull()).groupBy(F.col(key).alias("geoid")).agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def micro_cells(cube: DataFrame, p: Counts) -> DataFrame:
    """counts by cell with the mean place of what is in it."""
    sums = cube.where(p.cells()).groupBy("cell_lng", "cell_lat").agg(F.sum("cnt").alias("cnt"), F.sum("sum_lng").alias("x"), F.sum("sum_lat").alias("y")).where("cnt > 0")
    return sums.select("cell_lng", "cell_lat", "cnt", (F.col("x") / F.col("cnt")).alias("longitude"), (F.col("y") / F.col("cnt")).alias("latitude"))


def cluster_number(zoom: int, density: float = model.CLUSTER_DENSITY) -> int:
    """F15; halves go away from zero."""
    return max(1, math.floor(density * model.CLUSTER_FACTOR.get(zoom, 1.5) + 0.5))


def kmeans(x: np.ndarray, y: np.ndarray, n: np.ndarray, k: int, bbox: tuple[float, float, float, float], rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """weighted, from seeds on a grid over the box; equal distances go to the lower seed; empty clusters vanish."""
    if len(x) <= k:
        return x, y, n
    cols = math.ceil(math.sqrt(k))
    rows = -(-k // cols)
    w, s, e, north = bbox
    at = np.arange(k)
    cx, cy = w + (e - w) / (cols + 1) * (at % cols + 1), s + (north - s) / (rows + 1) * (at // cols + 1)
    own = np.zeros(len(x), int)
    for _ in range(rounds):
        new = np.concatenate([((x[i : i + 4096, None] - cx) ** 2 + (y[i : i + 4096, None] - cy) ** 2).argmin(axis=1) for i in range(0, len(x), 4096)])
        if (new == own).all():
            break
        own = new
        size = np.bincount(own, n, k)
        full = size > 0
        cx[full] = np.bincount(own, n * x, k)[full] / size[full]
        cy[full] = np.bincount(own, n * y, k)[full] / size[full]
    size = np.bincount(own, n, k)
    full = size > 0
    return np.bincount(own, n * x, k)[full] / size[full], np.bincount(own, n * y, k)[full] / size[full], size[full].astype(np.int64)


def clusters(cube: DataFrame, p: Counts, k: int) -> DataFrame:
    """F14 over the micro-cells of the box. These are at most as many as the box has cells; they meet in one task."""
    cells = micro_cells(cube, p).select("longitude", "latitude", F.col("cnt").cast("long").alias("cnt"), "cell_lng", "cell_lat")

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell_lng", "ascending"), ("cell_lat", "ascending")])
        x, y, n = kmeans(t["longitude"].to_numpy(), t["latitude"].to_numpy(), t["cnt"].to_numpy(), k, p.bbox)
        return pa.table({"longitude": x, "latitude": y, "cnt": n})

    return cells.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(work, "longitude double, latitude double, cnt long")


def hexagons(cube: DataFrame, p: Counts, zoom: int) -> DataFrame:
    """Hexagons of the zoom's resolution that meet the box, with corners; joined after the sums, not before."""
    resolution = model.HEX_BY_ZOOM.get(zoom, 5)
    rows = cube.where((F.col("resolution") == resolution) & p.hexagons())
    if p.bbox:
        rows = rows.where(hexgrid.overlaps(F.col("hexagon"), F.col("resolution"), *p.bbox))
    sums = rows.groupBy("resolution", "hexagon").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    return sums.select("hexagon", "cnt", hexgrid.vertices(F.col("hexagon"), F.col("resolution")).alias("vertices"))


def page(incidents: DataFrame, p: Counts, limit: int = 100, offset: int = 0, compat: bool = False) -> DataFrame:
    """H1: newest first, undated last; equal dates by id."""
    return incidents.where(p.features(compat)).orderBy(F.desc_nulls_last("occurred_at"), "source_incident_id").offset(offset).limit(limit)


def has_more(offset: int, got: int, whole: int) -> bool:
    """H5."""
    return offset + got < whole


def breaks(counts: DataFrame, column: str = "cnt") -> DataFrame:
    """smallest, quartiles by nearest rank without interpolation, largest. The order statistics come from ranks by value."""
    values = counts.groupBy(F.col(column).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = values.select("v", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))  # the distinct counts are few
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.lit(q) * F.col("total")), F.col("total") - 1), F.col("v")))
    return upto.agg(at(0.0).alias("lo"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(1.0).alias("hi"))


def choropleth(counts: DataFrame, areas: DataFrame) -> DataFrame:
    """Counts (geoid, cnt) per 1000 people and per square mile; 0 where that is missing."""
    per = lambda x, by: F.when(F.col(by) > 0, F.col("cnt") * x / F.col(by)).otherwise(F.lit(0.0))
    return counts.join(areas, "geoid").select("geoid", "cnt", per(1000.0, "population").alias("per_1k"), per(1.0, "land_area_sq_mi").alias("per_sq_mi"))


def heat_weight(severity) -> object:
    """0.2 for the lowest severity to 1 for the highest."""
    return F.lit(0.2) + (severity - 1) * 0.2


def layer(zoom: int) -> str:
    """D13."""
    return "heatmap" if zoom < 8 else "hexagons" if zoom < 13 else "points"


def taxonomy(spark: SparkSession) -> DataFrame:
    """The tree of categories, each with its subcategories."""
    rows = spark.createDataFrame(list(model.TAXONOMY), "name string, category string, severity int")
    return rows.groupBy("category").agg(F.sort_array(F.collect_list(F.struct("name", "severity"))).alias("subcategories"))
