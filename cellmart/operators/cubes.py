"""Additive cubes over exportable incidents, and merges of what partitions have built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmart.functions.hexgrid import RESOLUTIONS, with_hexagon

DIMENSIONS = ["source_id", "subcategory", "category", "severity", "arrest", "day", "state_fips", "county_geoid", "place_geoid", "tract_geoid", "neighborhood_id"]


def exportable(incidents: DataFrame) -> DataFrame:
    """S1."""
    return incidents.where(F.col("has_coordinates") & F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90))


def cell(x: str) -> Column:
    """C19."""
    return F.floor(F.col(x) * 1000).cast("int")


def _dimensioned(incidents: DataFrame, undated: str | None) -> DataFrame:
    day = F.date_format("occurred_at", "yyyy-MM-dd")
    return exportable(incidents).withColumns({"day": day if undated is None else F.coalesce(day, F.lit(undated)), "arrest": F.coalesce(F.col("arrest_made"), F.lit(2))})


def cell_cube(incidents: DataFrame) -> DataFrame:
    """F8: counts and coordinate sums by cell and dimensions; undated rows have a null day."""
    rows = _dimensioned(incidents, None).select(cell("longitude").alias("cell_lng"), cell("latitude").alias("cell_lat"), *DIMENSIONS, "longitude", "latitude")
    return rows.groupBy("cell_lng", "cell_lat", *DIMENSIONS).agg(F.count(F.lit(1)).alias("cnt"), F.sum("longitude").alias("sum_lng"), F.sum("latitude").alias("sum_lat"))


def clustered(cube: DataFrame, *keys: str) -> DataFrame:
    """H7: dealt and sorted by range, so that Parquet's statistics prune by those keys."""
    return cube.repartitionByRange(*keys).sortWithinPartitions(*keys)


def hex_cube(incidents: DataFrame, resolutions: tuple[int, ...] = RESOLUTIONS) -> DataFrame:
    """counts by hexagon of each resolution and dimensions, in one scan; undated rows have the empty day (S9). The fan-out
    by resolution is summed on the map side, before the shuffle."""
    rows = _dimensioned(incidents, "").select("longitude", "latitude", *DIMENSIONS)
    return with_hexagon(rows, resolutions).groupBy("resolution", "hexagon", *DIMENSIONS).agg(F.count(F.lit(1)).alias("cnt"))


def grid_levels(incidents: DataFrame, levels: tuple[int, ...] = (1, 10, 100, 1000)) -> DataFrame:
    """The unpivot of F9 over square grids: counts by level and square."""
    cells = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("longitude") * n).cast("long").alias("x"), F.floor(F.col("latitude") * n).cast("long").alias("y")) for n in levels])
    return exportable(incidents).select(F.explode(cells).alias("c")).groupBy("c.level", "c.x", "c.y").agg(F.count(F.lit(1)).alias("cnt"))


def metadata(incidents: DataFrame) -> DataFrame:
    """One row with the distinct cities (sorted), first and last day and number of sources."""
    rows = exportable(incidents)
    return rows.agg(
        F.array_join(F.sort_array(F.collect_set("city")), ",").alias("cities"), F.date_format(F.min("occurred_at"), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max("occurred_at"), "yyyy-MM-dd").alias("last_day"), F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("incidents"))


def category_ids(incidents: DataFrame) -> DataFrame:
    """Surrogate ids, parents by name first, children behind them by name. The distinct classes are few."""
    kinds = exportable(incidents).select("subcategory", "category", "severity").distinct()
    parents = kinds.select(F.col("category").alias("name")).distinct().withColumn("id", F.row_number().over(Window.orderBy("name")).cast("long"))
    last = parents.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    children = kinds.join(parents.select(F.col("name").alias("category"), F.col("id").alias("parent_id")), "category").crossJoin(F.broadcast(last))
    place = F.row_number().over(Window.orderBy("subcategory", "category", "severity"))
    children = children.select((F.col("last") + place).alias("id"), F.col("subcategory").alias("name"), "parent_id", F.col("severity").cast("long").alias("severity"))
    none = F.lit(None).cast("long")
    return parents.select("id", "name", none.alias("parent_id"), none.alias("severity")).unionByName(children)


def merge_counts(*parts: DataFrame) -> DataFrame:
    """Cubes of separate partitions, one below the other; sums over them are right as they stand."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_distinct_on(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """The union with one row per key, of several the one that comes first by order."""
    return merge_counts(*parts).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def reissued(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """The features of all partitions with new ids in order: rank within a range partition on top of the ranks below it."""
    whole = merge_counts(*parts).repartitionByRange(*order).sortWithinPartitions(*order)
    whole = whole.withColumn("_m", F.monotonically_increasing_id())
    part, rank = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = whole.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    below = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_below"))  # a row a partition
    return whole.withColumn("_p", part).join(F.broadcast(below), "_p").withColumn("id", F.col("_below") + rank + 1).drop("_m", "_p", "_below")


def merge_metadata(parts: list[DataFrame]) -> DataFrame:
    """I4: (city, day, source_id) of the parts to the union of cities, first and last day, and sources."""
    return merge_counts(*parts).agg(F.sort_array(F.collect_set("city")).alias("cities"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sort_array(F.collect_set("source_id")).alias("sources"))


def boundary_search(layers: dict[str, DataFrame], text: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """Names that contain the text, over all layers (geoid, name, full_name, state_abbr, population), by name."""
    from cellmart.functions.text import contains_any_case

    found = [df.select(F.lit(k).alias("type"), "geoid", "name", "full_name", "state_abbr", "population") for k, df in layers.items() if kind in (None, k)]
    return merge_counts(*found).where(contains_any_case(F.col("name"), text)).orderBy("name", "type", "geoid").limit(min(limit, 100))
