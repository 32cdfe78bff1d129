"""The seven analytical tools over the fact. Each returns a DataFrame; run() goes by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmart.plans.filters import Analytics, _date


def count_incidents(incidents: DataFrame, p: Analytics) -> DataFrame:
    """by category, and the total in the row without one."""
    return incidents.where(p.where()).rollup("category").agg(F.count(F.lit(1)).alias("cnt"))


def rank_areas(incidents: DataFrame, tracts: DataFrame, links: DataFrame, neighborhoods: DataFrame, p: Analytics, safest: bool = True, limit: int = 10) -> DataFrame:
    """areas by incidents per 1000 people. Neighbourhoods of one name are one area; a tract counts in each of its
    neighbourhoods; people and land count once per tract. Dangerous-first is the exact reverse, so areas without a rate lead
    there (S16, S17). Incidents are counted by tract and category before the dimensions join."""
    counted = incidents.where(p.where()).where("tract_geoid is not null").groupBy(F.col("tract_geoid").alias("geoid"), "category").agg(F.count(F.lit(1)).alias("n"))
    names = links.join(neighborhoods.select(F.col("id").alias("neighborhood_id"), F.col("name").alias("hood")), "neighborhood_id", "left").select("geoid", "hood")
    rows = counted.join(tracts, "geoid").join(names, "geoid", "left")
    rows = rows.select("geoid", F.coalesce("hood", "geoid").alias("area_id"), F.coalesce("hood", "name").alias("area_name"), "population", "land_area_sq_mi", "category", "n")
    people = rows.groupBy("area_id", "geoid").agg(F.min("area_name").alias("area_name"), F.max("population").alias("population"), F.max("land_area_sq_mi").alias("land"), F.sum("n").alias("n"))
    people = people.groupBy("area_id").agg(F.min("area_name").alias("area_name"), F.sum("n").alias("total_incidents"), F.coalesce(F.sum("population"), F.lit(0)).alias("population"), F.coalesce(F.sum("land"), F.lit(0.0)).alias("land"))
    kinds = rows.groupBy("area_id", "category").agg(F.sum("n").alias("n")).groupBy("area_id").agg(F.sort_array(F.collect_list(F.struct("category", "n"))).alias("by_category"))
    rate = F.when(F.col("population") > 0, F.col("total_incidents") / F.col("population") * 1000)
    out = people.join(kinds, "area_id").select(
        "area_id", "area_name", "total_incidents", rate.alias("incidents_per_1k"), F.when(F.col("land") > 0, F.col("land")).alias("land_area_sq_mi"),
        F.when(F.col("land") > 0, F.col("total_incidents") / F.col("land")).alias("incidents_per_sq_mi"), "by_category")
    unrated = F.when(F.col("incidents_per_1k").isNull(), F.col("total_incidents")).otherwise(F.lit(0))
    order = [F.asc_nulls_last("incidents_per_1k"), unrated.asc(), F.asc("area_id")] if safest else [F.desc_nulls_first("incidents_per_1k"), unrated.desc(), F.asc("area_id")]
    top = out.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # of limit rows


def compare_periods(incidents: DataFrame, p: Analytics, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """counts by category in two periods, and overall in the row without one; only the envelope of both is read."""
    at = F.col("occurred_at")
    stamp = lambda d: F.lit(_date(d)).cast("timestamp_ntz")
    within = lambda x: (at >= stamp(x[0])) & (at <= stamp(x[1]))
    rows = incidents.where(p.where()).where((at >= stamp(min(a[0], b[0]))) & (at <= stamp(max(a[1], b[1]))))
    out = rows.rollup("category").agg(F.count_if(within(a)).alias("a_count"), F.count_if(within(b)).alias("b_count"))
    x, y = F.col("a_count"), F.col("b_count")
    return out.withColumn("percent_change", F.when(x > 0, (y - x) / x * 100).when(y > 0, 100.0).otherwise(0.0))  # S18


def trend(incidents: DataFrame, p: Analytics, grain: str = "month") -> DataFrame:
    """counts by day, week (from Monday), month or year, named by its first day."""
    if grain not in ("day", "week", "month", "year"):
        raise ValueError(f"no such grain: {grain}")
    rows = incidents.where(p.where()).where("occurred_at is not null")
    return rows.groupBy(F.date_format(F.date_trunc(grain, "occurred_at"), "yyyy-MM-dd").alias("period")).agg(F.count(F.lit(1)).alias("cnt"))


def top_types(incidents: DataFrame, p: Analytics, limit: int = 10) -> DataFrame:
    """the commonest subcategories, with all incidents' number beside; equal numbers by name."""
    counted = incidents.where(p.where()).groupBy("subcategory", "category").agg(F.count(F.lit(1)).alias("cnt"))
    whole = counted.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("total"))
    return counted.orderBy(F.desc("cnt"), "subcategory", "category").limit(limit).crossJoin(F.broadcast(whole))  # one row beside


def _named(incidents: DataFrame, state: str | None) -> DataFrame:
    rows = incidents.where("city is not null and city <> ''")
    return rows.where(F.col("state") == state.upper()) if state else rows


def list_cities(incidents: DataFrame, state: str | None = None) -> DataFrame:
    """F6."""
    return _named(incidents, state).groupBy("city", "state").agg(F.count(F.lit(1)).alias("cnt"))


def match_rank(column: Column, text: str) -> Column:
    """0 for the text itself, 1 for names that begin with it, 2 for others (S14: the text is a pattern)."""
    return F.when(column.ilike(text), 0).when(column.ilike(f"{text}%"), 1).otherwise(2)


def search_locations(incidents: DataFrame, text: str, state: str | None = None, limit: int = 10) -> DataFrame:
    """cities that contain the text: exact, then prefix, then others, the larger first."""
    if not text.strip():
        return list_cities(incidents.limit(0)).withColumn("match_rank", F.lit(2))
    found = _named(incidents, state).where(F.col("city").ilike(f"%{text}%")).groupBy("city", "state").agg(F.count(F.lit(1)).alias("cnt"))
    return found.withColumn("match_rank", match_rank(F.col("city"), text)).orderBy("match_rank", F.desc("cnt"), "city", "state").limit(limit)


def search_places(places: DataFrame, text: str, state: str | None = None, limit: int = 10) -> DataFrame:
    """Places (geoid, name, state_abbr, population) by population, unknown ones last."""
    found = places.where(F.col("name").ilike(f"%{text}%"))
    if state:
        found = found.where(F.col("state_abbr") == state.upper())
    return found.orderBy(F.desc_nulls_last("population"), "geoid").limit(limit)


TOOLS = {"count_incidents": count_incidents, "rank_areas": rank_areas, "compare_periods": compare_periods, "get_trend": trend, "top_crime_types": top_types, "list_cities": list_cities, "search_locations": search_locations}


def run(name: str, incidents: DataFrame, **params) -> DataFrame:
    """M: a tool by its name."""
    if name not in TOOLS:
        raise ValueError(f"no such tool: {name}")
    return TOOLS[name](incidents, **params)
