"""Geocoding as one declarative job: candidates, cleaned addresses, cache, a cascade of resolvers, write-back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmart.functions.text import clean_address, normalize_address, normalize_state, normalize_street, one_line
from cellmart.operators.store import mark_geocoded, update_coordinates

Resolver = Callable[[DataFrame], DataFrame]  # (address_key, street, city, state) -> (address_key, longitude, latitude)


def candidates(incidents: DataFrame) -> DataFrame:
    """Ungeocoded rows with an address by unique cleaned address, with the number of incidents it stands for.

    Ids are not gathered per address, which could be any number; results go back by joining on the address."""
    return addressed(incidents).groupBy("address_key", "street", "city", "state").agg(F.count(F.lit(1)).alias("incidents"))


def addressed(incidents: DataFrame) -> DataFrame:
    """Those rows with their cleaned address; a crossing is asked for as "a and b"."""
    rows = incidents.where("not has_coordinates and not geocoded and block_address is not null and city is not null")
    a = clean_address(F.col("block_address"))
    rows = rows.select("source_incident_id", "city", "state", a.alias("a")).where("a.kind <> 'NONE'")
    street = F.when(F.col("a.kind") == "INTERSECTION", F.concat("a.street", F.lit(" and "), "a.cross")).otherwise(F.col("a.street"))
    return rows.withColumn("street", street).select("source_incident_id", "city", "state", "street", one_line(F.col("street"), F.col("city"), F.col("state")).alias("address_key"))


def split_by_cache(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, keys that nobody has tried). One entry of any provider, even a miss, counts as tried."""
    hits = cache.where("longitude is not null and latitude is not null").withColumn("_n", F.row_number().over(Window.partitionBy("address_key").orderBy("provider"))).where("_n = 1")
    return asked.join(hits.select("address_key", "longitude", "latitude"), "address_key"), asked.join(cache.select("address_key").distinct(), "address_key", "left_anti")


def cascade(asked: DataFrame, resolvers: list[tuple[str, int, Resolver]], keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(found, cache entries of all that was tried). Resolvers go by priority, equal ones in the given order; each sees
    what those before left unresolved. keep() gets each one's answers, which are read three times, and may write them."""
    found, tried, left = None, None, asked
    for name, _, resolve in sorted(resolvers, key=lambda r: r[1]):
        hits = resolve(left).where("longitude is not null").withColumn("provider", F.lit(name))
        hits = keep(hits if "exact" in hits.columns else hits.withColumn("exact", F.lit(False)))
        entries = cache_rows(left, hits, name)
        found, tried = (hits, entries) if found is None else (found.unionByName(hits), tried.unionByName(entries))
        left = left.join(hits.select("address_key"), "address_key", "left_anti")
    return found, tried


def cache_rows(asked: DataFrame, found: DataFrame, provider: str) -> DataFrame:
    """Entries for a provider: its hits, and nulls for what it missed."""
    return asked.select("address_key").join(found.select("address_key", "longitude", "latitude"), "address_key", "left").withColumn("provider", F.lit(provider))


def near_word(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, change or swap of neighbours leads from a to b, or none."""
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & F.exists(F.sequence(F.lit(1), F.length(a) - 1), swapped))


def near_words(a: str, b: str) -> Column:
    """Whether two normalised strings have as many words, each at one edit or the same; empty ones are near nothing."""
    x, y = F.split(a, " "), F.split(b, " ")
    near = F.forall(F.zip_with(x, y, near_word), lambda hit: F.coalesce(hit, F.lit(False)))
    return (F.col(a) != "") & (F.col(b) != "") & (F.size(x) == F.size(y)) & near


def index(addresses: DataFrame) -> DataFrame:
    """Rows LON, LAT, NUMBER, STREET, CITY, REGION, POSTCODE as searchable text; rows without a street or place fall out."""
    x, y = F.col("LON").try_cast("double"), F.col("LAT").try_cast("double")
    rows = addresses.select(x.alias("longitude"), y.alias("latitude"), normalize_street(F.coalesce("NUMBER", F.lit("")), F.coalesce("STREET", F.lit(""))).alias("street"), normalize_address(F.coalesce("CITY", F.lit(""))).alias("city"), normalize_state(F.coalesce("REGION", F.lit(""))).alias("state"), F.coalesce("POSTCODE", F.lit("")).alias("postcode"))
    return rows.where("street <> '' and longitude between -180 and 180 and latitude between -90 and 90").withColumn("number", F.split("street", " ")[0])


def local_resolver(addresses: DataFrame) -> Resolver:
    """The best entry of the local index: level 1 the same street and city, 2 a street within one edit a word in the
    same city, 3 street and city within one edit a word, 4 the same street elsewhere in the state.

    Every level's pairs meet by state, house number and number of words, so no pair of unrelated addresses is compared."""

    def resolve(asked: DataFrame) -> DataFrame:
        q = asked.select("address_key", normalize_address(F.col("street")).alias("q_street"), normalize_address(F.col("city")).alias("q_city"), normalize_state(F.col("state")).alias("q_state"))
        q = q.withColumns({"q_number": F.split("q_street", " ")[0], "q_words": F.size(F.split("q_street", " "))})
        known = addresses.withColumn("words", F.size(F.split("street", " ")))
        pairs = q.join(known, (q["q_state"] == known["state"]) & (q["q_number"] == known["number"]) & (q["q_words"] == known["words"]))
        same_street, same_city = F.col("q_street") == F.col("street"), F.col("q_city") == F.col("city")
        pairs = pairs.withColumn("near_street", near_words("q_street", "street")).withColumn("near_city", near_words("q_city", "city"))
        level = F.when(same_street & same_city, 1).when(F.col("near_street") & same_city, 2).when(F.col("near_street") & F.col("near_city"), 3).when(same_street, 4)
        best = pairs.withColumn("level", level).where("level is not null")
        best = best.groupBy("address_key").agg(F.min(F.struct("level", "street", "city", "longitude", "latitude")).alias("b"))
        return best.select("address_key", "b.longitude", "b.latitude", (F.col("b.level") == 1).alias("exact"))

    return resolve


def parse_batch_reply(lines: DataFrame) -> DataFrame:
    """K3: replies of a batch service as CSV text: id, address, match, kind, matched address, "lon,lat", ...; only matches count."""
    row = F.from_csv("value", F.lit("id string, address string, matched string, kind string, found string, place string"), {"mode": "PERMISSIVE"})
    at = F.split("r.place", ",")
    return lines.select(row.alias("r")).where("r.matched = 'Match'").select(F.col("r.id").alias("id"), (F.col("r.kind") == "Exact").alias("exact"), at[0].try_cast("double").alias("longitude"), at[1].try_cast("double").alias("latitude")).where("longitude is not null and latitude is not null")


def compare_providers(cache: DataFrame, a: str, b: str, within: float = 0.001) -> DataFrame:
    """K8: keys that provider a tried, hits of either, and agreement on both axes."""
    side = lambda p: cache.where(F.col("provider") == p).select("address_key", F.col("longitude").alias(f"x_{p}"), F.col("latitude").alias(f"y_{p}"))
    j = side(a).join(side(b), "address_key", "left")
    xa, ya, xb, yb = (F.col(f"{k}_{p}") for p in (a, b) for k in "xy")
    return j.agg(F.count(F.lit(1)).alias("tried"), F.count_if(xa.isNotNull()).alias("hits_a"), F.count_if(xb.isNotNull()).alias("hits_b"), F.count_if((F.abs(xa - xb) <= within) & (F.abs(ya - yb) <= within)).alias("agree"))


def geocode(incidents: DataFrame, cache: DataFrame, resolvers: list[tuple[str, int, Resolver]]) -> DataFrame:
    """K1: (source_incident_id, longitude, latitude) of all rows that cache or resolvers can place."""
    asked = candidates(incidents)
    hits, untried = split_by_cache(asked, cache)
    found = hits.select("address_key", "longitude", "latitude").unionByName(cascade(untried, resolvers)[0].select("address_key", "longitude", "latitude"))
    return addressed(incidents).join(found, "address_key").select("source_incident_id", "longitude", "latitude")


def geocode_into(incidents: DataFrame, cache: DataFrame, resolvers: list[tuple[str, int, Resolver]], keep: Callable[[DataFrame], DataFrame] = lambda df: df, sources: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(incidents, cache) afterwards: coordinates of what was placed, all rows that were asked for marked, entries of
    every provider for what it was asked, misses included.

    K2: with sources, all their rows with an address are asked again; those placed lose their attribution."""
    view = incidents
    if sources:
        again = F.col("source_id").isin(sources)
        view = incidents.where(again).withColumns({"has_coordinates": F.lit(False), "geocoded": F.lit(False)})
    hits, untried = split_by_cache(candidates(view), cache)
    found, tried = cascade(untried, resolvers, keep)
    where = hits.select("address_key", "longitude", "latitude").unionByName(found.select("address_key", "longitude", "latitude"))
    rows = addressed(view)
    placed = update_coordinates(incidents, rows.join(where, "address_key").select("source_incident_id", "longitude", "latitude"), bool(sources))
    return mark_geocoded(placed, rows), cache.unionByName(tried.select(*cache.columns))


def feature_replies(replies: DataFrame, column: str = "value") -> DataFrame:
    """K4: a reply's first feature: coordinates, label, and whether its confidence is 0.9 or more. Replies without one fall out."""
    get = lambda path, to: F.try_variant_get(F.try_parse_json(column), f"$.features[0].{path}", to)
    exact = F.coalesce(get("properties.confidence", "double") >= 0.9, F.lit(False))
    out = replies.withColumns({"longitude": get("geometry.coordinates[0]", "double"), "latitude": get("geometry.coordinates[1]", "double"), "matched_address": get("properties.label", "string"), "exact": exact})
    return out.where("longitude is not null and latitude is not null").drop(column)


def place_replies(replies: DataFrame, column: str = "value") -> DataFrame:
    """K5: the first place of a bare array, with coordinates as text; never exact. Replies without one fall out."""
    get = lambda path: F.try_variant_get(F.try_parse_json(column), f"$[0].{path}", "string")
    out = replies.withColumns({"longitude": get("lon").try_cast("double"), "latitude": get("lat").try_cast("double"), "matched_address": get("display_name"), "exact": F.lit(False)})
    return out.where("longitude is not null and latitude is not null").drop(column)
