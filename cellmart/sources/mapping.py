"""A source's declarative field mapping, compiled to one projection of a VARIANT column of raw records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmart.functions import text


def _typed(v: Column, name: str, kinds: tuple[str, ...], to: str) -> Column:
    """The field as a type, if its JSON type is one of kinds."""
    return text.let(F.variant_get(v, f"$.{name}", "variant"), lambda x: F.when(F.schema_of_variant(x).isin(*kinds), F.try_variant_get(x, "$", to)))


def string(v: Column, name: str) -> Column:
    """A JSON string; numbers and others don't count."""
    return _typed(v, name, ("STRING",), "string")


def number(v: Column, name: str) -> Column:
    """A JSON number, or a string that holds one."""
    return F.try_variant_get(v, f"$.{name}", "string").try_cast("double")


def boolean(v: Column, name: str) -> Column:
    return _typed(v, name, ("BOOLEAN",), "boolean")


def identifier(v: Column, names: tuple[str, ...]) -> Column:
    """The first field that is a filled string or an integer."""
    one = lambda n: F.nullif(_typed(v, n, ("STRING", "BIGINT"), "string"), F.lit(""))
    return F.coalesce(*[one(n) for n in names])


@dataclass(frozen=True)
class Source:
    """Which fields hold what. date: (kind, fields); arrest: (kind, field, text); coordinates: (kind, fields)."""

    id: str
    ids: tuple[str, ...]
    types: tuple[str, ...]
    date: tuple[str, tuple[str, ...]] | None = None
    coordinates: tuple[str, tuple[str, ...]] | None = None
    description: tuple[str, tuple[str, ...]] = ("first", ())
    address: tuple[str, tuple[str, ...]] = ("first", ())
    separator: str = " - "
    arrest: tuple[str, str, str] | None = None
    domestic: str | None = None
    location_type: str | None = None
    city: str | None = None
    state: str | None = None
    city_field: str | None = None
    states: tuple[str, ...] = field(default=())

    def _texts(self, v: Column, how: tuple[str, tuple[str, ...]], separator: str) -> Column:
        kind, names = how
        if not names:
            return F.lit(None).cast("string")
        found = [string(v, n) for n in names]
        return text.joined(separator, *found) if kind == "join" else text.first_filled(*found)

    def _date(self, v: Column) -> Column:
        if not self.date:
            return F.lit(None).cast("timestamp")
        kind, n = self.date
        if kind == "epoch_ms":
            return text.timestamp_ms(number(v, n[0]))
        if kind == "mdy":
            return text.timestamp_mdy(string(v, n[0]))
        if kind == "hhmm":
            return text.timestamp_hhmm(string(v, n[0]), string(v, n[1]))
        if kind == "hhmmss":
            return text.timestamp_hhmmss(string(v, n[0]), string(v, n[1]))
        return text.timestamp(string(v, n[0]))

    def _coordinates(self, v: Column) -> Column:
        """C6, C7."""
        if not self.coordinates:
            none = F.lit(None).cast("double")
            return text.coordinates(none, none)
        kind, n = self.coordinates
        if kind == "point":
            return text.coordinates(number(v, f"{n[0]}.coordinates[0]"), number(v, f"{n[0]}.coordinates[1]"))
        if kind == "location":
            return text.coordinates(number(v, f"{n[0]}.longitude"), number(v, f"{n[0]}.latitude"))
        return text.coordinates(number(v, n[0]), number(v, n[1]))

    def _arrest(self, v: Column) -> Column:
        """C10."""
        if not self.arrest:
            return F.lit(None).cast("boolean")
        kind, name, part = self.arrest
        return boolean(v, name) if kind == "bool" else F.lower(string(v, name)).contains(part.lower())


def normalize(raw: DataFrame, s: Source, column: str = "record", keep: tuple[str, ...] = ()) -> DataFrame:
    """Canonical records and columns to keep as they are; those without an id fall out."""
    v = F.col(column)
    null = F.lit(None)
    rows = raw.select(
        identifier(v, s.ids).alias("source_incident_id"), text.classify(text.first_filled(*[string(v, n) for n in s.types])).alias("subcategory"),
        s._date(v).alias("occurred_at"), s._coordinates(v).alias("at"), s._texts(v, s.description, s.separator).alias("description"),
        s._texts(v, s.address, " ").alias("block_address"), F.coalesce(string(v, s.city_field) if s.city_field else null.cast("string"), F.lit(s.city)).alias("city"),
        F.lit(s.state).alias("state"), s._arrest(v).alias("arrest_made"), (boolean(v, s.domestic) if s.domestic else null.cast("boolean")).alias("domestic"),
        (string(v, s.location_type) if s.location_type else null.cast("string")).alias("location_type"), *keep)
    placed = F.col("at.longitude").isNotNull()
    return rows.where("source_incident_id is not null").select(
        F.lit(s.id).alias("source_id"), "source_incident_id", "subcategory", text.category_of(F.col("subcategory")).alias("category"), text.severity_of(F.col("subcategory")).alias("severity"),
        F.coalesce("at.longitude", F.lit(0.0)).alias("longitude"), F.coalesce("at.latitude", F.lit(0.0)).alias("latitude"), "occurred_at", "description", "block_address",
        "city", "state", "arrest_made", "domestic", "location_type", placed.alias("has_coordinates"), F.lit(False).alias("geocoded"), *keep)
