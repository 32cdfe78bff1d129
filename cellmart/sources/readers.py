"""Readers of captured pages: each gives one VARIANT column `record`, a row per record."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmart.functions.text import strip_html


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as VARIANT `page`; text that is no JSON falls out."""
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("page")).where("page is not null")


def records(found: DataFrame, path: str = "$") -> DataFrame:
    """The records of an array at a path of each page: $ for bare arrays, $.rows, $.result.records, $.value."""
    items = F.try_variant_get("page", path, "array<variant>")
    return found.select(F.explode(items).alias("record"))


def next_cursor(page: Column) -> Column:
    """The cursor of a page by its usual names."""
    return F.coalesce(*[F.nullif(F.try_variant_get(page, f"$.{n}", "string"), F.lit("")) for n in ("cursor", "next_cursor", "nextCursor", "next")])


def features(found: DataFrame) -> DataFrame:
    """A2: feature services: the attributes with _geometry_x and _geometry_y among them."""
    f = records(found, "$.features").withColumnRenamed("record", "f")
    a = F.from_json(F.to_json(F.variant_get("f", "$.attributes", "variant")), "map<string,string>")
    raw = F.variant_get("f", "$.attributes", "variant")
    x, y = F.try_variant_get("f", "$.geometry.x", "double"), F.try_variant_get("f", "$.geometry.y", "double")
    joined = F.concat(F.regexp_replace(F.to_json(raw), r"\}$", ""), F.when(F.size(a) > 0, ",").otherwise(""), F.lit('"_geometry_x":'), F.coalesce(x.cast("string"), F.lit("null")), F.lit(',"_geometry_y":'), F.coalesce(y.cast("string"), F.lit("null")), F.lit("}"))
    return f.select(F.try_parse_json(joined).alias("record")).where("record is not null")


def flat_records(raw: DataFrame, part: str, path: str, prefix: str, plain: tuple[str, ...] = ()) -> DataFrame:
    """The field `part` gives way to the fields of the object at `path` in it, prefixed but for the plain ones; a field that
    stands at the top keeps its value."""
    whole = F.try_variant_get("record", "$", "map<string,variant>")
    inner = F.coalesce(F.try_variant_get("record", f"$.{part}.{path}", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    rows = raw.select(F.map_filter(whole, lambda k, _: k != part).alias("top"), F.transform_keys(inner, lambda k, _: F.when(k.isin(*plain), k).otherwise(F.concat(F.lit(prefix), k))).alias("own"))
    own = F.map_filter("own", lambda k, _: ~F.map_contains_key("top", k))
    return rows.where("top is not null").select(F.to_variant_object(F.map_concat("top", own)).alias("record"))


def point_records(raw: DataFrame, point: str, longitude: str, latitude: str, narrative: str) -> DataFrame:
    """A10: the GeoJSON point in a field becomes two fields, if it has both numbers; a narrative loses line-break tags and
    control characters but newlines, and is empty where it is no text."""
    whole = F.try_variant_get("record", "$", "map<string,variant>")
    at = lambda i: F.try_variant_get("record", f"$.{point}.coordinates[{i}]", "double")
    v = F.try_variant_get("record", f"$.{narrative}", "variant")
    words = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("record", f"$.{narrative}", "string")).otherwise("")
    words = F.regexp_replace(F.regexp_replace(words, "<br ?/>|<br>", " "), r"[\x00-\x09\x0B-\x1F\x7F-\x9F]", "")
    texts = F.when(v.isNotNull(), F.create_map(F.lit(narrative), words)).otherwise(F.create_map().cast("map<string,string>"))
    places = F.when(at(0).isNotNull() & at(1).isNotNull(), F.create_map(F.lit(longitude), at(0), F.lit(latitude), at(1))).otherwise(F.create_map().cast("map<string,double>"))
    cast = lambda m: F.transform_values(m, lambda _, x: x.cast("variant"))
    rows = raw.select(F.map_filter(whole, lambda k, _: ~k.isin(point, narrative, longitude, latitude)).alias("top"), cast(texts).alias("texts"), cast(places).alias("places"))
    return rows.where("top is not null").select(F.to_variant_object(F.map_concat("top", "texts", "places")).alias("record"))


def csv_records(spark: SparkSession, path: str, separator: str = ",", limit: int | None = None) -> DataFrame:
    """All values as trimmed strings, missing ones empty."""
    df = spark.read.csv(path, header=True, sep=separator, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    df = df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in df.columns])
    df = df.limit(limit) if limit is not None else df
    return df.select(F.parse_json(F.to_json(F.struct("*"))).alias("record"))


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_rows(html: str | None) -> list[dict[str, str]]:
    """The rows of the tables in a page, under the first row's names; missing cells are empty."""
    p = _Tables()
    p.feed(html or "")
    p.close()
    if not p.rows:
        return []
    head = p.rows[0]
    return [dict(zip(head, r + [""] * (len(head) - len(r)), strict=False)) for r in p.rows[1:] if r]


def html_tables(df: DataFrame, column: str = "html") -> DataFrame:
    """(record) of every table row, page by page in Arrow batches."""
    import json

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"json": pa.array([json.dumps(r) for h in b.column(0).to_pylist() for r in table_rows(h)], pa.string())})

    return df.select(column).mapInArrow(work, "json string").select(F.parse_json("json").alias("record"))


def regex_rows(lines: DataFrame, pattern: str, names: list[str], column: str = "value") -> DataFrame:
    """Lines that match, with the pattern's groups as fields."""
    return lines.where(F.col(column).rlike(pattern)).select(*[F.trim(F.regexp_extract(column, pattern, i + 1)).alias(n) for i, n in enumerate(names)])


def fixed_columns(lines: DataFrame, columns: dict[str, tuple[int, int]], column: str = "value") -> DataFrame:
    """Fields by place (from 0, length), trimmed; blank lines fall out."""
    return lines.where(F.trim(column) != "").select(*[F.trim(F.substring(F.col(column), a + 1, n)).alias(k) for k, (a, n) in columns.items()])


def delimited(lines: DataFrame, names: list[str], separator: str = r"\s{2,}", column: str = "value") -> DataFrame:
    """Fields between separators; lines with fewer fields fall out."""
    parts = F.split(F.trim(column), separator)
    return lines.where(F.size(parts) >= len(names)).select(*[F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)])


def windows(since: Column, until: Column, days: int) -> Column:
    """An array of (start, stop) of at most so many days; the last one ends at until."""
    starts = F.sequence(since, until, F.expr(f"interval {days} days"))
    return F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + F.expr(f"interval {days} days"), until).alias("stop"))), lambda w: w["start"] < w["stop"])


def monthly_urls(template: str, since: Column, until: Column) -> Column:
    """The template with {yyyy} and {MM} of each month, both ends included."""
    months = F.sequence(F.trunc(since, "month"), F.trunc(until, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.replace(F.replace(F.lit(template), F.lit("{yyyy}"), F.date_format(m, "yyyy")), F.lit("{MM}"), F.date_format(m, "MM")))


def boundaries(found: DataFrame) -> DataFrame:
    """Boundary attributes of feature pages: square metres to miles, centres as text or number; rows without an id fall out."""
    from cellmart.model import SQ_METRES_PER_SQ_MILE

    f = records(found, "$.features").withColumnRenamed("record", "f")
    get = lambda n: F.try_variant_get("f", f"$.properties.{n}", "string")
    out = f.select(get("GEOID").alias("geoid"), get("NAME").alias("name"), F.substring(get("GEOID"), 1, 2).alias("state_fips"), (get("AREALAND").try_cast("double") / SQ_METRES_PER_SQ_MILE).alias("land_area_sq_mi"), get("CENTLON").try_cast("double").alias("centroid_lon"), get("CENTLAT").try_cast("double").alias("centroid_lat"), F.to_json(F.variant_get("f", "$.geometry", "variant")).alias("boundary_geojson"))
    return out.where("geoid is not null and geoid <> '' and boundary_geojson is not null and boundary_geojson <> 'null'")


def with_population(areas: DataFrame, table: DataFrame, id_columns: tuple[int, ...]) -> DataFrame:
    """Population from arrays of strings (value first, id parts at id_columns) by id; the header has no number and falls out."""
    p = table.select(F.col("row")[0].try_cast("int").alias("_population"), F.concat(*[F.col("row")[i] for i in id_columns]).alias("_geoid")).where("_population is not null")
    return areas.join(p, areas["geoid"] == p["_geoid"], "left").drop("_geoid").withColumn("population", F.coalesce("_population", *(["population"] if "population" in areas.columns else []))).drop("_population")


def with_county_names(tracts: DataFrame, counties: DataFrame) -> DataFrame:
    """A22."""
    c = counties.select("state_fips", "county_fips", F.col("name").alias("_county"))
    return tracts.join(c, ["state_fips", "county_fips"], "left").withColumn("county_name", F.coalesce("_county", "county_name")).drop("_county")


def bulletin_entries(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (page, place, html) in order: a bold underlined one names the type, a bold one the city, others are entries."""
    from pyspark.sql import Window

    w = Window.partitionBy("page").orderBy("place")
    head, city = F.col("html").rlike(r"(?i)<strong>\s*<u>|<u>\s*<strong>"), F.col("html").rlike(r"(?i)<strong>") & ~F.col("html").rlike("(?i)<u>")
    clean = strip_html(F.col("html"))
    rows = paragraphs.select("page", "place", clean.alias("entry"), F.when(head, clean).alias("t"), F.when(city, clean).alias("c"), (head | city).alias("skip"))
    rows = rows.withColumns({"crime_type": F.last("t", ignorenulls=True).over(w), "city": F.last("c", ignorenulls=True).over(w)})
    rows = rows.where("not skip and entry <> '' and crime_type is not null")
    return rows.select("page", "crime_type", "city", "entry", F.concat(F.lit("B-"), F.lpad(F.hex(F.xxhash64("page", "crime_type", "city", "entry")), 16, "0")).alias("id"))


def release_date(body: Column) -> Column:
    """The first date in words or figures of a text."""
    words = F.regexp_extract(body, r"(?i)\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})", 1)
    figures = F.regexp_extract(body, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1)
    spelled = F.try_to_timestamp(F.initcap(F.regexp_replace(words, ",", "")), F.lit("MMMM d yyyy"))
    return F.coalesce(F.when(words != "", spelled), F.when(figures != "", F.try_to_timestamp(figures, F.lit("M/d/yyyy"))))


def release_address(body: Column) -> Column:
    """The first block or street address of a text."""
    found = F.regexp_extract(body, r"\b(\d+\s+(?:block\s+of\s+)?(?:[NSEW]\.?\s+)?[A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*\s+(?:Street|Avenue|Road|Drive|Lane|Boulevard|Court|Place|Way|St|Ave|Rd|Dr|Ln|Blvd|Ct|Pl))\b", 1)
    return F.nullif(found, F.lit(""))


def select_sources(registry: DataFrame, ids: list[str] | None = None, states: list[str] | None = None, restricted: bool = False) -> DataFrame:
    """Registry (id, state, restricted) by ids and states (FIPS codes); restricted sources only on request."""
    from cellmart.model import STATES

    out = registry if restricted else registry.where("not restricted")
    out = out.where(F.col("id").isin(ids)) if ids else out
    return out.where(F.col("state").isin([STATES.get(s, s) for s in states])) if states else out
