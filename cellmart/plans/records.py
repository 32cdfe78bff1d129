"""Registered queries of sources, mappings, stores, geocoding, attribution and streams over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmart.functions import text
from cellmart.operators import api, conversations, cubes, geocode, spatial, store
from cellmart.plans import incidents as inc
from cellmart.plans.registry import query
from cellmart.sources import mapping, readers
from cellmart.streaming import ingest

I = f"WITH i AS ({inc.SQL})"  # noqa: E741
S = lambda x: F.col(x).cast("string")


def _struct(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


# Sources


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, round(CAST(c_nationkey AS DOUBLE), 6) AS x, CASE WHEN c_custkey % 3 <> 0 THEN round(c_acctbal, 6) END AS y FROM customer")
def feature_records(spark, d):
    """A2, A3: pages of features, three thirds of the table."""
    k = F.col("c_custkey")
    feature = F.struct(F.struct(S("c_custkey").alias("id")).alias("attributes"), F.struct(F.col("c_nationkey").alias("x"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("y")).alias("geometry"))
    page = F.parse_json(F.to_json(F.struct(F.array(feature).alias("features")))).alias("page")
    rows = readers.features(inc.table(spark, d, "customer").select(page))
    v = F.col("record")
    return rows.select(mapping.string(v, "id").alias("id"), mapping.number(v, "_geometry_x").alias("x"), F.round(mapping.number(v, "_geometry_y"), 6).alias("y"))


@query("""SELECT 'rows' AS path, s_suppkey AS id, n AS place FROM supplier, (VALUES (1), (2)) AS t(n) UNION ALL SELECT 'records', s_suppkey, n FROM supplier, (VALUES (1), (2)) AS t(n) WHERE n <= s_suppkey % 3""")
def paged_records(spark, d):
    """Arrays at two paths of a page, one of them empty at times."""
    k = F.col("s_suppkey")
    one = lambda n: F.struct(k.alias("id"), F.lit(n).alias("place"))
    both = F.array(one(1), one(2))
    page = F.to_json(F.struct(both.alias("rows"), F.struct(F.filter(both, lambda r: r["place"] <= k % 3).alias("records")).alias("result")))
    pages = inc.table(spark, d, "supplier").select(F.parse_json(page).alias("page"))
    out = [readers.records(pages, p).select(F.lit(n).alias("path"), F.try_variant_get("record", "$.id", "long").alias("id"), F.try_variant_get("record", "$.place", "int").alias("place")) for n, p in (("rows", "$.rows"), ("records", "$.result.records"))]
    return out[0].unionByName(out[1])


@query("SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'a' WHEN 2 THEN 'b' WHEN 3 THEN 'c' ELSE 'd' END AS cursor FROM orders")
def page_cursors(spark, d):
    """A8."""
    k = F.col("o_orderkey") % 5
    at = lambda i, v: F.when(k == i, v)
    page = _struct(cursor=at(1, "a"), next_cursor=at(2, "b"), nextCursor=at(3, "c"), next=F.when(k == 0, "").when(k == 4, "d"))
    return inc.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), readers.next_cursor(F.parse_json(page)).alias("cursor"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'Arson' AS Crime, c_mktsegment AS unit, CAST(c_custkey AS VARCHAR) AS case_no, 'top' AS kept FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), NULL, NULL, NULL, 'top' FROM customer WHERE c_custkey % 2 <> 0")
def nested_records(spark, d):
    """A11."""
    k = F.col("c_custkey")
    inner = F.struct(F.struct(F.struct(F.lit("Arson").alias("Crime"), F.col("c_mktsegment").alias("Unit"), S("c_custkey").alias("No"), F.lit("nested").alias("LocationType")).alias("MO")).alias("MOs"))
    raw = F.to_json(F.struct(S("c_custkey").alias("id"), F.lit("top").alias("LocationType"), F.when(k % 2 == 0, inner).alias("EventRecord")))
    rows = readers.flat_records(inc.table(spark, d, "customer").select(F.parse_json(raw).alias("record")), "EventRecord", "MOs.MO", "_mo_", ("Crime", "LocationType"))
    v = F.col("record")
    return rows.select(*[mapping.string(v, a).alias(b) for a, b in (("id", "id"), ("Crime", "Crime"), ("_mo_Unit", "unit"), ("_mo_No", "case_no"), ("LocationType", "kept"))])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS DOUBLE) END AS x, CASE WHEN s_suppkey % 2 = 0 THEN CAST(40.5 AS DOUBLE) END AS y, concat('a b', s_name, chr(10)) AS narrative FROM supplier")
def point_records(spark, d):
    """A10."""
    k = F.col("s_suppkey")
    x = F.col("s_nationkey").cast("double")
    raw = F.to_json(F.struct(S("s_suppkey").alias("id"), F.struct(F.when(k % 2 == 0, F.array(x, F.lit(40.5))).otherwise(F.array(x)).alias("coordinates")).alias("location"), F.concat(F.lit("a<br />b\t"), "s_name", F.lit("\n")).alias("narrative")))
    rows = readers.point_records(inc.table(spark, d, "supplier").select(F.parse_json(raw).alias("record")), "location", "_x", "_y", "narrative")
    v = F.col("record")
    return rows.select(mapping.string(v, "id").alias("id"), mapping.number(v, "_x").alias("x"), mapping.number(v, "_y").alias("y"), mapping.string(v, "narrative").alias("narrative"))


@query("SELECT 'regex' AS form, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'fixed', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL SELECT 'delimited', CAST(s_suppkey AS VARCHAR), s_name FROM supplier")
def text_rows(spark, d):
    """Three forms of text lines."""
    s = inc.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    line = lambda x: s.select(x.alias("value"))
    forms = {
        "regex": readers.regex_rows(line(F.concat(F.when(k % 2 == 0, "No. ").otherwise("??? "), S("s_suppkey"), F.lit(": "), "s_name")), r"^No\. (\d+): (.*)$", ["id", "name"]),
        "fixed": readers.fixed_columns(line(F.concat(F.rpad(S("s_suppkey"), 12, " "), "s_name")), {"id": (0, 12), "name": (12, 60)}),
        "delimited": readers.delimited(line(F.concat(F.lit("  "), S("s_suppkey"), F.lit("    "), "s_name")), ["id", "name"]),
    }
    out = [rows.select(F.lit(n).alias("form"), "id", "name") for n, rows in forms.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT n_nationkey AS id, concat('u/', strftime(DATE '2020-01-01' + to_months(CAST(m AS INT)), '%Y/%m')) AS url FROM (SELECT n_nationkey, unnest(range(0, n_nationkey + 1)) AS m FROM nation)")
def monthly_urls(spark, d):
    """A15."""
    since = F.lit("2020-01-15").cast("date")
    return inc.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.explode(readers.monthly_urls("u/{yyyy}/{MM}", since, F.add_months(since, F.col("n_nationkey")))).alias("url"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey % 4 <> 0")
def selected_sources(spark, d):
    """States by their codes; restricted ones stay out."""
    n = F.col("n_nationkey")
    registry = inc.table(spark, d, "nation").select(S("n_nationkey").alias("id"), F.element_at(F.array(*map(F.lit, ("AK", "AL", "AZ", "AR", "CA"))), F.col("n_regionkey") + 1).alias("state"), (n % 4 == 0).alias("restricted"))
    return readers.select_sources(registry, states=["01", "04"]).select("id")


@query("""SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS geoid, substr(lpad(CAST(s_suppkey AS VARCHAR), 12, '0'), 1, 2) AS state_fips, s_name AS name, round(CAST(s_suppkey AS DOUBLE) * 1000000 / CAST(2589988.11 AS DOUBLE), 4) AS land,
  CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey * 10 AS INT) END AS population, CASE WHEN s_suppkey % 3 = 0 THEN 'C' ELSE 'own' END AS county_name FROM supplier""")
def boundary_records(spark, d):
    """Boundaries of feature pages with population and county names."""
    s = inc.table(spark, d, "supplier")
    k, geoid = F.col("s_suppkey"), F.lpad(S("s_suppkey"), 12, "0")
    f = F.struct(F.struct(geoid.alias("GEOID"), F.col("s_name").alias("NAME"), (k * 1000000).alias("AREALAND"), F.lit("+1.5").alias("CENTLON"), F.lit("2").alias("CENTLAT")).alias("properties"), F.struct(F.lit("Polygon").alias("type")).alias("geometry"))
    areas = readers.boundaries(s.select(F.parse_json(F.to_json(F.struct(F.array(f).alias("features")))).alias("page")))
    people = s.where(k % 2 == 0).select(F.array((k * 10).cast("string"), F.substring(geoid, 1, 2), F.substring(geoid, 3, 10)).alias("row"))
    areas = readers.with_population(areas, people, (1, 2)).withColumns({"county_fips": F.substring("geoid", 3, 10), "county_name": F.lit("own")})
    counties = s.where(k % 3 == 0).select(F.substring(geoid, 1, 2).alias("state_fips"), F.substring(geoid, 3, 10).alias("county_fips"), F.lit("C").alias("name"))
    return readers.with_county_names(areas, counties).select("geoid", "state_fips", "name", F.round("land_area_sq_mi", 4).alias("land"), "population", "county_name")


@query("""SELECT n_regionkey AS page, concat('TYPE ', CAST(n_regionkey AS VARCHAR)) AS crime_type, CASE WHEN r > 1 THEN concat('CITY ', first) END AS city, n_name AS entry
FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS first FROM nation)""")
def bulletin_entries(spark, d):
    """The city stands behind each region's first entry."""
    n = inc.table(spark, d, "nation")
    k = F.col("n_nationkey")
    first = n.groupBy("n_regionkey").agg(F.min_by("n_name", "n_nationkey").alias("name"), F.min("n_nationkey").alias("at"))
    row = lambda df, at, html: df.select(F.col("n_regionkey").alias("page"), at.alias("place"), html.alias("html"))
    p = row(n, k * 10, F.concat(F.lit("<p>"), "n_name", F.lit("</p>")))
    p = p.unionByName(row(first, F.lit(-5), F.concat(F.lit("<strong><u>TYPE "), S("n_regionkey"), F.lit("</u></strong>"))))
    p = p.unionByName(row(first, F.col("at") * 10 + 5, F.concat(F.lit("<strong>CITY "), "name", F.lit("</strong>"))))
    return readers.bulletin_entries(p).select("page", "crime_type", "city", "entry")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, concat(CAST(o_orderkey AS VARCHAR), ' block of N Main Street') AS address FROM orders")
def release_fields(spark, d):
    """Dates in words or figures."""
    o = inc.table(spark, d, "orders")
    k = F.col("o_orderkey")
    shown = F.when(k % 2 == 0, F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    body = F.concat(F.lit("On "), shown, F.lit(" in the "), S("o_orderkey"), F.lit(" block of N Main Street, police said."))
    return o.select(k.alias("id"), F.date_format(readers.release_date(body), "yyyy-MM-dd").alias("day"), readers.release_address(body).alias("address"))


# Column functions


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 4 WHEN 0 THEN ' 13:45' WHEN 1 THEN ' 00:00' WHEN 3 THEN ' 00:00' END AS hhmm, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' 07:08:09' ELSE ' 00:00:00' END AS hhmmss,
  strftime(o_orderdate, '%Y-%m-%d') AS mdy, strftime(o_orderdate, '%Y-%m-%d') AS ms FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS o_orderdate FROM orders)""")
def source_timestamps(spark, d):
    """C4: a four-digit time, one that is none, a time of another length, none at all."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    four = F.when(k % 4 == 0, "1345").when(k % 4 == 1, "945").when(k % 4 == 2, "2575")
    out = {
        "hhmm": F.date_format(text.timestamp_hhmm(day, four), "yyyy-MM-dd HH:mm"), "hhmmss": F.date_format(text.timestamp_hhmmss(day, F.when(k % 2 == 0, "7:08:09").otherwise("25:00:00")), "yyyy-MM-dd HH:mm:ss"),
        "mdy": F.date_format(text.timestamp_mdy(F.date_format("o_orderdate", "MM/dd/yyyy")), "yyyy-MM-dd"), "ms": F.date_format(text.timestamp_ms(F.unix_millis(day.cast("timestamp"))), "yyyy-MM-dd"),
    }
    return inc.table(spark, d, "orders").select(k.alias("id"), *[v.alias(n) for n, v in out.items()])


_X, _Y = "CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 181 WHEN 2 THEN NULL ELSE -87.5 END", "CASE c_custkey % 7 WHEN 0 THEN -91 WHEN 1 THEN 0 ELSE 41.5 END"


@query(f"SELECT id, CAST(CASE WHEN ok THEN x END AS DOUBLE) AS longitude, CAST(CASE WHEN ok THEN y END AS DOUBLE) AS latitude FROM (SELECT *, x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 AND x <> 0 AND y <> 0 AS ok FROM (SELECT c_custkey AS id, {_X} AS x, {_Y} AS y FROM customer))")
def checked_coordinates(spark, d):
    """As a point, as a location and as a pair; all three must agree."""
    c = inc.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(_X).cast("double").alias("x"), F.expr(_Y).cast("double").alias("y"))
    raw = F.to_json(F.struct(F.struct(F.array("x", "y").alias("coordinates")).alias("p"), F.struct(S("x").alias("longitude"), S("y").alias("latitude")).alias("l"), "x", "y"))
    rows = c.select("id", F.parse_json(raw).alias("record"))
    forms = [mapping.Source("s", ("id",), ("t",), coordinates=f)._coordinates(F.col("record")) for f in (("point", ("p",)), ("location", ("l",)), ("pair", ("x", "y")))]
    rows = rows.select("id", *[f.alias(n) for f, n in zip(forms, "abc", strict=True)]).where("a <=> b and b <=> c")
    return rows.select("id", "a.longitude", "a.latitude")


@query("""SELECT o_orderkey AS id, coalesce(a, b) AS first, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE concat_ws(' - ', a, b) END AS joined, CASE WHEN o_orderkey % 3 <> 0 THEN contains(lower(o_orderpriority), 'urg') END AS arrest
FROM (SELECT *, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS b FROM orders)""")
def filled_fields(spark, d):
    """Empty text counts as missing."""
    k = F.col("o_orderkey")
    raw = _struct(a=F.when(k % 3 == 1, F.col("o_orderpriority")).when(k % 3 == 2, ""), b=F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(""), c=F.when(k % 3 != 0, F.col("o_orderpriority")))
    rows = inc.table(spark, d, "orders").select(k.alias("id"), F.parse_json(raw).alias("record"))
    s, v = mapping.Source("s", ("id",), ("t",), arrest=("contains", "c", "URG")), F.col("record")
    return rows.select("id", s._texts(v, ("first", ("a", "b")), "").alias("first"), s._texts(v, ("join", ("a", "b")), " - ").alias("joined"), s._arrest(v).alias("arrest"))


@query("""SELECT c_custkey AS id, trim(regexp_replace(lower(concat(' ', c_name, '--', c_mktsegment, '!')), '[^a-z0-9]+', '_', 'g'), '_') AS slug, concat_ws(', ', c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, 'IL') AS full_name,
  CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 2 THEN substr(CAST(c_custkey AS VARCHAR), 1, 2) END AS state FROM customer""")
def names_and_prefixes(spark, d):
    """C16-C18."""
    k = F.col("c_custkey")
    return inc.table(spark, d, "customer").select(k.alias("id"), text.slug(F.concat(F.lit(" "), "c_name", F.lit("--"), "c_mktsegment", F.lit("!"))).alias("slug"), text.tract_full_name(F.col("c_name"), F.when(k % 2 == 0, F.col("c_mktsegment")), F.lit("IL")).alias("full_name"), text.geoid_prefix(S("c_custkey"), 2).alias("state"))


# Stores


def _stored(spark, d):
    return inc.incidents(spark, d).withColumns({"geocoded": F.lit(False), "enriched": F.col("tract_geoid").isNotNull(), "census_tract_geoid": F.col("tract_geoid"), "has_coordinates": F.col("has_coordinates")})


_OWN = "CAST(source_incident_id AS BIGINT)"


@query(f"{I} SELECT source_incident_id, round(CASE WHEN {_OWN} % 2 = 0 THEN -1 ELSE longitude END, 6) AS longitude, {_OWN} % 2 = 0 OR has_coordinates AS has_coordinates, {_OWN} % 2 = 0 AS geocoded, {_OWN} % 2 <> 0 AND tract_geoid IS NOT NULL AS enriched FROM i")
def coordinate_update(spark, d):
    """Half the rows are placed anew and lose their attribution."""
    rows = _stored(spark, d)
    found = rows.where(F.col("source_incident_id").cast("long") % 2 == 0).select("source_incident_id", F.lit(-1.0).alias("longitude"), F.lit(2.0).alias("latitude"))
    out = store.update_coordinates(rows, found, True)
    return out.select("source_incident_id", F.round("longitude", 6).alias("longitude"), "has_coordinates", "geocoded", "enriched")


@query(f"{I} SELECT source_incident_id, {_OWN} % 5 = 0 AS geocoded, CASE WHEN {_OWN} % 3 = 0 THEN 'new' ELSE tract_geoid END AS tract, {_OWN} % 3 = 0 OR tract_geoid IS NOT NULL AS enriched FROM i")
def marks_and_attribution(spark, d):
    """B4, B5; ids to mark may repeat."""
    rows = _stored(spark, d)
    own = F.col("source_incident_id").cast("long")
    ids = rows.where(own % 5 == 0).select("source_incident_id")
    out = store.mark_geocoded(rows, ids.unionByName(ids))
    out = store.update_attribution(out, rows.where(own % 3 == 0).select("source_incident_id", F.lit("new").alias("census_tract_geoid")))
    return out.select("source_incident_id", "geocoded", F.col("census_tract_geoid").alias("tract"), "enriched")


@query(f"{I} SELECT source_id, CAST(count(*) AS BIGINT) AS cnt FROM i WHERE has_coordinates AND tract_geoid IS NULL GROUP BY 1")
def unenriched_sources(spark, d):
    """D7."""
    return store.unenriched(_stored(spark, d))


@query(f"{I} SELECT source_incident_id AS id, 'Point' AS type, round(longitude, 6) AS x, round(latitude, 6) AS y, city FROM i WHERE has_coordinates")
def geojson_features(spark, d):
    """The written lines, read again."""
    lines = store.geojson_lines(cubes.exportable(inc.incidents(spark, d)), ["source_incident_id", "city"])
    get = lambda p: F.get_json_object("value", p)
    return lines.select(get("$.properties.source_incident_id").alias("id"), get("$.geometry.type").alias("type"), *[F.round(get(f"$.geometry.coordinates[{i}]").cast("double"), 6).alias(n) for i, n in enumerate("xy")], get("$.properties.city").alias("city"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_nationkey AS DOUBLE) AS west FROM nation WHERE n_nationkey % 3 <> 0")
def boundary_features(spark, d):
    """Boundaries without a shape fall out."""
    n = F.col("n_nationkey")
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.array(F.array(n.cast("double"), F.lit(0.0)))).alias("coordinates")))
    rows = inc.table(spark, d, "nation").select(S("n_nationkey").alias("geoid"), F.col("n_name").alias("name"), F.when(n % 3 != 0, shape).alias("boundary_geojson"))
    get = lambda p: F.get_json_object("value", p)
    return store.boundary_lines(rows, ["geoid", "name"]).select(get("$.properties.geoid").alias("id"), get("$.properties.name").alias("name"), get("$.geometry.coordinates[0][0][0]").cast("double").alias("west"))


@query(f"{I} SELECT string_agg(DISTINCT city, ',' ORDER BY city) AS cities, strftime(min(occurred_at), '%Y-%m-%d') AS first_day, strftime(max(occurred_at), '%Y-%m-%d') AS last_day, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources FROM i")
def merged_metadata(spark, d):
    """I4."""
    rows = inc.incidents(spark, d).select("city", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "source_id")
    out = cubes.merge_metadata([rows.where("source_id < 'src_2'"), rows.where("source_id >= 'src_2'")])
    return out.select(F.array_join("cities", ",").alias("cities"), "first_day", "last_day", F.array_join("sources", ",").alias("sources"))


# Geocoding, attribution


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 2 = 0 AS exact, CAST(-80.5 AS DOUBLE) AS longitude, CAST(o_orderkey % 90 AS DOUBLE) AS latitude FROM orders WHERE o_orderkey % 3 <> 0")
def batch_replies(spark, d):
    """K3."""
    k = F.col("o_orderkey")
    q = lambda *x: F.concat(F.lit('"'), F.concat_ws('","', *x), F.lit('"'))
    hit = q(S("o_orderkey"), F.lit("1 A ST, B, IL"), F.lit("Match"), F.when(k % 2 == 0, "Exact").otherwise("Non_Exact"), F.lit("1 A ST"), F.concat(F.lit("-80.5,"), (k % 90).cast("string")))
    lines = inc.table(spark, d, "orders").select(F.when(k % 3 != 0, hit).otherwise(q(S("o_orderkey"), F.lit("?"), F.lit("No_Match"))).alias("value"))
    return geocode.parse_batch_reply(lines)


@query("""SELECT 'features' AS form, c_custkey AS id, CAST(c_nationkey AS DOUBLE) AS longitude, c_name AS found, c_custkey % 2 = 0 AS exact FROM customer WHERE c_custkey % 5 <> 0
UNION ALL SELECT 'places', c_custkey, CAST(c_nationkey AS DOUBLE), c_name, false FROM customer WHERE c_custkey % 5 <> 0""")
def service_replies(spark, d):
    """K4, K5: empty replies fall out."""
    k, x = F.col("c_custkey"), F.col("c_nationkey")
    f = F.struct(F.struct(F.array(x.cast("double"), F.lit(1.0)).alias("coordinates")).alias("geometry"), F.struct(F.col("c_name").alias("label"), F.when(k % 2 == 0, 0.9).when(k % 3 == 0, 0.5).alias("confidence")).alias("properties"))
    p = F.struct(x.cast("string").alias("lon"), F.lit("1").alias("lat"), F.col("c_name").alias("display_name"))
    listed = lambda one: F.when(k % 5 != 0, F.array(one)).otherwise(F.slice(F.array(one), 1, 0))
    c = inc.table(spark, d, "customer")
    a = geocode.feature_replies(c.select(k.alias("id"), F.to_json(F.struct(listed(f).alias("features"))).alias("value"))).withColumn("form", F.lit("features"))
    b = geocode.place_replies(c.select(k.alias("id"), F.to_json(listed(p)).alias("value"))).withColumn("form", F.lit("places"))
    return a.unionByName(b).select("form", "id", "longitude", F.col("matched_address").alias("found"), "exact")


@query("SELECT CAST(count(*) AS BIGINT) AS tried, CAST(count(*) FILTER (WHERE c_custkey % 3 <> 0) AS BIGINT) AS hits_a, CAST(count(*) FILTER (WHERE c_custkey % 2 = 0) AS BIGINT) AS hits_b, CAST(count(*) FILTER (WHERE c_custkey % 6 IN (2, 4) AND c_custkey % 5 = 0) AS BIGINT) AS agree FROM customer")
def provider_agreement(spark, d):
    """K8."""
    k = F.col("c_custkey")
    c = inc.table(spark, d, "customer")
    side = lambda p, hit, x: c.select(S("c_custkey").alias("address_key"), F.lit(p).alias("provider"), F.when(hit, x).alias("longitude"), F.when(hit, F.lit(1.0)).alias("latitude"))
    a, b = side("a", k % 3 != 0, F.lit(10.0)), side("b", k % 2 == 0, F.when(k % 5 == 0, 10.0005).otherwise(11.0)).where(k % 2 == 0)
    return geocode.compare_providers(a.unionByName(b), "a", "b")


@query("""WITH r AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'A and B' WHEN 1 THEN concat(CAST(c_custkey AS VARCHAR), ' OAK ST') END AS street FROM customer)
SELECT CAST(k AS VARCHAR) AS id, street IS NOT NULL AS geocoded, coalesce(street = 'A and B', false) AS placed, CAST((SELECT count(*) FROM r WHERE street LIKE '% OAK ST') * 2 + 1 AS BIGINT) AS entries FROM r""")
def geocode_write_back(spark, d):
    """Crossings are placed by the second service; the rest is marked, and both services' misses are kept."""
    k = F.col("c_custkey")
    address = F.when(k % 3 == 0, "a / b").when(k % 3 == 1, F.concat(S("c_custkey"), F.lit(" oak st")))
    rows = inc.table(spark, d, "customer").select(S("c_custkey").alias("source_incident_id"), F.lit(0.0).alias("longitude"), F.lit(0.0).alias("latitude"), F.lit(False).alias("has_coordinates"), F.lit(False).alias("geocoded"), address.alias("block_address"), F.lit("X").alias("city"), F.lit("IL").alias("state"))
    cache = spark.createDataFrame([], "address_key string, longitude double, latitude double, provider string")
    answer = lambda hit: lambda asked: asked.where(hit).select("address_key", F.lit(-1.0).alias("longitude"), F.lit(2.0).alias("latitude"))
    out, entries = geocode.geocode_into(rows, cache, [("one", 1, answer("street = 'A and B'")), ("two", 2, answer("false"))])
    n = entries.agg(F.count(F.lit(1)).alias("entries"))
    return out.crossJoin(F.broadcast(n)).select(F.col("source_incident_id").alias("id"), "geocoded", F.col("has_coordinates").alias("placed"), "entries")


def _squares(spark, d):
    """Squares of 0.0045 around each nation's corner, in a wider one, as tracts, places and neighbourhoods."""
    n = F.col("n_nationkey")
    x, y = (-120 + 2 * n).cast("double"), (25 + n).cast("double")
    ring = lambda a, b: F.array(*[F.array(x + p, y + q) for p, q in ((a, a), (b, a), (b, b), (a, b), (a, a))])
    shape = lambda a, b: F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring(a, b)).alias("coordinates")))
    t = inc.table(spark, d, "nation")
    part = lambda geoid, a, b: t.select(geoid.alias("geoid"), n.cast("double").alias("land_area_sq_mi"), shape(a, b).alias("boundary_geojson"), (x + 0.002).alias("centroid_lon"), (y + 0.002).alias("centroid_lat"))
    return part, n


_IN = "longitude > x + CAST({a} AS DOUBLE) AND longitude < x + CAST({b} AS DOUBLE) AND latitude > y + CAST({a} AS DOUBLE) AND latitude < y + CAST({b} AS DOUBLE)"


@query(f"""{I}, n AS (SELECT n_nationkey AS k, CAST(-120 + 2 * n_nationkey AS DOUBLE) AS x, CAST(25 + n_nationkey AS DOUBLE) AS y FROM nation),
h AS (SELECT source_incident_id, longitude, latitude, k, {_IN.format(a=-0.0005, b=0.0045)} AS inner_, {_IN.format(a=-0.0005, b=0.0065)} AS outer_ FROM (SELECT * FROM i WHERE has_coordinates) JOIN n ON abs(longitude - x) < 1 AND abs(latitude - y) < 0.5)
SELECT source_incident_id AS id, CASE WHEN inner_ THEN concat('17031', lpad(CAST(k AS VARCHAR), 6, '0')) END AS tract, CASE WHEN inner_ THEN '17' END AS state, CASE WHEN inner_ THEN '17031' END AS county, CASE WHEN outer_ THEN concat('p', CAST(k AS VARCHAR)) END AS place FROM h""")
def attributed(spark, d):
    """E6, C16."""
    part, n = _squares(spark, d)
    tracts, places = part(F.concat(F.lit("17031"), F.lpad(n.cast("string"), 6, "0")), -0.0005, 0.0045), part(F.concat(F.lit("p"), n.cast("string")), -0.0005, 0.0065)
    rows = cubes.exportable(inc.incidents(spark, d)).select("source_incident_id", "longitude", "latitude")
    return spatial.attribute(rows, "source_incident_id", tracts, places).select(F.col("source_incident_id").alias("id"), F.col("tract_geoid").alias("tract"), F.col("state_fips").alias("state"), F.col("county_geoid").alias("county"), F.col("place_geoid").alias("place"))


@query(f"""{I}, l AS ({inc.LINKS_SQL}), m AS (SELECT geoid, max(neighborhood_id) AS n FROM l GROUP BY 1) SELECT source_incident_id AS id, n AS neighborhood_id FROM i LEFT JOIN m ON tract_geoid = geoid""")
def incident_neighborhoods(spark, d):
    """E8."""
    _, links, _ = inc.dimensions(spark, d)
    return spatial.with_neighborhood(inc.incidents(spark, d), links).select(F.col("source_incident_id").alias("id"), "neighborhood_id")


@query("SELECT concat('t', CAST(n_nationkey AS VARCHAR)) AS geoid, concat('h', CAST(n_nationkey AS VARCHAR)) AS neighborhood_id FROM nation WHERE n_nationkey % 2 = 0")
def tract_crosswalk(spark, d):
    """E7."""
    part, n = _squares(spark, d)
    hoods = part(F.concat(F.lit("h"), n.cast("string")), 0.0, 0.01).where("land_area_sq_mi % 2 = 0").withColumnRenamed("geoid", "id")
    return spatial.crosswalk(part(F.concat(F.lit("t"), n.cast("string")), 0.0, 0.01), hoods)


# Map parameters, conversations, streams


@query("WITH v AS (SELECT unnest(range(0, 20)) AS zoom) SELECT CAST(zoom AS INT) AS zoom, CASE WHEN zoom < 8 THEN 'heatmap' WHEN zoom < 13 THEN 'hexagons' ELSE 'points' END AS layer, zoom * 50 + 50 < 500 AS has_more FROM v")
def zoom_layers(spark, d):
    """The layer of each zoom, and whether a further page follows."""
    return spark.createDataFrame([(z, api.layer(z), api.has_more(z * 50, 50, 500)) for z in range(20)], "zoom int, layer string, has_more boolean")


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT conv_id, turn, role, 'new' FROM conversations WHERE conv_id % 3 = 0 AND turn = 0")
def conversation_save(spark, d):
    """M1."""
    rows = inc.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.save(rows, rows.where("conv_id % 3 = 0 and turn = 0").withColumn("text", F.lit("new")))


@query("SELECT turn, role, text FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def conversation_messages(spark, d):
    """M3."""
    rows = inc.table(spark, d, "conversations")
    return conversations.load(rows, rows.agg(F.min("conv_id")).first()[0])


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (WHERE o_orderstatus = 'X') AS BIGINT) AS X FROM orders")
def status_counts(spark, d):
    """F20."""
    return conversations.status_counts(inc.table(spark, d, "orders"), ("F", "O", "X"), "o_orderstatus")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'LARCENY_THEFT' ELSE 'ARSON' END AS subcategory FROM orders")
def stream_upsert(spark, d):
    """L1-L3: pages of all orders, then pages that repeat half of them with another type, through the stream into a versioned store."""
    at = store.scratch(spark, "stream")
    o = inc.table(spark, d, "orders")
    for name, rows, kind in (("a", o, "ARSON"), ("b", o.where("o_orderkey % 2 = 0"), "THEFT")):
        record = F.struct(S("o_orderkey").alias("id"), F.lit(kind).alias("t"))
        pages = rows.groupBy(F.floor(F.col("o_orderkey") / 20_000).alias("no")).agg(F.to_json(F.collect_list(record)).alias("value"))  # at most 20,000 short records a page
        pages.repartition("no").write.partitionBy("no").text(f"{at}/pages/{name}")
    s = mapping.Source("s", ("id",), ("t",), ("simple", ("d",)))
    v = store.Versions(spark, f"{at}/table")
    ingest.upsert_stream(ingest.stream_pages(spark, f"{at}/pages/*/*", 1000), s, v, f"{at}/check").awaitTermination()
    return v.read().select(F.col("source_incident_id").alias("id"), "subcategory")
