"""The registered queries of the engine and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmart import model
from cellmart.functions import hexgrid, text
from cellmart.operators import api, conversations, cubes, geocode, spatial, store, tools
from cellmart.plans import incidents as inc
from cellmart.plans import records  # noqa: F401  (registers its queries)
from cellmart.plans.filters import Analytics, Counts
from cellmart.plans.registry import QUERIES, SQL, Query, query
from cellmart.sources import mapping, readers

BOX = (-112.0, 27.0, -90.0, 43.0)
COUNTS = Counts(bbox=BOX, day_from="1995-01-01", day_to="1997-06-30", severity_min=2)
FACT = f"i AS ({inc.SQL}), f AS (SELECT * FROM i WHERE {inc.EXPORTABLE_SQL})"
CUBE = f"""{FACT}, cube AS (
  SELECT CAST(floor(longitude * 1000) AS INT) AS cell_lng, CAST(floor(latitude * 1000) AS INT) AS cell_lat, source_id, subcategory, category, severity,
    coalesce(arrest_made, 2) AS arrest, strftime(occurred_at, '%Y-%m-%d') AS day, state_fips, county_geoid, place_geoid, tract_geoid, neighborhood_id,
    CAST(count(*) AS BIGINT) AS cnt, sum(longitude) AS sum_lng, sum(latitude) AS sum_lat
  FROM f GROUP BY ALL)"""
COUNTS_SQL = "cell_lng BETWEEN -112000 AND -90000 AND cell_lat BETWEEN 27000 AND 43000 AND day >= '1995-01-01' AND day <= '1997-06-30' AND severity >= 2"


def _cube(spark: SparkSession, d: str) -> DataFrame:
    return cubes.cell_cube(inc.incidents(spark, d))


def _six(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# Cubes and map queries


@query(f"WITH {CUBE} SELECT * REPLACE (round(sum_lng, 6) AS sum_lng, round(sum_lat, 6) AS sum_lat) FROM cube")
def cell_cube(spark, d):
    c = _cube(spark, d)
    return c.select(*[x for x in c.columns if not x.startswith("sum_")], *_six("sum_lng", "sum_lat"))


@query(f"WITH {CUBE} SELECT state_fips, category, CAST(sum(cnt) AS BIGINT) AS cnt, round(sum(sum_lng), 6) AS sum_lng, round(sum(sum_lat), 6) AS sum_lat FROM cube GROUP BY ALL")
def cell_cube_rollup(spark, d):
    return _cube(spark, d).groupBy("state_fips", "category").agg(F.sum("cnt").alias("cnt"), F.round(F.sum("sum_lng"), 6).alias("sum_lng"), F.round(F.sum("sum_lat"), 6).alias("sum_lat"))


@query(f"WITH {CUBE} SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM cube WHERE {COUNTS_SQL}")
def viewport_total(spark, d):
    return api.total(_cube(spark, d), COUNTS)


@query(f"WITH {CUBE} SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM cube WHERE arrest = 0 AND category IN ('VIOLENT', 'OTHER') AND source_id IN ('src_1', 'src_2')")
def filtered_total(spark, d):
    return api.total(_cube(spark, d), Counts(arrest=False, categories=("VIOLENT", "OTHER"), sources=("src_1", "src_2"), severity_min=1))


@query(f"WITH {CUBE} SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM cube WHERE category = 'NO SUCH'")
def empty_total(spark, d):
    return api.total(_cube(spark, d), Counts(categories=("NO SUCH",)))


@query(f"WITH {CUBE} SELECT source_id, CAST(sum(cnt) AS BIGINT) AS cnt FROM cube WHERE {COUNTS_SQL} GROUP BY 1 HAVING sum(cnt) > 0")
def source_counts(spark, d):
    return api.source_counts(_cube(spark, d), COUNTS)


def _boundary(kind: str) -> None:
    key = api.BOUNDARIES[kind]

    def f(spark, d):
        return api.boundary_counts(_cube(spark, d), COUNTS, kind)

    f.__name__ = f"boundary_counts_{kind}"
    query(f"WITH {CUBE} SELECT {key} AS geoid, CAST(sum(cnt) AS BIGINT) AS cnt FROM cube WHERE {COUNTS_SQL} AND {key} IS NOT NULL GROUP BY 1 HAVING sum(cnt) > 0")(f)


for _k in api.BOUNDARIES:
    _boundary(_k)


@query(f"WITH {CUBE} SELECT cell_lng, cell_lat, CAST(sum(cnt) AS BIGINT) AS cnt, round(sum(sum_lng) / sum(cnt), 6) AS longitude, round(sum(sum_lat) / sum(cnt), 6) AS latitude FROM cube WHERE {COUNTS_SQL} GROUP BY 1, 2")
def micro_cells(spark, d):
    return api.micro_cells(_cube(spark, d), COUNTS).select("cell_lng", "cell_lat", "cnt", *_six("longitude", "latitude"))


@query(f"""WITH {FACT} SELECT source_incident_id, subcategory, strftime(occurred_at, '%Y-%m-%d') AS day, city FROM f
WHERE longitude BETWEEN -112 AND -90 AND latitude BETWEEN 27 AND 43 AND strftime(occurred_at, '%Y-%m-%d') >= '1995-01-01' AND strftime(occurred_at, '%Y-%m-%d') <= '1997-06-30' AND severity >= 2
ORDER BY occurred_at DESC NULLS LAST, source_incident_id OFFSET 50 LIMIT 50""")
def incident_page(spark, d):
    rows = api.page(cubes.exportable(inc.incidents(spark, d)), COUNTS, limit=50, offset=50)
    return rows.select("source_incident_id", "subcategory", F.date_format("occurred_at", "yyyy-MM-dd").alias("day"), "city")


@query()
def weighted_clusters(spark, d):
    return api.clusters(_cube(spark, d), COUNTS, 12).select(*_six("longitude", "latitude"), "cnt")


def _hex_sql(r: int) -> str:
    s, q3 = repr(hexgrid.edge(r)), repr(math.sqrt(3.0) / 3)
    return f"""SELECT {r} AS resolution, concat('{r}:', CAST(CAST(CASE WHEN dx > dy AND dx > dz THEN -y - z ELSE x END AS BIGINT) AS VARCHAR), ':', CAST(CAST(CASE WHEN dx > dy AND dx > dz THEN z WHEN dy > dz THEN z ELSE -x - y END AS BIGINT) AS VARCHAR)) AS hexagon, category,
  coalesce(strftime(occurred_at, '%Y'), '') AS year
FROM (SELECT *, abs(x - q) AS dx, abs(y + q + r) AS dy, abs(z - r) AS dz FROM (SELECT *, floor(q + 0.5) AS x, floor(r + 0.5) AS z, floor(0.5 - q - r) AS y FROM (
  SELECT *, (longitude * CAST({q3} AS DOUBLE) - latitude / 3) / CAST({s} AS DOUBLE) AS q, latitude * CAST({2.0 / 3!r} AS DOUBLE) / CAST({s} AS DOUBLE) AS r FROM f)))"""


@query(f"WITH {FACT} SELECT resolution, hexagon, category, year, CAST(count(*) AS BIGINT) AS cnt FROM ({' UNION ALL '.join(_hex_sql(r) for r in hexgrid.RESOLUTIONS)}) GROUP BY ALL")
def hex_cube(spark, d):
    return cubes.hex_cube(inc.incidents(spark, d)).groupBy("resolution", "hexagon", "category", F.substring("day", 1, 4).alias("year")).agg(F.sum("cnt").alias("cnt"))


@query()
def hexbins(spark, d):
    rows = api.hexagons(cubes.hex_cube(inc.incidents(spark, d)), Counts(bbox=BOX), zoom=6)
    return rows.select("hexagon", "cnt", F.to_json(F.transform("vertices", lambda v: F.transform(v, lambda x: F.round(x, 6)))).alias("vertices"))


@query(f"""WITH {FACT} SELECT n AS level, CAST(floor(longitude * n) AS BIGINT) AS x, CAST(floor(latitude * n) AS BIGINT) AS y, CAST(count(*) AS BIGINT) AS cnt
FROM f CROSS JOIN (VALUES (1), (10), (100), (1000)) AS l(n) GROUP BY 1, 2, 3""")
def unpivot_resolutions(spark, d):
    return cubes.grid_levels(inc.incidents(spark, d))


@query(f"WITH {FACT} SELECT string_agg(DISTINCT city, ',' ORDER BY city) AS cities, strftime(min(occurred_at), '%Y-%m-%d') AS first_day, strftime(max(occurred_at), '%Y-%m-%d') AS last_day, CAST(count(DISTINCT source_id) AS BIGINT) AS sources, CAST(count(*) AS BIGINT) AS incidents FROM f")
def metadata_summary(spark, d):
    return cubes.metadata(inc.incidents(spark, d))


@query(f"""WITH {FACT}, k AS (SELECT DISTINCT subcategory, category, severity FROM f), p AS (SELECT row_number() OVER (ORDER BY category) AS id, category FROM (SELECT DISTINCT category FROM k))
SELECT CAST(id AS BIGINT) AS id, category AS name, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS BIGINT) AS severity FROM p
UNION ALL SELECT CAST((SELECT max(id) FROM p) + row_number() OVER (ORDER BY subcategory, k.category, severity) AS BIGINT), subcategory, CAST(p.id AS BIGINT), CAST(severity AS BIGINT) FROM k JOIN p ON k.category = p.category""")
def category_surrogate_ids(spark, d):
    return cubes.category_ids(inc.incidents(spark, d))


@query(f"""WITH {CUBE}, c AS (SELECT cell_lng, cell_lat, CAST(sum(cnt) AS BIGINT) AS cnt FROM cube GROUP BY 1, 2), v AS (SELECT list(cnt ORDER BY cnt) AS a, count(*) AS n FROM c)
SELECT a[1] AS lo, a[CAST(least(floor(0.25 * n), n - 1) AS BIGINT) + 1] AS p25, a[CAST(least(floor(0.5 * n), n - 1) AS BIGINT) + 1] AS p50, a[CAST(least(floor(0.75 * n), n - 1) AS BIGINT) + 1] AS p75, a[n] AS hi FROM v""")
def quantile_breaks(spark, d):
    return api.breaks(_cube(spark, d).groupBy("cell_lng", "cell_lat").agg(F.sum("cnt").alias("cnt")))


@query(f"""WITH {CUBE}, t AS ({inc.TRACTS_SQL}), c AS (SELECT tract_geoid AS geoid, CAST(sum(cnt) AS BIGINT) AS cnt FROM cube WHERE tract_geoid IS NOT NULL GROUP BY 1)
SELECT c.geoid, cnt, round(CASE WHEN population > 0 THEN cnt * CAST(1000 AS DOUBLE) / population ELSE 0 END, 6) AS per_1k, round(CASE WHEN land_area_sq_mi > 0 THEN cnt / land_area_sq_mi ELSE 0 END, 6) AS per_sq_mi FROM c JOIN t ON c.geoid = t.geoid""")
def choropleth(spark, d):
    tracts, _, _ = inc.dimensions(spark, d)
    return api.choropleth(api.boundary_counts(_cube(spark, d), Counts(), "tract"), tracts).select("geoid", "cnt", *_six("per_1k", "per_sq_mi"))


@query(f"""WITH {CUBE}, parts AS (SELECT * FROM cube WHERE source_id < 'src_2' UNION ALL SELECT * FROM cube WHERE source_id >= 'src_2') SELECT source_id, day, CAST(sum(cnt) AS BIGINT) AS cnt FROM parts GROUP BY 1, 2""")
def partition_merge(spark, d):
    i = inc.incidents(spark, d)
    parts = cubes.cell_cube(i.where("source_id < 'src_2'")), cubes.cell_cube(i.where("source_id >= 'src_2'"))
    return cubes.merge_counts(*parts).groupBy("source_id", "day").agg(F.sum("cnt").alias("cnt"))


@query("""WITH u AS (SELECT c_nationkey AS k, c_custkey AS o, c_name AS name FROM customer UNION ALL SELECT s_nationkey, s_suppkey + 1000000, s_name FROM supplier)
SELECT k, o, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o) AS n FROM u) WHERE n = 1""")
def partition_merge_distinct_on(spark, d):
    a = inc.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("o"), F.col("c_name").alias("name"))
    b = inc.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), (F.col("s_suppkey") + 1000000).alias("o"), F.col("s_name").alias("name"))
    return cubes.merge_distinct_on([a, b], "k", "o")


@query("SELECT CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS BIGINT) AS id, c_custkey FROM customer")
def reissued_ids(spark, d):
    c = inc.table(spark, d, "customer").select("c_name", "c_custkey")
    return cubes.reissued([c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1")], ["c_name", "c_custkey"]).select("id", "c_custkey")


@query("""SELECT type, geoid, name FROM (SELECT 'nation' AS type, CAST(n_nationkey AS VARCHAR) AS geoid, n_name AS name FROM nation UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), r_name FROM region
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer) WHERE name ILIKE '%a%' ORDER BY name, type, geoid LIMIT 50""")
def boundary_search(spark, d):
    layer = lambda t, k, n: inc.table(spark, d, t).select(F.col(k).cast("string").alias("geoid"), F.col(n).alias("name"), F.col(n).alias("full_name"), F.lit(None).cast("string").alias("state_abbr"), F.lit(None).cast("long").alias("population"))
    layers = {"nation": layer("nation", "n_nationkey", "n_name"), "region": layer("region", "r_regionkey", "r_name"), "customer": layer("customer", "c_custkey", "c_name")}
    return cubes.boundary_search(layers, "a", limit=50).select("type", "geoid", "name")


# Analytical tools


@query(f"WITH {FACT} SELECT category, CAST(count(*) AS BIGINT) AS cnt FROM f GROUP BY ROLLUP (category)")
def count_by_category(spark, d):
    return tools.count_incidents(cubes.exportable(inc.incidents(spark, d)), Analytics())


@query(f"WITH {FACT} SELECT category, CAST(count(*) AS BIGINT) AS cnt FROM f WHERE city ILIKE 'auto%' AND category = 'OTHER' AND occurred_at >= TIMESTAMP '1994-01-01' AND occurred_at <= TIMESTAMP '1996-12-31' AND severity >= 2 GROUP BY ROLLUP (category)")
def count_filtered(spark, d):
    p = Analytics(city="auto%", category="other", date_from="1994-01-01", date_to="1996-12-31", severity_min=2)
    return tools.count_incidents(cubes.exportable(inc.incidents(spark, d)), p)


def _rank_sql(safest: bool) -> str:
    order = "per ASC NULLS LAST, CASE WHEN per IS NULL THEN total_incidents ELSE 0 END ASC, area_id" if safest else "per DESC NULLS FIRST, CASE WHEN per IS NULL THEN total_incidents ELSE 0 END DESC, area_id"
    return f"""WITH {FACT}, t AS ({inc.TRACTS_SQL}), l AS ({inc.LINKS_SQL}), n AS ({inc.NEIGHBORHOODS_SQL}),
r AS (SELECT t.geoid, coalesce(n.name, t.geoid) AS area_id, coalesce(n.name, t.name) AS area_name, t.population, t.land_area_sq_mi, f.category, count(*) AS c
  FROM f JOIN t ON t.geoid = f.tract_geoid LEFT JOIN l ON t.geoid = l.geoid LEFT JOIN n ON l.neighborhood_id = n.id GROUP BY ALL),
a AS (SELECT area_id, min(area_name) AS area_name, CAST(sum(c) AS BIGINT) AS total_incidents FROM r GROUP BY 1),
p AS (SELECT area_id, coalesce(sum(population), 0) AS population, coalesce(sum(land_area_sq_mi), 0) AS land FROM (SELECT DISTINCT area_id, geoid, population, land_area_sq_mi FROM r) GROUP BY 1),
k AS (SELECT area_id, string_agg(concat(category, '=', CAST(c AS VARCHAR)), ';' ORDER BY category) AS by_category FROM (SELECT area_id, category, CAST(sum(c) AS BIGINT) AS c FROM r GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT a.*, CASE WHEN population > 0 THEN total_incidents / population * 1000 END AS per, CASE WHEN land > 0 THEN land END AS land_area_sq_mi, CASE WHEN land > 0 THEN total_incidents / land END AS per_mi, by_category FROM a JOIN p USING (area_id) JOIN k USING (area_id))
SELECT area_id, area_name, total_incidents, round(per, 6) AS incidents_per_1k, land_area_sq_mi, round(per_mi, 6) AS incidents_per_sq_mi, by_category, CAST(row_number() OVER (ORDER BY {order}) AS INT) AS rank FROM x ORDER BY rank LIMIT 15"""


def _rank(spark, d, safest):
    rows = tools.rank_areas(cubes.exportable(inc.incidents(spark, d)), *inc.dimensions(spark, d), Analytics(), safest, 15)
    shown = F.array_join(F.transform("by_category", lambda x: F.concat(x["category"], F.lit("="), x["n"].cast("string"))), ";")
    return rows.select("area_id", "area_name", "total_incidents", *_six("incidents_per_1k"), "land_area_sq_mi", *_six("incidents_per_sq_mi"), shown.alias("by_category"), "rank")


@query(_rank_sql(True))
def rank_areas_safe(spark, d):
    return _rank(spark, d, True)


@query(_rank_sql(False))
def rank_areas_dangerous(spark, d):
    return _rank(spark, d, False)


@query(f"""WITH {FACT}, c AS (SELECT category, count(*) FILTER (WHERE occurred_at >= TIMESTAMP '1994-01-01' AND occurred_at <= TIMESTAMP '1995-06-30') AS a, count(*) FILTER (WHERE occurred_at >= TIMESTAMP '1995-01-01' AND occurred_at <= TIMESTAMP '1996-12-31') AS b
  FROM f WHERE occurred_at >= TIMESTAMP '1994-01-01' AND occurred_at <= TIMESTAMP '1996-12-31' GROUP BY ROLLUP (category))
SELECT category, CAST(a AS BIGINT) AS a_count, CAST(b AS BIGINT) AS b_count, round(CASE WHEN a > 0 THEN (b - a) / a * 100 WHEN b > 0 THEN 100 ELSE 0 END, 6) AS percent_change FROM c""")
def compare_periods(spark, d):
    rows = tools.compare_periods(cubes.exportable(inc.incidents(spark, d)), Analytics(), ("1994-01-01", "1995-06-30"), ("1995-01-01", "1996-12-31"))
    return rows.select("category", "a_count", "b_count", *_six("percent_change"))


def _trend(grain: str) -> None:
    def f(spark, d):
        return tools.trend(cubes.exportable(inc.incidents(spark, d)), Analytics(), grain)

    f.__name__ = f"trend_{grain}"
    query(f"WITH {FACT} SELECT strftime(date_trunc('{grain}', occurred_at), '%Y-%m-%d') AS period, CAST(count(*) AS BIGINT) AS cnt FROM f WHERE occurred_at IS NOT NULL GROUP BY 1")(f)


for _g in ("day", "week", "month", "year"):
    _trend(_g)


@query(f"WITH {FACT} SELECT subcategory, category, CAST(count(*) AS BIGINT) AS cnt, CAST((SELECT count(*) FROM f) AS BIGINT) AS total FROM f GROUP BY 1, 2 ORDER BY cnt DESC, subcategory, category LIMIT 3")
def top_subcategories(spark, d):
    return tools.top_types(cubes.exportable(inc.incidents(spark, d)), Analytics(), 3)


@query(f"WITH {FACT} SELECT city, state, CAST(count(*) AS BIGINT) AS cnt FROM f WHERE city IS NOT NULL AND city <> '' GROUP BY 1, 2")
def list_cities(spark, d):
    return tools.list_cities(cubes.exportable(inc.incidents(spark, d)))


@query(f"""WITH {FACT} SELECT city, state, CAST(count(*) AS BIGINT) AS cnt, CASE WHEN city ILIKE 'b' THEN 0 WHEN city ILIKE 'b%' THEN 1 ELSE 2 END AS match_rank FROM f
WHERE city <> '' AND city ILIKE '%b%' GROUP BY 1, 2 ORDER BY match_rank, cnt DESC, city, state LIMIT 10""")
def search_locations(spark, d):
    return tools.search_locations(cubes.exportable(inc.incidents(spark, d)), "b")


@query("SELECT CAST(c_custkey AS VARCHAR) AS geoid, c_name AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS population FROM customer WHERE c_name ILIKE '%1%' ORDER BY population DESC NULLS LAST, geoid LIMIT 10")
def search_places(spark, d):
    p = inc.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("geoid"), F.col("c_name").alias("name"), F.lit("X").alias("state_abbr"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("population"))
    return tools.search_places(p, "1").select("geoid", "name", "population")


# Records, joins, stores


@query("SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_keep_last(spark, d):
    rows = store.keep_last(inc.table(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return rows.select("user_id", "event_id", "event_type", *_six("value"))


@query("""WITH old AS (SELECT c_custkey AS id, c_name AS name, 'old' AS neighborhood_id FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_custkey AS id, concat('new ', c_name) AS name FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(new.id, old.id) AS id, coalesce(new.name, old.name) AS name, CASE WHEN old.id IS NULL THEN 'none' ELSE old.neighborhood_id END AS neighborhood_id FROM old FULL JOIN new ON old.id = new.id""")
def upsert_batch(spark, d):
    c = inc.table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("old").alias("neighborhood_id"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("none").alias("neighborhood_id"), F.lit(1).alias("seq"))
    batch = new.unionByName(new.withColumns({"name": F.concat(F.lit("new "), "name"), "seq": F.lit(2)}))
    return store.upsert(old, batch, "id", "seq")


@query("""SELECT k AS key, v AS value FROM (SELECT n_regionkey AS k, max(n_name) AS v FROM nation GROUP BY 1) WHERE k NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 2)
UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 2""")
def merge_replace_by_key(spark, d):
    a = inc.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("key")).agg(F.max("n_name").alias("value"))
    b = inc.table(spark, d, "region").where("r_regionkey > 2").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return store.merge_by_key([a, b], ["key"])


@query(f"WITH {CUBE} SELECT category, CAST(sum(cnt) AS BIGINT) AS cnt FROM cube WHERE cell_lng IN (SELECT DISTINCT -120000 + 2000 * n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def semi_join_cells(spark, d):
    wanted = inc.table(spark, d, "nation").where("n_regionkey = 1").select((-120000 + 2000 * F.col("n_nationkey")).alias("cell_lng"))
    return _cube(spark, d).join(wanted, "cell_lng", "left_semi").groupBy("category").agg(F.sum("cnt").alias("cnt"))


CACHE = "SELECT concat('k', CAST(c_custkey AS VARCHAR)) AS address_key, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS provider, CASE WHEN c_custkey % 3 <> 0 THEN c_acctbal END AS longitude FROM customer WHERE c_custkey % 4 <> 0"


@query(f"WITH c AS ({CACHE}), q AS (SELECT DISTINCT concat('k', CAST(o_custkey AS VARCHAR)) AS address_key FROM orders) SELECT q.address_key, CASE WHEN c.address_key IS NULL THEN 'untried' WHEN longitude IS NULL THEN 'miss' ELSE 'hit' END AS state FROM q LEFT JOIN c ON q.address_key = c.address_key WHERE c.address_key IS NULL OR longitude IS NOT NULL")
def cache_anti_join(spark, d):
    c = inc.table(spark, d, "customer").where("c_custkey % 4 <> 0")
    cache = c.select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("address_key"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("provider"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("longitude"), F.col("c_acctbal").alias("latitude"))
    asked = inc.table(spark, d, "orders").select(F.concat(F.lit("k"), F.col("o_custkey").cast("string")).alias("address_key")).distinct()
    hits, untried = geocode.split_by_cache(asked, cache)
    return hits.select("address_key", F.lit("hit").alias("state")).unionByName(untried.select("address_key", F.lit("untried").alias("state")))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS cnt FROM events GROUP BY 1")
def json_extract_props(spark, d):
    k = mapping.number(F.parse_json("props"), "k").cast("long")
    return inc.table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(F.lit(1)).alias("cnt"))


_WORDS = [w for _, words in model.TYPE_RULES for w in words] + ["identity theft", "unlisted"]


def _class_sql(raw: str) -> str:
    rule = lambda words: " OR ".join(f"contains(lower({raw}), '{w}')" for w in words)
    return "CASE " + " ".join(f"WHEN {rule(ws)} THEN '{name}'" for name, ws in model.TYPE_RULES) + " ELSE 'UNKNOWN' END"


@query(f"""WITH r AS (SELECT o_orderkey AS id, concat(upper(list_extract([{', '.join(f"'{w}'" for w in _WORDS)}], CAST(o_orderkey % {len(_WORDS)} + 1 AS INT))), ' / ', o_orderpriority) AS raw FROM orders),
t AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c in model.TAXONOMY)}) AS t(s, c, n))
SELECT id, raw, s AS subcategory, c AS category, n AS severity FROM (SELECT *, {_class_sql('raw')} AS k FROM r) JOIN t ON k = s""")
def type_mapping_rules(spark, d):
    words = F.array(*[F.lit(w) for w in _WORDS])
    raw = F.concat(F.upper(F.element_at(words, (F.col("o_orderkey") % len(_WORDS) + 1).cast("int"))), F.lit(" / "), "o_orderpriority")
    rows = inc.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), raw.alias("raw")).withColumn("subcategory", text.classify(F.col("raw")))
    return rows.select("id", "raw", "subcategory", text.category_of(F.col("subcategory")).alias("category"), text.severity_of(F.col("subcategory")).alias("severity"))


_ADDRESSES = ["{k}00 block of n state st", "XX{k} Main St WB", " {k}BLK  Fisher Rd. #2", "Broadway AND {k}th ave", "unknown", "{k} BL Cedarleaf Ave", "1ST ST / MAIN-{k} AVE"]


@query(f"""WITH r AS (SELECT c_custkey AS id, replace(list_extract([{', '.join(f"'{a}'" for a in _ADDRESSES)}], CAST(c_custkey % {len(_ADDRESSES)} + 1 AS INT)), '{{k}}', CAST(c_custkey AS VARCHAR)) AS raw FROM customer),
a AS (SELECT *, upper(trim(raw)) AS up, regexp_replace(upper(trim(raw)), '\\s+(EB|WB|NB|SB)$', '') AS short FROM r),
b AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(short, '\\s+(BLOCK|BLK)\\s+OF\\s+', ' ', 'g'), '^(\\d+)\\s*(?:BLOCK|BLK|BL)\\s+', '\\1 '), '^XX(\\d+)', '1\\1')) AS plain FROM a)
SELECT id, raw, CASE WHEN up = 'UNKNOWN' THEN 'NONE' WHEN contains(short, ' / ') OR contains(short, ' AND ') THEN 'INTERSECTION' ELSE 'STREET' END AS kind,
  CASE WHEN up = 'UNKNOWN' THEN NULL WHEN contains(short, ' / ') THEN split_part(short, ' / ', 1) WHEN contains(short, ' AND ') THEN split_part(short, ' AND ', 1) ELSE plain END AS street,
  CASE WHEN contains(short, ' / ') THEN split_part(short, ' / ', 2) WHEN contains(short, ' AND ') THEN split_part(short, ' AND ', 2) END AS "cross" FROM b""")
def address_clean(spark, d):
    raw = F.replace(F.element_at(F.array(*[F.lit(a) for a in _ADDRESSES]), (F.col("c_custkey") % len(_ADDRESSES) + 1).cast("int")), F.lit("{k}"), F.col("c_custkey").cast("string"))
    rows = inc.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), raw.alias("raw")).withColumn("a", text.clean_address(F.col("raw")))
    return rows.select("id", "raw", "a.kind", "a.street", "a.cross")


@query("""WITH t AS (SELECT c_custkey AS id, string_split_regex(trim(regexp_replace(upper(concat(CAST(c_custkey AS VARCHAR), ' n. oak-st, ', c_mktsegment, ' ave')), '[.,#''/\\\\-]+', ' ', 'g')), '\\s+') AS w FROM customer)
SELECT id, array_to_string(list_transform(w, lambda x: CASE x WHEN 'N' THEN 'NORTH' WHEN 'ST' THEN 'STREET' WHEN 'AVE' THEN 'AVENUE' ELSE x END), ' ') AS address FROM t""")
def address_normalize(spark, d):
    raw = F.concat(F.col("c_custkey").cast("string"), F.lit(" n. oak-st, "), "c_mktsegment", F.lit(" ave"))
    return inc.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.normalize_address(raw).alias("address"))


@query("""SELECT c.conv_id, c.title, CAST(coalesce(m.n, 0) AS BIGINT) AS messages FROM (SELECT conv_id, arg_min(text, turn) AS title FROM conversations GROUP BY 1) c
LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1) m ON c.conv_id = m.conv_id""")
def conversation_list(spark, d):
    return conversations.listing(inc.table(spark, d, "conversations"))


@query(f"WITH {FACT} SELECT strftime(max(occurred_at) - INTERVAL 7 DAY, '%Y-%m-%d') AS since FROM i")
def sync_watermark(spark, d):
    return store.watermark(inc.incidents(spark, d), True).select(F.date_format("since", "yyyy-MM-dd").alias("since"))


_SQUARE = "CAST(-120 + 2 * n_nationkey AS DOUBLE) AS x, CAST(25 + n_nationkey AS DOUBLE) AS y"


@query(f"""WITH {FACT}, n AS (SELECT CAST(n_nationkey AS VARCHAR) AS geoid, {_SQUARE} FROM nation)
SELECT source_incident_id, n.geoid FROM f JOIN n ON longitude > x + CAST(0.001 AS DOUBLE) AND longitude < x + CAST(0.5 AS DOUBLE) AND latitude > y - CAST(0.5 AS DOUBLE) AND latitude < y + CAST(0.006 AS DOUBLE)
 AND NOT (longitude >= x + CAST(0.0035 AS DOUBLE) AND longitude <= x + CAST(0.0045 AS DOUBLE) AND latitude >= y + CAST(0.0015 AS DOUBLE) AND latitude <= y + CAST(0.0045 AS DOUBLE))""")
def point_in_polygon(spark, d):
    n = F.col("n_nationkey")
    x, y = (-120 + 2 * n).cast("double"), (25 + n).cast("double")
    ring = lambda w, s, e, t: F.array(*[F.array(x + a, y + b) for a, b in ((w, s), (e, s), (e, t), (w, t), (w, s))])
    shape = F.array(ring(0.001, -0.5, 0.5, 0.006), ring(0.0035, 0.0015, 0.0045, 0.0045))
    p = inc.table(spark, d, "nation").select(n.cast("string").alias("geoid"), F.to_json(F.struct(F.lit("Polygon").alias("type"), shape.alias("coordinates"))).alias("boundary_geojson"))
    return spatial.join_points(cubes.exportable(inc.incidents(spark, d)).select("source_incident_id", "longitude", "latitude"), p).select("source_incident_id", "geoid")


@query("""WITH w AS (SELECT c_custkey AS id, unnest(range(0, 1000, 364)) AS s FROM customer)
SELECT id, strftime(DATE '2020-01-01' + CAST(s AS INT), '%Y-%m-%d') AS start, strftime(least(DATE '2020-01-01' + CAST(s AS INT) + 364, DATE '2020-01-01' + 999), '%Y-%m-%d') AS stop FROM w WHERE s < 999""")
def time_windows(spark, d):
    since = F.lit("2020-01-01").cast("date")
    w = readers.windows(since, F.date_add(since, 999), 364)
    rows = inc.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(w).alias("w"))
    return rows.select("id", F.date_format("w.start", "yyyy-MM-dd").alias("start"), F.date_format("w.stop", "yyyy-MM-dd").alias("stop"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS key, replace(s_name, '#', ' ') AS name, '' AS missing FROM supplier")
def html_table_records(spark, d):
    cells = F.concat(F.lit("<TR class=a><td> "), F.col("s_suppkey").cast("string"), F.lit("</td><td><b>"), F.replace("s_name", F.lit("#"), F.lit("&nbsp;\n")), F.lit("</b></td></tr></table>"))
    html = F.concat(F.lit("<html><table><tr><th>key</th><th>name</th><th>missing</th></tr>"), cells)
    rows = readers.html_tables(inc.table(spark, d, "supplier").select(html.alias("html")))
    return rows.select(*[mapping.string(F.col("record"), n).alias(n) for n in ("key", "name", "missing")])


@query("SELECT page_id, CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) > 0 AS BOOLEAN) AS filled, md5(trim(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), chr(160), ' '))) AS text_md5 FROM pages")
def html_strip(spark, d):
    return inc.table(spark, d, "pages").select("page_id", (F.length(F.regexp_replace("html", "<[^>]+>", "")) > 0).alias("filled"), F.md5(text.strip_html(F.col("html"))).alias("text_md5"))


@query()
def normalized_records(spark, d):
    o = inc.table(spark, d, "orders")
    raw = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("o_orderkey") % len(_WORDS) + 1).cast("int")).alias("primary_type"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("date"), (F.lit(-120.5) + F.col("o_custkey") % 10).cast("string").alias("lon"), (F.lit(30.5) + F.col("o_orderkey") % 10).cast("string").alias("lat"), (F.col("o_orderkey") % 2 == 0).alias("arrest")))
    s = mapping.Source("test", ("case", "id"), ("primary_type",), ("simple", ("date",)), ("pair", ("lon", "lat")), arrest=("bool", "arrest", ""), city="CITY", state="XX")
    rows = mapping.normalize(o.select(F.parse_json(raw).alias("record")), s)
    return rows.groupBy("subcategory", "category", "severity", "arrest_made", "has_coordinates").agg(F.count(F.lit(1)).alias("cnt"), F.count("occurred_at").alias("dated"))


SQL["normalized_records"] = f"""WITH r AS (SELECT *, list_extract([{', '.join(f"'{w}'" for w in _WORDS)}], CAST(o_orderkey % {len(_WORDS)} + 1 AS INT)) AS raw FROM orders),
t AS (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c in model.TAXONOMY)}) AS t(s, c, n))
SELECT s AS subcategory, c AS category, n AS severity, o_orderkey % 2 = 0 AS arrest_made, true AS has_coordinates, CAST(count(*) AS BIGINT) AS cnt, CAST(count(o_orderdate) AS BIGINT) AS dated FROM (SELECT *, {_class_sql('raw')} AS k FROM r) JOIN t ON k = s GROUP BY ALL"""


@query("""SELECT concat('i', CAST(a.c_custkey AS VARCHAR)) AS source_incident_id, CAST(-87.5 AS DOUBLE) + floor(b.c_custkey / CAST(4000 AS DOUBLE)) / 1000 AS longitude, 40 + b.c_custkey % 4000 / CAST(100 AS DOUBLE) AS latitude
FROM customer a JOIN customer b ON b.c_custkey = CASE WHEN a.c_custkey % 2 = 0 THEN a.c_custkey // 2 ELSE a.c_custkey END
WHERE NOT (b.c_custkey = 7 AND a.c_mktsegment = 'BUILDING') AND (b.c_custkey % 2 = 0 OR damerau_levenshtein(a.c_mktsegment, b.c_mktsegment) <= 1)""")
def geocode_job(spark, d):
    """Every customer is an entry of the index; even ones ask for the house of half their number, odd ones for their own."""
    c = inc.table(spark, d, "customer")
    k = F.col("c_custkey")
    asked = F.when(k % 2 == 0, (k / 2).cast("long")).otherwise(k)
    rows = c.select(F.concat(F.lit("i"), F.col("c_custkey").cast("string")).alias("source_incident_id"), F.lit(False).alias("has_coordinates"), F.lit(False).alias("geocoded"), F.concat(asked.cast("string"), F.lit(" block of n Oak st")).alias("block_address"), F.col("c_mktsegment").alias("city"), F.lit("IL").alias("state"))
    known = c.select((F.lit(-87.5) + F.floor(k / 4000) / 1000).cast("string").alias("LON"), (F.lit(40) + k % 4000 / 100).cast("string").alias("LAT"), F.col("c_custkey").cast("string").alias("NUMBER"), F.when(F.col("c_custkey") % 2 == 0, "N OAK ST").otherwise("N OKA ST").alias("STREET"), F.col("c_mktsegment").alias("CITY"), F.lit("IL").alias("REGION"), F.lit("").alias("POSTCODE"))
    cache = spark.createDataFrame([("7 N OAK ST, BUILDING, IL", "census", None, None)], "address_key string, provider string, longitude double, latitude double")
    return geocode.geocode(rows, cache, [("local", 2, geocode.local_resolver(geocode.index(known)))])


@query(f"""SELECT c AS category, concat('[', string_agg(concat('{{"name":"', s, '","severity":', CAST(n AS VARCHAR), '}}'), ',' ORDER BY s), ']') AS subcategories
FROM (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c in model.TAXONOMY)}) AS t(s, c, n) GROUP BY 1""")
def taxonomy_tree(spark, d):
    return api.taxonomy(spark).select("category", F.to_json("subcategories").alias("subcategories"))


@query("""SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS cnt FROM events GROUP BY 1, 2""")
def windowed_events(spark, d):
    from cellmart.streaming.ingest import windowed_counts

    return windowed_counts(inc.table(spark, d, "events")).select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "cnt")


@query(f"WITH {FACT} SELECT CAST(floor((longitude + 180) / 360 * 256) AS INT) AS x, CAST(floor((1 - ln(tan(radians(latitude)) + 1 / cos(radians(latitude))) / pi()) / 2 * 256) AS INT) AS y, CAST(count(*) AS BIGINT) AS cnt FROM f GROUP BY 1, 2")
def tile_counts(spark, d):
    return store.tiles(cubes.exportable(inc.incidents(spark, d)), 8)


@query(f"WITH {FACT} SELECT state, round(sum(CAST(0.2 AS DOUBLE) + (severity - 1) * CAST(0.2 AS DOUBLE)), 6) AS weight FROM f GROUP BY 1")
def heat_weights(spark, d):
    return cubes.exportable(inc.incidents(spark, d)).groupBy("state").agg(F.round(F.sum(api.heat_weight(F.col("severity"))), 6).alias("weight"))


_FIPS = "CASE WHEN s_suppkey % 4 <> 0 THEN lpad(CAST(s_suppkey % 60 AS VARCHAR), 2, '0') END"


@query(f"SELECT s_suppkey AS id, {_FIPS} AS fips, CASE {_FIPS} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in model.STATES.items())} END AS abbr FROM supplier")
def state_codes(spark, d):
    k = F.col("s_suppkey")
    fips = F.when(k % 4 != 0, F.lpad((k % 60).cast("string"), 2, "0"))
    rows = inc.table(spark, d, "supplier").select(k.alias("id"), fips.alias("fips"))
    return rows.select("id", "fips", text.state_abbr(F.col("fips")).alias("abbr"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
