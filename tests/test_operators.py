"""Spatial joins, clustering, stores, geocoding and streams against brute force, and invariants of the cubes."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmart.operators import api, cubes, geocode, spatial, store
from cellmart.plans import catalogue, incidents
from cellmart.plans.filters import Counts
from cellmart.sources.mapping import Source
from cellmart.streaming.ingest import stream_pages, upsert_stream
from tests.conftest import SF


def poly(*rings):
    return json.dumps({"type": "Polygon", "coordinates": [list(map(list, r)) for r in rings]})


def square(x, y, n):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)]


def inside(rings, x, y):
    hit = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return False
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit += 1
    return hit % 2 == 1


def test_points_in_polygons(spark):
    rng = random.Random(1)
    shapes = {f"t{i}{j}": [square(i, j, 1)] for i in range(4) for j in range(4)} | {"hole": [square(0, 0, 3), square(1, 1, 1)], "tri": [[(0.2, 0.1), (3.7, 0.4), (1.1, 3.9), (0.2, 0.1)]]}
    points = [(k, rng.uniform(-0.5, 4.5), rng.uniform(-0.5, 4.5)) for k in range(300)] + [(900, 1.0, 0.5), (901, 2.0, 2.0)]
    p = spark.createDataFrame([(g, poly(*r)) for g, r in shapes.items()], "geoid string, boundary_geojson string")
    got = {(r.id, r.geoid) for r in spatial.join_points(spark.createDataFrame(points, "id int, longitude double, latitude double"), p).collect()}
    assert got == {(k, g) for k, x, y in points for g, r in shapes.items() if inside(r, x, y)}


def test_attribution(spark):
    tracts = spark.createDataFrame([("17031000100", poly(square(0, 0, 2))), ("17031000200", poly(square(2, 0, 2)))], "geoid string, boundary_geojson string")
    multi = json.dumps({"type": "MultiPolygon", "coordinates": [[square(0, 0, 1)], [square(3, 0, 1)]]})
    places = spark.createDataFrame([("big", 9.0, poly(square(0, 0, 4))), ("small", 1.0, multi), ("unknown", None, poly(square(0, 0, 4)))], "geoid string, land_area_sq_mi double, boundary_geojson string")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 0.5), (3, 3.5, 0.5), (4, 9.0, 9.0)], "id int, longitude double, latitude double")
    got = {r.id: (r.tract_geoid, r.place_geoid, r.state_fips, r.county_geoid) for r in spatial.attribute(points, "id", tracts, places).collect()}
    assert got == {1: ("17031000100", "small", "17", "17031"), 2: ("17031000100", "big", "17", "17031"), 3: ("17031000200", "small", "17", "17031"), 4: (None, None, None, None)}
    centres = tracts.select("geoid", (F.when(F.col("geoid") == "17031000100", 1.0).otherwise(3.0)).alias("centroid_lon"), F.lit(1.0).alias("centroid_lat"))
    hoods = spark.createDataFrame([(1, poly(square(0, 0, 4))), (2, poly(square(2.5, 0.5, 1)))], "id int, boundary_geojson string")
    assert {tuple(r) for r in spatial.crosswalk(centres, hoods).collect()} == {("17031000100", 1), ("17031000200", 1), ("17031000200", 2)}


def test_kmeans_against_plain_loops():
    rng = np.random.default_rng(2)
    x, y, n, k, box = rng.uniform(0, 10, 200), rng.uniform(0, 5, 200), rng.integers(1, 9, 200), 7, (0.0, 0.0, 10.0, 5.0)
    cx = [10 / 4 * (c % 3 + 1) for c in range(k)]
    cy = [5 / 4 * (c // 3 + 1) for c in range(k)]
    own = [0] * 200
    for _ in range(10):
        new = [min(range(k), key=lambda j: ((x[i] - cx[j]) ** 2 + (y[i] - cy[j]) ** 2, j)) for i in range(200)]
        if new == own:
            break
        own = new
        for j in range(k):
            m = [i for i in range(200) if own[i] == j]
            if m:
                cx[j], cy[j] = np.average(x[m], weights=n[m]), np.average(y[m], weights=n[m])
    want = [(np.average(x[m], weights=n[m]), np.average(y[m], weights=n[m]), n[m].sum()) for m in ([i for i in range(200) if own[i] == j] for j in range(k)) if m]
    assert np.allclose(np.array(api.kmeans(x, y, n, k, box)).T, want)
    assert len(api.kmeans(x[:3], y[:3], n[:3], 7, box)[0]) == 3


def test_cube_totals_agree(spark):
    rows = incidents.incidents(spark, SF)
    n = cubes.exportable(rows).count()
    cube, hexes = cubes.cell_cube(rows), cubes.hex_cube(rows)
    assert api.total(cube, Counts()).first().total == n
    assert {r["sum(cnt)"] for r in hexes.groupBy("resolution").sum("cnt").collect()} == {n}
    assert api.clusters(cube, catalogue.COUNTS, 3).agg(F.sum("cnt")).first()[0] == api.total(cube, catalogue.COUNTS).first().total
    with pytest.raises(ValueError):
        api.boundary_counts(cube, Counts(), "galaxy")
    dated = Counts(day_to="2100-01-01")
    assert api.total(cube, dated).first().total < n and hexes.where(dated.hexagons()).where("resolution = 4").agg(F.sum("cnt")).first()[0] == n


def test_list_and_count_differ_on_the_last_day_only_in_compat(spark):
    rows = cubes.exportable(incidents.incidents(spark, SF))
    p = Counts(day_from="1995-01-01", day_to="1995-01-31")
    assert api.page(rows, p, 10_000).count() == api.total(cubes.cell_cube(rows), p).first().total
    assert api.page(rows, p, 10_000, compat=True).count() <= api.page(rows, p, 10_000).count()


SCHEMA = "source_incident_id string, longitude double, latitude double, has_coordinates boolean, geocoded boolean, census_tract_geoid string, enriched boolean"


def test_stores(spark, tmp_path):
    old = spark.createDataFrame([("a", 1.0, 1.0, True, False, "t1", True), ("b", 0.0, 0.0, False, False, None, False)], SCHEMA)
    batch = spark.createDataFrame([("a", 5.0, 5.0, True, True, None, False, 1), ("a", 6.0, 6.0, True, True, None, False, 2), ("c", 7.0, 7.0, True, False, None, False, 3)], SCHEMA + ", seq int")
    got = {r.source_incident_id: r for r in store.upsert(old, batch, "source_incident_id", "seq").collect()}
    assert set(got) == {"a", "b", "c"} and (got["a"].longitude, got["a"].census_tract_geoid, got["a"].enriched) == (6.0, "t1", True)
    again = store.upsert(store.upsert(old, batch, "source_incident_id", "seq"), batch, "source_incident_id", "seq")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.values()))
    found = spark.createDataFrame([("b", -1.0, 2.0)], "source_incident_id string, longitude double, latitude double")
    b = {r.source_incident_id: r for r in store.update_coordinates(old, found, True).collect()}["b"]
    assert (b.longitude, b.has_coordinates, b.geocoded, b.enriched) == (-1.0, True, True, False)
    assert {r.source_incident_id: r.geocoded for r in store.mark_geocoded(old, found).collect()} == {"a": False, "b": True}
    new = spark.createDataFrame([("b", "t9")], "source_incident_id string, census_tract_geoid string")
    assert {r.source_incident_id: (r.census_tract_geoid, r.enriched) for r in store.update_attribution(old, new).collect()} == {"a": ("t1", True), "b": ("t9", True)}
    with pytest.raises(store.Unenriched):
        store.require_enriched(batch.withColumn("source_id", F.lit("s")))
    v = store.Versions(spark, f"file://{tmp_path}/v")
    assert v.read() is None and v.stale({"s": 1})
    v.write(old, fingerprint={"s": 1})
    v.write(old.limit(1), fingerprint={"s": 2})
    assert v.read().count() == 1 and not v.stale({"s": 2})
    line = json.loads(store.geojson_lines(old, ["source_incident_id"]).first().value)
    assert line["geometry"] == {"type": "Point", "coordinates": [1.0, 1.0]} and line["properties"] == {"source_incident_id": "a"}
    areas = spark.createDataFrame([("g", poly(square(0, 0, 1)))], "geoid string, boundary_geojson string")
    assert json.loads(store.boundary_lines(areas, ["geoid"]).first().value)["properties"] == {"geoid": "g"}


def test_geocoding(spark):
    known = spark.createDataFrame([("-87.5", "41.5", "100", "N MAIN ST", "SPRINGFIELD", "IL", ""), ("-87.6", "41.6", "200", "OAK AVE", "SPRINGFIELD", "IL", ""), ("-87.7", "41.7", "300", "ELM ST", "SHELBYVILLE", "IL", ""), ("x", "1", "1", "A ST", "B", "IL", "")], "LON string, LAT string, NUMBER string, STREET string, CITY string, REGION string, POSTCODE string")
    rows = [(1, "100 N. Main St", "Springfield"), (2, "200 block of Oka Ave", "Springfield"), (3, "300 Elm St", "Shelbyvile"), (4, "300 Elm St", "Elsewhere"), (5, "999 Main St", "Springfield"), (6, "A / B", "Springfield"), (7, None, "X"), (8, "100 N MAIN ST", "Cachetown")]
    i = spark.createDataFrame([(str(k), False, False, a, c, "IL") for k, a, c in rows], "source_incident_id string, has_coordinates boolean, geocoded boolean, block_address string, city string, state string")
    cache = spark.createDataFrame([("999 MAIN ST, Springfield, IL", "p", None, None), ("100 N MAIN ST, Cachetown, IL", "p", -1.0, 2.0)], "address_key string, provider string, longitude double, latitude double")
    got = {r.source_incident_id: r.longitude for r in geocode.geocode(i, cache, [("local", 2, geocode.local_resolver(geocode.index(known)))]).collect()}
    assert got == {"1": -87.5, "2": -87.6, "3": -87.7, "4": -87.7, "8": -1.0}
    both = cache.unionByName(cache.withColumn("provider", F.lit("q")))
    assert tuple(geocode.compare_providers(both, "p", "q").first()) == (2, 1, 1, 1)
    reply = spark.createDataFrame([('"1","100 Main, X, IL","Match","Exact","100 MAIN","-87.5,41.5","1","L"',), ('"2","zzz","No_Match"',)], "value string")
    assert [tuple(r) for r in geocode.parse_batch_reply(reply).collect()] == [("1", True, -87.5, 41.5)]


def test_stream_of_pages(spark, tmp_path):
    pages, s = tmp_path / "pages", Source("s", ("id",), ("t",), ("simple", ("d",)))
    pages.mkdir()
    (pages / "1.json").write_text('[{"id": "a", "t": "ARSON"}, {"id": "b", "t": "DUI"}]')
    v = store.Versions(spark, f"file://{tmp_path}/store")
    for i, body in enumerate(['[{"id": "b", "t": "THEFT"}, {"id": "c", "t": "DUI"}]', None]):
        q = upsert_stream(stream_pages(spark, str(pages)), s, v, str(tmp_path / "check"))
        q.awaitTermination()
        if body:
            (pages / "2.json").write_text(body)
    assert {r.source_incident_id: r.subcategory for r in v.read().collect()} == {"a": "ARSON", "b": "LARCENY_THEFT", "c": "DUI"}
