"""Table-driven cases of the record functions and the filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellmart.functions import text
from cellmart.operators import api, geocode
from cellmart.plans import filters
from cellmart.sources import mapping, readers


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


def many(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_classes(spark):
    cases = {"HOMICIDE - FIRST DEGREE": "HOMICIDE", "CRIM SEXUAL ASSAULT": "SEXUAL_ASSAULT", "AGG ASSAULT": "AGGRAVATED_ASSAULT", "BATTERY": "SIMPLE_ASSAULT", "Theft from auto": "LARCENY_THEFT", "AUTO THEFT": "MOTOR_VEHICLE_THEFT", "identity theft": "LARCENY_THEFT", "identity fraud": "IDENTITY_THEFT", "DUI": "DUI", "NARCOTICS": "DRUG_POSSESSION", "zzz": "UNKNOWN", "": "UNKNOWN", None: "UNKNOWN", "assault w/dangerous weapon": "AGGRAVATED_ASSAULT"}
    assert many(spark, text.classify, cases) == list(cases.values())


def test_addresses(spark):
    cases = {
        "100 N STATE ST": ("STREET", "100 N STATE ST", None), "4800 BLOCK OF SILVER HILL RD": ("STREET", "4800 SILVER HILL RD", None), "100 BLK OF MAIN ST": ("STREET", "100 MAIN ST", None),
        "100 BLOCK MAIN ST": ("STREET", "100 MAIN ST", None), "XX00 MAIN ST": ("STREET", "100 MAIN ST", None), "1ST ST / MAIN AVE": ("INTERSECTION", "1ST ST", "MAIN AVE"),
        "BROADWAY AND 5TH AVE": ("INTERSECTION", "BROADWAY", "5TH AVE"), "MARLBORO PIKE WB": ("STREET", "MARLBORO PIKE", None), "UNKNOWN": ("NONE", None, None), "": ("NONE", None, None), "N/A": ("NONE", None, None),
        "300BL CEDARLEAF AVE": ("STREET", "300 CEDARLEAF AVE", None), "5900BLOCK FISHER RD": ("STREET", "5900 FISHER RD", None), "300 BL CEDARLEAF AVE": ("STREET", "300 CEDARLEAF AVE", None), None: ("NONE", None, None),
    }
    assert [tuple(x) for x in many(spark, text.clean_address, cases)] == list(cases.values())
    cases = {"100 n. state st.": "100 NORTH STATE STREET", "100  N   STATE  ST": "100 NORTH STATE STREET", "500 BLVD OF THE ALLIES": "500 BOULEVARD OF THE ALLIES", "": ""}
    assert many(spark, text.normalize_address, cases) == list(cases.values())
    assert one(spark, text.normalize_street, "100", "N STATE ST") == "100 NORTH STATE STREET" and one(spark, text.normalize_street, "100", "") == ""
    assert many(spark, text.normalize_state, ["il", " dc ", "New York"]) == ["IL", "DC", "NEW YORK"]


def test_dates(spark):
    at = dt.datetime(2024, 1, 15, 14, 30)
    good = ["2024-01-15T14:30:00.000", "2024-01-15T14:30:00", "2024-01-15T14:30:00Z", "2024-01-15T14:30:00+00:00", "2024-01-15 14:30:00+00", "2024-01-15 14:30:00.0", "2024-01-15 14:30:00"]
    assert many(spark, lambda c: text.timestamp(c).cast("timestamp_ntz"), good) == [at] * 7
    assert many(spark, text.timestamp, ["2024", "12:30", "x", "2024-13-01", ""]) == [None] * 5
    ntz = lambda f: lambda *c: f(*c).cast("timestamp_ntz")
    assert one(spark, ntz(text.timestamp), "2024-01-15") == dt.datetime(2024, 1, 15)
    assert one(spark, ntz(text.timestamp_hhmm), "2024-01-15", "1430") == at
    assert one(spark, text.timestamp_hhmm, "2024-01-15", "2561") is None and one(spark, ntz(text.timestamp_hhmm), "2024-01-15", "930") == dt.datetime(2024, 1, 15)
    assert one(spark, ntz(text.timestamp_hhmmss), "2024-01-15", "14:30:00") == at and one(spark, ntz(text.timestamp_hhmmss), "2024-01-15", "x") == dt.datetime(2024, 1, 15)
    assert one(spark, ntz(text.timestamp_mdy), "01/15/2024") == dt.datetime(2024, 1, 15) and one(spark, text.timestamp_mdy, "2024-01-15") is None
    assert one(spark, lambda c: text.timestamp_ms(c.cast("double")).cast("timestamp_ntz"), "1705329000000") == at


def test_small_functions(spark):
    assert many(spark, text.strip_html, ["<p>a &amp; <b>b</b></p>", " x "]) == ["a & b", "x"]
    assert many(spark, text.slug, ["St. Louis, MO!", "A  b"]) == ["st_louis_mo", "a_b"]
    assert one(spark, lambda a, b: text.joined(" - ", a, b), "x", "") == "x" and one(spark, lambda a, b: text.first_filled(a, b), "", "y") == "y"
    assert one(spark, lambda a: text.geoid_prefix(a, 5), "17031") == "17031" and one(spark, lambda a: text.geoid_prefix(a, 5), "1703") is None
    for lng, lat, ok in (("-87", "41", True), ("0", "41", False), ("-87", "91", False), (None, "41", False)):
        r = one(spark, lambda a, b: text.coordinates(a.try_cast("double"), b.try_cast("double")), lng, lat)
        assert (r.longitude is not None, r.latitude is not None) == (ok, ok)


def test_filters():
    assert filters.csv_list(" a, ,b ,") == ("a", "b") and filters.csv_list(None) == ()
    assert filters.parse_bbox("1,2,3,4") == (1, 2, 3, 4) and filters.parse_bbox("1,x,3,4") is None and filters.parse_bbox("1,2,3,4,5") is None
    assert filters.expand_bbox((-179, -10, -169, 10), 0.25) == (-180.0, -15.0, -166.5, 15.0)
    assert filters.cell(-0.0001) == -1
    with pytest.raises(ValueError):
        filters.Analytics(date_from="yesterday").where()


def test_clusters_number_and_layers():
    assert [api.cluster_number(z) for z in (8, 9, 14, 99)] == [80, 120, 320, 120] and api.cluster_number(8, 0.1) == 1
    assert [api.layer(z) for z in (7, 8, 13)] == ["heatmap", "hexagons", "points"]


def test_edit_distance(spark):
    from itertools import product

    from tests.test_catalogue import osa_within

    cases = [("OAK", "OKA", True), ("OAK", "OAKS", True), ("OAK", "ELM", False), ("", "", True), ("AB", "BAC", False), ("MAIN", "MAIN", True)]
    words = ["".join(w) for n in range(5) for w in product("AB", repeat=n)] + ["ABC", "CBA", "ACB", "BAC", "ABCD", "BADC"]
    df = spark.createDataFrame([(a, b, ok) for a, b, ok in cases] + [(a, b, osa_within(a, b, 1)) for a in words for b in words], "a string, b string, ok boolean")
    assert df.where(geocode.near_word(F.col("a"), F.col("b")) != F.col("ok")).count() == 0
    assert df.where(geocode.near_word(F.col("a"), F.col("b")).isNull()).count() == 0
    pairs = [("1 OAK STREET", "1 OKA STRET", True), ("1 OAK STREET", "1 OAK", False), ("", "", False), ("1 OAK", "1 ELM", False)]
    df = spark.createDataFrame(pairs, "a string, b string, ok boolean")
    assert df.where(geocode.near_words("a", "b") != F.col("ok")).count() == 0


def test_mapping_edge_rows(spark):
    raw = ['{"id": 7, "t": "", "u": "THEFT", "d": "2024-01-15T14:30:00.000", "lat": "41.5", "lng": -87.5, "a": true}', '{"case": "", "id": "x", "t": "zzz", "d": "bad", "lat": "0", "lng": "-87.5"}', '{"t": "ARSON"}', '{"id": 1.5}', '{"id": "p", "loc": {"type": "Point", "coordinates": [-87.5, 41.5]}}']
    df = spark.createDataFrame([(r,) for r in raw], "j string").select(F.parse_json("j").alias("record"))
    s = mapping.Source("s", ("case", "id"), ("t", "u"), ("simple", ("d",)), ("pair", ("lng", "lat")), arrest=("bool", "a", ""), city="C", state="IL")
    got = {r.source_incident_id: r for r in mapping.normalize(df, s).collect()}
    assert set(got) == {"7", "x", "p"}
    a, b = got["7"], got["x"]
    assert (a.subcategory, a.category, a.severity, a.longitude, a.latitude, a.has_coordinates, a.arrest_made) == ("LARCENY_THEFT", "PROPERTY", 2, -87.5, 41.5, True, True)
    assert (b.subcategory, b.occurred_at, b.longitude, b.has_coordinates, b.arrest_made) == ("UNKNOWN", None, 0.0, False, None)
    p = mapping.Source("s", ("id",), ("t",), coordinates=("point", ("loc",)))
    assert {r.source_incident_id: r.longitude for r in mapping.normalize(df, p).collect()}["p"] == -87.5


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "b.json").write_text("no json")
    assert readers.records(readers.pages(spark, str(tmp_path))).count() == 2
    page = spark.createDataFrame([('{"result": {"records": [{"a": 1}]}, "next": "n2", "features": [{"attributes": {"x": "y", "n": 1}, "geometry": {"x": 1.5, "y": 2.5}}]}',)], "j string").select(F.parse_json("j").alias("page"))
    assert readers.records(page, "$.result.records").count() == 1 and page.select(readers.next_cursor(F.col("page"))).first()[0] == "n2"
    f = readers.features(page).select(F.to_json("record").alias("j")).first().j
    assert '"_geometry_x":1.5' in f and '"x":"y"' in f
    (tmp_path / "c.csv").write_text("a, b\n 1 ,x\n2,\n")
    assert [r[0] for r in readers.csv_records(spark, str(tmp_path / "c.csv")).select(F.to_json("record")).collect()] == ['{"a":"1","b":"x"}', '{"a":"2","b":""}']
    lines = spark.createDataFrame([("01/15/2024  THEFT  100 Main St",), ("junk",)], "value string")
    assert [tuple(r) for r in readers.delimited(lines, ["d", "t", "a"]).collect()] == [("01/15/2024", "THEFT", "100 Main St")]
    assert [tuple(r) for r in readers.regex_rows(lines, r"^(\S+)\s+(\S+)\s+(.*)$", ["d", "t", "a"]).collect()] == [("01/15/2024", "THEFT", "100 Main St")]
    assert readers.fixed_columns(lines, {"d": (0, 10), "t": (12, 5)}).first().t == "THEFT"
    assert [r["x"] for r in readers.table_rows("<table><tr><th>x<th>y</th></tr><tr><td>1</td></tr></table>") if "x" in r] in ([], ["1"])
    assert readers.table_rows("<table><tr><th>x</th><th>y</th></tr><tr><td>1</td></tr></table>") == [{"x": "1", "y": ""}]
    assert readers.table_rows(None) == []
    url = spark.range(1).select(readers.monthly_urls("u/{yyyy}-{MM}.pdf", F.lit("2023-11-20").cast("date"), F.lit("2024-01-02").cast("date")).alias("u")).first().u
    assert url == ["u/2023-11.pdf", "u/2023-12.pdf", "u/2024-01.pdf"]


def test_bulletins_and_releases(spark):
    rows = [("p", 1, "<p><strong><u>Robbery</u></strong></p>"), ("p", 2, "<p><strong>Ourtown</strong></p>"), ("p", 3, "<p>100 Main St, Jan 5</p>"), ("p", 4, "<p><strong><u>Theft</u></strong></p>"), ("p", 5, "<p>5 Oak Ave</p>")]
    got = readers.bulletin_entries(spark.createDataFrame(rows, "page string, place int, html string")).orderBy("entry").collect()
    assert [(r.crime_type, r.city, r.entry) for r in got] == [("Robbery", "Ourtown", "100 Main St, Jan 5"), ("Theft", "Ourtown", "5 Oak Ave")]
    body = "On January 5, 2024 officers went to the 100 block of North Main Street after a call."
    assert one(spark, lambda c: readers.release_date(c).cast("date"), body) == dt.date(2024, 1, 5)
    assert one(spark, readers.release_address, body) == "100 block of North Main Street"
    assert one(spark, lambda c: readers.release_date(c).cast("date"), "seen 1/7/2024") == dt.date(2024, 1, 7)
