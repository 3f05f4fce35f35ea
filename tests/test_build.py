"""The batch build, the engine and the sinks on the town made by hand."""

import json

import pytest
from pyspark.sql import functions as F

from osm_fixture import raw
from waymark.api import GeoEngine, clamp, coordinate
from waymark.operators.forward import QueryError
from waymark.sources.schema import GeoDataset
from waymark.sources.snapshot import stored_bytes


@pytest.fixture(scope="module")
def engine(spark):
    from waymark.operators.graph import cut

    e = GeoEngine.parse(*raw(spark))
    return GeoEngine(GeoDataset({n: cut(t) for n, t in e.data.tables.items()}, "de"))


def test_houses(engine):
    rows = engine.data.houses.orderBy("idx").collect()
    assert [(r["osm_id"], r["source"]) for r in rows] == [(1, 1), (2, 1), (30, 2)]
    assert (rows[2]["lat_e7"], rows[2]["lon_e7"]) == (480502000, 90502000)


def test_streets(engine):
    rows = {r["osm_id"]: r for r in engine.data.streets.collect()}
    assert set(rows) == {10, 11, 12, 13, 14, 16, 19}
    assert rows[19]["name"] == "A 5" and rows[14]["name"] == ""
    assert len(rows[14]["geometry"]) == 2


def test_pois(engine):
    rows = {r["osm_id"]: (r["name"], r["category"], r["tag_value"]) for r in engine.data.pois.collect()}
    assert rows == {3: ("Café Blau", "cafe", "cafe"), 4: ("Rosengarten", "park", "garden"), 5: ("Fon", "shop", "mobile_phone"), 7: ("Markt Eins", "shop", "supermarket")}


def test_areas(engine):
    rows = engine.data.admin_areas.orderBy("idx").collect()
    assert [(r["name"], r["admin_level"]) for r in rows] == [("Altstadt", 9), ("Musterstadt", 8), ("Musterstadt", 8)]
    inner = engine.data.admin_rings.where("role = 1").collect()
    assert len(inner) == 1 and rows[inner[0]["area_idx"]]["min_lat"] == 480000000


def test_links(engine):
    parents = [(r["idx"], r["area_idx"]) for r in engine.data.admin_parent.collect()]
    assert parents == [(0, 1)]
    assert {(r["idx"], r["ord"], r["area_idx"]) for r in engine.data.house_admin.collect()} == {(i, o, a) for i in range(3) for o, a in ((0, 1), (1, 0))}


def test_reverse(engine, spark):
    points = spark.createDataFrame([(1, 48.051018, 9.051), (2, 48.0505, 9.06013), (3, 48.5, 9.5), (4, 48.3, 9.3), (5, 95.0, 0.0), (6, 0.0, 0.0)], "point_id long, lat double, lon double")
    results = engine.reverse(points)
    got = {r["point_id"]: (r["result_type"], r["label"]) for r in results.collect()}
    assert got[1] == ("house", "Königstraße 1")
    assert got[2] == ("street", "Königstraße")
    assert got[4] == ("admin_area", "Musterstadt") and got[3] == ("admin_area", "Musterstadt")  # 3 lies in the hole: nearest outline
    assert got[5] == ("none", None) and got[6] == ("none", None)
    areas = {(r["point_id"], r["area_idx"]) for r in engine.reverse_areas(points, results).collect()}
    assert {(1, 0), (1, 1), (2, 0), (2, 1), (4, 1)} <= areas


def test_geocode_address(engine):
    answer = engine.geocode("Königstr. 1 Musterstadt")
    assert answer.info["address_resolution"] in ("exact_house", "street_level")
    house = engine.geocode("Königstraße 1 Musterstadt")
    assert house.info["exact_house"] and house.rows.first()["label"] == "Königstraße 1"
    missing = engine.geocode("Königstraße 99 Musterstadt")
    assert missing.info["address_resolution"] == "street_level" and missing.rows.first()["type_name"] == "street"
    assert engine.geocode("Königstraße 99 Musterstadt", type="house").info["address_resolution"] == "house_not_found"


def test_geocode_names(engine):
    assert engine.geocode("Musterstadt").rows.first()["type_name"] == "admin_area"
    assert engine.geocode("Rosengarten").rows.first()["label"] == "Rosengarten"
    assert engine.geocode("rosengartn").rows.first()["label"] == "Rosengarten"  # fuzzy
    top = engine.geocode("Königstraße Musterstadt").rows.first()
    assert top["label"] == "Königstraße" and top["score"] > 1000


@pytest.mark.parametrize(("q", "message"), [("", "missing"), ("-5 Weg", "negative"), ("strasse", "broad"), ("12 Musterstadt", "street name")])
def test_query_errors(engine, q, message):
    with pytest.raises(QueryError, match=message):
        engine.geocode(q)


def test_natural(engine):
    cafe = engine.natural("find a cafe", lat=48.06, lon=9.06)
    assert cafe.info["intent"] == "nearest_category_to_address" and cafe.rows.first()["label"] == "Café Blau"
    phone = engine.natural("where can I buy a phone charger near a supermarket", lat=48.06, lon=9.06)
    assert phone.info["reference_category"] == "supermarket"
    assert [r["label"] for r in phone.rows.collect()] == ["Fon", "Markt Eins"]
    assert engine.natural("phone charger").rows.count() == 0  # no origin
    assert engine.natural("phone charger", lat=48.06, lon=9.06, type="house").rows.count() == 0
    with pytest.raises(QueryError):
        engine.natural("")


def test_model_answers(engine):
    said = json.dumps({"intent": "nearest_category_to_address", "category": "school", "address": "nowhere"})
    e = GeoEngine(engine.data, generate=lambda prompt: said)
    assert e.natural("usb cable", lat=48.06, lon=9.06, use_model=True).info["concept"] == "electronics_accessories"


def test_viewport(engine):
    assert engine.houses(48, 49, 9, 10).count() == 3
    assert engine.streets(48.0499, 48.0501, 9, 10).select("osm_id").first()[0] == 10
    assert engine.areas(48, 48.5, 9, 9.5).count() == 2
    assert engine.area(osm_id=45).first()["name"] == "Altstadt"
    with pytest.raises(ValueError):
        engine.area()
    with pytest.raises(ValueError):
        engine.houses(49, 48, 9, 10)


def test_snapshot_and_geojson(engine, spark, tmp_path):
    engine.save(str(tmp_path / "snap"))
    held = {r["name"]: (r["files"], r["bytes"]) for r in stored_bytes(spark, str(tmp_path / "snap")).collect()}
    on_disk = {n: sorted((tmp_path / "snap").glob(f"0*/{n}/*.parquet")) for n in engine.data.tables}
    assert held == {n: (len(files), sum(f.stat().st_size for f in files)) for n, files in on_disk.items()}
    again = GeoEngine.load(spark, str(tmp_path / "snap"))
    assert again.stats().first().asDict() == engine.stats().first().asDict()
    assert again.geocode("Rosengarten").rows.first()["label"] == "Rosengarten"
    with pytest.raises(ValueError):
        GeoEngine.load(spark, str(tmp_path / "nothing"))
    # a second save that fails leaves the first; one of the snapshot itself goes through
    broken = GeoDataset(engine.data.tables | {"pois": engine.data.pois.withColumn("name", F.raise_error(F.lit("lost")))}, "de")
    with pytest.raises(Exception, match="lost"):
        GeoEngine(broken).save(str(tmp_path / "snap"))
    again = GeoEngine.load(spark, str(tmp_path / "snap"))
    assert again.data.pois.count() == 4 and again.data.houses.count() == 3
    GeoEngine(GeoDataset(again.data.tables | {"houses": again.data.houses.limit(1)}, "de")).save(str(tmp_path / "snap"))
    assert GeoEngine.load(spark, str(tmp_path / "snap")).data.houses.count() == 1
    engine.export_geojson(str(tmp_path / "geo"))
    collection = json.loads(spark.read.text(str(tmp_path / "geo"), wholetext=True).first()[0])
    kinds = [f["geometry"]["type"] for f in collection["features"]]
    assert kinds.count("Point") == 3 and kinds.count("LineString") == 7 and kinds.count("Polygon") == 3
    assert max(len(f["geometry"]["coordinates"]) for f in collection["features"] if f["geometry"]["type"] == "Polygon") == 2


def test_connected(engine, spark, tmp_path):
    from waymark.plans.build import connected

    rows = connected(engine.data).streets.where("name = 'Königstraße'").collect()
    assert sorted((r["osm_id"], len(r["geometry"])) for r in rows) == [(10, 2), (11, 2), (12, 2), (13, 2)]


def test_parameters():
    assert coordinate("48.5", 90) == 485000000 and coordinate("48.5x", 90) is None and coordinate(91, 90) is None and coordinate("nan", 90) is None
    assert clamp("7", 1, 5, 3) == 5 and clamp("x", 1, 5, 3) == 3
