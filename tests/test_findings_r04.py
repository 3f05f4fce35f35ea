"""Findings of round 4: work that grows with the tables is left out where its outcome isn't asked for."""

from pyspark.sql import functions as F

from waymark.operators import reverse
from waymark.operators.forward import Forward
from waymark.operators.spatial import AreaLookup, shapes_in_areas
from waymark.plans import build as B
from waymark.plans import index as IX
from waymark.plans import views as V
from waymark.sources.schema import GeoDataset


def test_links_from_masks(spark, sf):
    d = V.dataset(spark, sf)
    at = AreaLookup(d.admin_areas, d.admin_rings)
    order = [r["idx"] for r in d.admin_areas.orderBy("admin_level", "osm_id", "idx").collect()]
    shapes = V.nodes(spark, sf).select((F.col("id") % 40).cast("int").alias("idx"), "lat_e7", "lon_e7")
    got = {tuple(r) for r in at.ordered(shapes, order).collect()}
    at.rows = None
    want = {tuple(r) for r in B._ordered_links(shapes_in_areas(shapes, at), d.admin_areas).collect()}
    assert got == want and len({r[0] for r in got}) == 40


def test_points_on_vertices_meet_no_segments(spark, sf, monkeypatch):
    d = V.dataset(spark, sf)
    line = d.streets.select(F.explode("geometry").alias("p")).select("p.*").distinct().limit(20)
    points = line.select(F.monotonically_increasing_id().alias("point_id"), (F.col("lat_e7") / 1e7).alias("lat"), (F.col("lon_e7") / 1e7).alias("lon")).localCheckpoint()
    monkeypatch.setattr(reverse, "nearest_lines", lambda *a: 1 / 0)
    assert {r["result_type"] for r in reverse.reverse_types(points, B.attribute(d)).collect()} <= {"house", "street"}


def test_a_text_without_area_words_reads_no_context(spark, sf):
    words = IX.add_words(B.attribute(V.dataset(spark, sf)))
    data = GeoDataset(words.tables | {"postings_context": None}, words.language)
    assert Forward(data, "blue bolt").results().count() > 0
