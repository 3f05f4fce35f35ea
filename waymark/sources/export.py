"""JSON of entities, and GeoJSON export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import tags as R
from waymark.sources.schema import GeoDataset


def _pairs(geometry: Column, lon_first: bool) -> Column:
    lat, lon = (lambda p, c=c: F.round(G.degrees(p[c]), 7) for c in ("lat_e7", "lon_e7"))
    return F.transform(geometry, lambda p: F.array(lon(p), lat(p)) if lon_first else F.array(lat(p), lon(p)))


def house_json(houses: DataFrame) -> DataFrame:
    """idx, json of each house; coordinates are [lat, lon]."""
    c = F.struct(F.col("osm_id").alias("id"), F.round(G.degrees(F.col("lat_e7")), 7).alias("lat"), F.round(G.degrees(F.col("lon_e7")), 7).alias("lon"), "street", F.col("house_number").alias("number"), "city", "postcode", "country")
    return houses.select("idx", F.to_json(c).alias("json"))


def street_json(streets: DataFrame) -> DataFrame:
    c = F.struct(F.col("osm_id").alias("id"), "name", R.street_label(F.col("name"), F.col("highway")).alias("label"), "highway", _pairs(F.col("geometry"), False).alias("geometry"))
    return streets.select("idx", F.to_json(c).alias("json"))


def poi_json(pois: DataFrame) -> DataFrame:
    label = R.poi_label(F.col("name"), F.col("brand"), F.col("category"))
    c = F.struct(F.col("osm_id").alias("id"), "name", label.alias("label"), "brand", "category", "tag_key", "tag_value", F.round(G.degrees(F.col("lat_e7")), 7).alias("lat"), F.round(G.degrees(F.col("lon_e7")), 7).alias("lon"))
    return pois.select("idx", F.to_json(c).alias("json"))


def admin_json(areas: DataFrame, max_points: int | None = 500) -> DataFrame:
    """Geometry is thinned to max_points, unless None; geometry_meta says from what to what."""
    g = F.col("outer") if max_points is None else F.when(F.size("outer") > max_points, G.thin(F.col("outer"), max_points)).otherwise(F.col("outer"))
    meta = F.struct(F.size("outer").alias("source_points"), F.size(g).alias("written_points"), (F.size(g) < F.size("outer")).alias("simplified"))
    c = F.struct(F.col("idx").alias("index"), F.col("osm_id").alias("id"), "name", F.col("admin_level").alias("level"), _pairs(g, False).alias("geometry"), meta.alias("geometry_meta"))
    return areas.select("idx", F.to_json(c).alias("json"))


def features(data: GeoDataset, max_houses: int = 25_000, max_streets: int = 5_000, max_admin: int = 500) -> DataFrame:
    """GeoJSON features (ord, json): the first houses, streets and areas by idx. Streets of one point and areas of fewer
    than 4 are left out after the limit. Coordinates are [lon, lat]."""
    first = lambda df, n: df.orderBy("idx").limit(n)
    feature = lambda kind, coordinates, props: F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), props.alias("properties")))
    point = F.array(F.round(G.degrees(F.col("lon_e7")), 7), F.round(G.degrees(F.col("lat_e7")), 7))
    houses = first(data.houses, max_houses).select(F.lit(1).alias("kind"), "idx", feature("Point", point, F.struct(F.lit("house").alias("kind"), "osm_id", "house_number", "street", "postcode", "city", "country")).alias("json"))
    streets = first(data.streets, max_streets).where(F.size("geometry") >= 2).select(F.lit(2).alias("kind"), "idx", feature("LineString", _pairs(F.col("geometry"), True), F.struct(F.lit("street").alias("kind"), "osm_id", "name", "highway")).alias("json"))
    areas = first(data.admin_areas, max_admin).where(F.size("outer") >= 4)
    holes = data.admin_rings.where("role = 1").groupBy(F.col("area_idx").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("ring_no", _pairs(F.col("geometry"), True).alias("ring")))).alias("holes"))
    areas = areas.join(holes, "idx", "left")
    polygon = F.concat(F.array(_pairs(F.col("outer"), True)), F.transform(F.coalesce("holes", F.array().cast("array<struct<ring_no:int,ring:array<array<double>>>>")), lambda h: h["ring"]))
    admin = areas.select(F.lit(3).alias("kind"), "idx", feature("Polygon", polygon, F.struct(F.lit("admin").alias("kind"), "osm_id", "name", "admin_level")).alias("json"))
    return houses.unionByName(streets).unionByName(admin)


def write_geojson(data: GeoDataset, path: str, **limits: int) -> None:
    """One FeatureCollection at `path`, a folder with one text file. The number of features is bounded by the limits."""
    rows = features(data, **limits).groupBy().agg(F.array_sort(F.collect_list(F.struct("kind", "idx", "json"))).alias("all"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.transform("all", lambda r: r["json"])), F.lit("]}"))
    rows.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
