"""Batch build: raw node, way and relation tables to entities, and their areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import tags as R
from waymark.operators.graph import cut
from waymark.operators.spatial import AreaLookup, points_in_rings, shapes_in_areas, smallest_per_level
from waymark.operators.streets import connect_streets, relation_rings
from waymark.sources.schema import NODE, RELATION, WAY, GeoDataset, numbered, with_box


def needed_nodes(ways: DataFrame) -> DataFrame:
    """The distinct node ids that ways refer to."""
    return ways.select(F.explode("nodes").alias("id")).distinct()


def way_geometry(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways with geometry: the coordinates of their nodes in order; missing nodes are left out, ways without any have an
    empty one. Node coordinates are joined before they are gathered; a way is as large as its own nodes."""
    refs = ways.select("id", F.posexplode("nodes").alias("pos", "ref"))
    points = nodes.select(F.col("id").alias("ref"), F.struct(G.quantize(F.col("lat")).alias("lat_e7"), G.quantize(F.col("lon")).alias("lon_e7")).alias("at"))
    lines = refs.join(points, "ref").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "at"))).alias("l")).select("id", F.transform("l", lambda p: p["at"]).alias("geometry"))
    return ways.join(lines, "id", "left").withColumn("geometry", F.coalesce("geometry", F.array().cast("array<struct<lat_e7:int,lon_e7:int>>")))


def recovered_streets(ways: DataFrame) -> DataFrame:
    """id of streets without a name that touch named ones: connectors of up to 24 nodes with their first or last node,
    roundabouts of up to 128 with any."""
    tags = F.col("tags")
    named = ways.where(R.is_named_street(tags) & (F.size("nodes") >= 2)).select(F.explode(F.array(F.col("nodes")[0], F.element_at("nodes", -1))).alias("node")).distinct()
    candidates = ways.where(R.is_recovery_candidate(tags) & (F.size("nodes") >= 2)).withColumn("round", R.is_roundabout(tags))
    candidates = candidates.where(F.size("nodes") <= F.when(F.col("round"), R.ROUNDABOUT_NODES).otherwise(R.CONNECTOR_NODES))
    touch = F.when(F.col("round"), F.col("nodes")).otherwise(F.array(F.col("nodes")[0], F.element_at("nodes", -1)))
    return candidates.select("id", F.explode(touch).alias("node")).join(named, "node", "left_semi").select("id").distinct()


def member_lines(relations: DataFrame, lines: DataFrame) -> DataFrame:
    """relation_id, role (0 outer, 1 inner), ord, geometry of the way members of relations, in order; ways with fewer than
    two points are dropped. A member without a role is an outer one."""
    m = relations.select(F.col("id").alias("relation_id"), F.posexplode("members").alias("ord", "m")).where("m.type = 'way' and m.role in ('outer', 'inner', '')")
    m = m.select("relation_id", "ord", F.col("m.ref").alias("id"), F.when(F.col("m.role") == "inner", 1).otherwise(0).alias("role"))
    return m.join(lines.where(F.size("geometry") >= 2).select("id", "geometry"), "id").select("relation_id", "role", "ord", "geometry")


def place_inner_rings(rings: DataFrame) -> DataFrame:
    """rings: relation_id, role, ring_no, geometry -> area (an outer ring), ring_no, role, geometry: each inner ring goes
    to the smallest outer ring of its relation that holds its middle vertex; inner rings in none are dropped."""
    outer = rings.where("role = 0").select("relation_id", F.col("ring_no").alias("area"), "geometry")
    probe = G.middle_vertex(F.col("geometry"))
    inner = rings.where("role = 1").select("relation_id", F.col("ring_no").alias("point_id"), probe["lat_e7"].alias("lat_e7"), probe["lon_e7"].alias("lon_e7"))
    box = G.bbox(F.col("geometry"))
    score = G.box_score(*[box[c] for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    found = points_in_rings(inner, outer, "relation_id").join(outer.select("relation_id", "area", score.alias("score")), ["relation_id", "area"])
    best = found.groupBy("relation_id", F.col("point_id").alias("ring_no")).agg(F.min(F.struct("score", "area"))["area"].alias("area"))
    holes = rings.where("role = 1").join(best, ["relation_id", "ring_no"]).select("relation_id", "area", (F.col("ring_no") + 1).alias("ring_no"), F.lit(1).alias("role"), "geometry")
    return outer.select("relation_id", "area", F.lit(0).alias("ring_no"), F.lit(0).alias("role"), "geometry").unionByName(holes)


def _address(tags: Column) -> list[Column]:
    keys = {"house_number": "addr:housenumber", "street": "addr:street", "postcode": "addr:postcode", "city": "addr:city", "country": "addr:country"}
    return [R.tag(tags, k).alias(n) for n, k in keys.items()]


def build_entities(nodes: DataFrame, ways: DataFrame, relations: DataFrame, language: str = "de") -> GeoDataset:
    """Houses, streets, points of interest and areas with their rings. Ids of 0 and below are passed over. idx follows
    (source, osm_id, ring)."""
    nodes, ways, relations = (d.where("id > 0") for d in (nodes, ways, relations))
    tags = F.col("tags")
    recovered = cut(recovered_streets(ways)).withColumn("recovered", F.lit(True))
    in_relation = relations.where(R.is_boundary(tags) | R.is_building_house(tags)).select(F.explode("members").alias("m")).where("m.type = 'way'").select(F.col("m.ref").alias("id")).distinct().withColumn("wanted", F.lit(True))
    flagged = ways.join(recovered, "id", "left").join(in_relation, "id", "left")
    kinds = R.way_classes(tags, F.coalesce("wanted", F.lit(False)), F.coalesce("recovered", F.lit(False)))
    flagged = flagged.withColumn("kind", kinds).where("kind.needed_for_relation or kind.house or kind.street or kind.admin or kind.poi")
    lines = cut(way_geometry(flagged, nodes.select("id", "lat", "lon")))
    at = lambda p: [p["lat_e7"].alias("lat_e7"), p["lon_e7"].alias("lon_e7")]
    spot = [G.quantize(F.col("lat")).alias("lat_e7"), G.quantize(F.col("lon")).alias("lon_e7")]

    boundary = relations.where(R.is_boundary(tags))
    building = relations.where(R.is_building_house(tags))
    rings = cut(relation_rings(member_lines(boundary.unionByName(building).dropDuplicates(["id"]), lines)))

    some = F.size("geometry") > 0
    houses = nodes.where(R.has_address(tags)).select(F.col("id").alias("osm_id"), *spot, *_address(tags), F.lit(NODE).alias("source"))
    way_houses = lines.where(F.col("kind.house") & some).withColumn("p", G.house_way_point(F.col("geometry")))
    houses = houses.unionByName(way_houses.select(F.col("id").alias("osm_id"), *at(F.col("p")), *_address(tags), F.lit(WAY).alias("source")))
    largest = Window.partitionBy("relation_id").orderBy("ring_no")
    first_ring = rings.where("role = 0").withColumn("rn", F.row_number().over(largest)).where("rn = 1").withColumn("p", G.house_way_point(F.col("geometry")))
    rel_houses = building.join(first_ring, F.col("id") == F.col("relation_id"))
    houses = houses.unionByName(rel_houses.select(F.col("id").alias("osm_id"), *at(F.col("p")), *_address(tags), F.lit(RELATION).alias("source")))
    houses = numbered(houses, F.col("source"), F.col("osm_id")).withColumn("source", F.col("source").cast("byte"))

    streets = lines.where(F.col("kind.street") & (F.size("geometry") >= 2)).select(F.col("id").alias("osm_id"), R.street_name(tags, language).alias("name"), R.tag(tags, "highway").alias("highway"), "geometry")
    streets = with_box(numbered(streets, F.col("osm_id")))

    def poi(df: DataFrame, point: list[Column], source: int) -> DataFrame:
        df = df.withColumn("c", R.poi_class(tags))
        return df.where("c.category != ''").select(F.col("id").alias("osm_id"), *point, R.poi_name(tags, language).alias("name"), F.col("c.category").alias("category"), F.col("c.key").alias("tag_key"), F.col("c.value").alias("tag_value"), R.tag(tags, "brand").alias("brand"), F.lit(source).alias("source"))

    pois = poi(nodes, spot, NODE).unionByName(poi(lines.where(F.col("kind.poi") & some).withColumn("p", G.mean_point(F.col("geometry"))), at(F.col("p")), WAY))
    pois = numbered(pois, F.col("source"), F.col("osm_id")).withColumn("source", F.col("source").cast("byte"))

    named = lambda df: df.withColumn("name", R.first_of(R.localized(tags, "name", language), F.concat(F.lit("admin_"), F.col("id").cast("string")))).withColumn("admin_level", R.admin_level(tags).cast("byte"))
    closed = (F.size("geometry") >= 4) & (F.col("geometry")[0] == F.element_at("geometry", -1))
    way_areas = named(lines.where(F.col("kind.admin") & closed)).select(F.col("id").alias("osm_id"), "name", "admin_level", F.lit(WAY).alias("source"), F.lit(0).alias("area"), F.col("geometry").alias("outer"))
    placed = cut(place_inner_rings(rings.join(boundary.select(F.col("id").alias("relation_id")), "relation_id", "left_semi")))
    rel_areas = named(boundary).join(placed.where("role = 0"), F.col("id") == F.col("relation_id")).select(F.col("id").alias("osm_id"), "name", "admin_level", F.lit(RELATION).alias("source"), "area", F.col("geometry").alias("outer"))
    areas = cut(numbered(way_areas.unionByName(rel_areas), F.col("source"), F.col("osm_id"), F.col("area")))
    holes = placed.where("role = 1").join(areas.where(F.col("source") == RELATION).select("idx", F.col("osm_id").alias("relation_id"), "area"), ["relation_id", "area"])
    all_rings = areas.select(F.col("idx").alias("area_idx"), F.lit(0).alias("ring_no"), F.lit(0).alias("role"), F.col("outer").alias("geometry")).unionByName(holes.select(F.col("idx").alias("area_idx"), "ring_no", "role", "geometry"))
    return GeoDataset({
        "houses": houses,
        "streets": streets,
        "pois": pois,
        "admin_areas": with_box(areas.drop("area").withColumn("source", F.col("source").cast("byte")), "outer"),
        "admin_rings": all_rings.withColumn("role", F.col("role").cast("byte")),
    }, language)


def _ordered_links(pairs: DataFrame, areas: DataFrame) -> DataFrame:
    """pairs: idx, area_idx -> with ord, by (admin level, osm id)."""
    out = pairs.join(areas.select(F.col("idx").alias("area_idx"), "admin_level", "osm_id"), "area_idx")
    # an entity is in few areas; as a set they need one shuffle
    sets = out.groupBy("idx").agg(F.array_sort(F.collect_set(F.struct("admin_level", "osm_id", "area_idx"))).alias("s"))
    return sets.select("idx", F.posexplode("s").alias("ord", "a")).select("idx", "ord", "a.area_idx")


def attribute(data: GeoDataset) -> GeoDataset:
    """Adds house_admin, street_admin (any vertex), poi_admin and admin_parent (per lower level the smallest area around
    an interior point)."""
    areas = data.admin_areas
    at = AreaLookup(areas, data.admin_rings)

    def links(df: DataFrame) -> DataFrame:
        return shapes_in_areas(df.select("idx", "lat_e7", "lon_e7"), at)

    # FEW_AREAS rows at most
    order = [] if at.rows is None else [r["idx"] for r in areas.select("idx", "admin_level", "osm_id").orderBy("admin_level", "osm_id", "idx").collect()]

    def ordered(df: DataFrame) -> DataFrame:
        return at.ordered(df.select("idx", "lat_e7", "lon_e7"), order) if order else _ordered_links(links(df), areas)

    vertices = data.streets.select("idx", F.explode("geometry").alias("p")).select("idx", "p.lat_e7", "p.lon_e7")
    inner = cut(areas.select("idx", "admin_level", G.admin_interior_point(F.col("outer")).alias("p"))).select("idx", "admin_level", "p.lat_e7", "p.lon_e7")
    up = links(inner).join(inner.select("idx", F.col("admin_level").alias("own")), "idx").join(areas.select(F.col("idx").alias("area_idx"), "admin_level"), "area_idx").where("admin_level < own")
    parents = smallest_per_level(up.select("idx", "area_idx"), "idx", areas)
    tables = {
        "house_admin": ordered(data.houses),
        "street_admin": ordered(vertices),
        "poi_admin": ordered(data.pois),
        "admin_parent": _ordered_links(parents, areas),
    }
    return GeoDataset(data.tables | tables, data.language)


def build(nodes: DataFrame, ways: DataFrame, relations: DataFrame, language: str = "de", connect: bool = False) -> GeoDataset:
    """Everything but the text index, which plans.index.add_index builds."""
    data = build_entities(nodes, ways, relations, language)
    return attribute(connected(data) if connect else data)


def connected(data: GeoDataset) -> GeoDataset:
    """data with its streets connected; areas of streets and the text index have to be built again."""
    lines = connect_streets(data.streets)
    streets = with_box(numbered(lines, F.col("component"), F.col("osm_id"), F.col("geometry")).drop("component"))
    keep = {n: t for n, t in data.tables.items() if n not in ("street_admin", "postings_context", "postings_primary", "search_docs", "vocabulary")}
    return GeoDataset(keep | {"streets": streets}, data.language)


def counters(data: GeoDataset) -> DataFrame:
    """One row of counts over all tables."""
    one = lambda df, *aggs: df.agg(*aggs)
    count_if = lambda c, n: F.count_if(c).alias(n)
    n = F.count("*")
    parts = [
        one(data.houses, n.alias("houses"), *[count_if(F.col("source") == s, f"houses_from_{k}") for s, k in ((1, "nodes"), (2, "ways"), (3, "relations"))]),
        one(data.streets, n.alias("streets"), count_if(F.col("name") == "", "unnamed_streets"), F.coalesce(F.sum(F.size("geometry")), F.lit(0)).alias("street_points")),
        one(data.pois, n.alias("pois"), *[count_if(F.col("source") == s, f"pois_from_{k}") for s, k in ((1, "nodes"), (2, "ways"))]),
        one(data.admin_areas, n.alias("admin_areas"), F.count_distinct("admin_level").alias("admin_levels")),
        one(data.admin_rings, count_if(F.col("role") == 1, "inner_rings"), F.coalesce(F.sum(F.size("geometry")), F.lit(0)).alias("ring_points")),
    ]
    for name in ("house_admin", "street_admin", "poi_admin", "admin_parent"):
        if name in data.tables:
            parts.append(one(data.tables[name], n.alias(f"{name}_links"), F.count_distinct("idx").alias(f"{name}_linked")))
    if data.indexed:
        parts += [one(data.vocabulary, n.alias("vocabulary_tokens")), one(data.postings_context, n.alias("context_postings")), one(data.postings_primary, n.alias("primary_postings"))]
        parts.append(data.postings_context.groupBy("token").count().agg(F.max("count").alias("largest_context_list")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
