"""Concept and category search around an origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import rules as K
from waymark.functions import text as X
from waymark.functions.bind import bind
from waymark.functions.intent import CONCEPT, Intent
from waymark.functions.tags import poi_label
from waymark.operators.forward import lits
from waymark.operators.graph import cut

# How many anchors count and how far each search goes, in rings of cells.
ANCHORS, CENTRES, ANCHOR_RINGS, NEAR_RINGS, CONCEPT_RINGS = 48, 12, 96, 64, 192
ANCHOR_POOL = 512

Point = tuple[int, int]
Box = tuple[int, int, int, int]


def _ring(lat: Column, lon: Column, centre: Point) -> Column:
    """Chebyshev distance in cells from the cell of centre."""
    return F.greatest(F.abs(G.cell(lat, G.POINT_CELL) - centre[0] // G.POINT_CELL), F.abs(G.cell(lon, G.POINT_CELL) - centre[1] // G.POINT_CELL))


def reference_anchors(pois: DataFrame, category: str, origin: Point, viewport: Box | None = None, limit: int = ANCHORS) -> DataFrame:
    """idx, lat_e7, lon_e7, metres, ord of the POIs of a category nearest the origin: in the viewport, and around the
    origin in rings until there are `limit`, 96 at most."""
    at = [F.col("lat_e7"), F.col("lon_e7")]
    rows = pois.where(K.in_category(F.col("category"), F.col("tag_value"), category))
    seen = G.in_box(*at, *viewport) if viewport else F.lit(False)
    rows = rows.select("idx", *at, G.distance_m(F.lit(origin[0]), F.lit(origin[1]), *at).alias("metres"), _ring(*at, origin).alias("ring"), seen.alias("seen")).where(F.col("seen") | (F.col("ring") <= ANCHOR_RINGS))
    # a ring is searched while the viewport and the rings before it hold fewer than limit
    rings = rows.where("not seen").groupBy("ring").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen_n = rows.where("seen").agg(F.count("*").alias("in_view"))
    open_ = rings.withColumn("before", before).crossJoin(seen_n).where(F.col("before") + F.col("in_view") < limit).select("ring")  # one row
    kept = rows.where("seen").unionByName(rows.where("not seen").join(open_, "ring", "left_semi").select(*rows.columns))
    top = kept.orderBy("metres", "idx").limit(min(limit, ANCHOR_POOL))
    return top.withColumn("ord", F.row_number().over(Window.orderBy("metres", "idx")) - 1).select("idx", "lat_e7", "lon_e7", "metres", "ord")


def collect_in_rings(matches: DataFrame, centres: list[Point], rings: int, wanted: int) -> DataFrame:
    """Of matches (idx, lat_e7, lon_e7) those that a search meets before it has `wanted`: centre by centre, ring by ring,
    cell by cell in row order, each idx once; the cell that reaches the number is read to its end."""
    at = [F.col("lat_e7"), F.col("lon_e7")]
    each = F.array(*[F.struct(F.lit(i).alias("centre"), _ring(*at, c).alias("ring")) for i, c in enumerate(centres)])
    first = F.array_min(F.filter(each, lambda e: e["ring"] <= rings))
    rows = matches.withColumn("_f", first).where("_f is not null")
    rows = rows.select(*matches.columns, "_f.centre", "_f.ring", G.cell(at[0], G.POINT_CELL).alias("lat_cell"), G.cell(at[1], G.POINT_CELL).alias("lon_cell"))
    key = ["centre", "ring", "lat_cell", "lon_cell"]
    cells = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = cells.withColumn("before", before).where(F.col("before") < wanted).select(*key)
    return rows.join(open_, key, "left_semi").select(*matches.columns)


def natural_score(weight: Column, relevance: Column, type_score: Column, metres: Column, reference: Column, in_view: Column) -> Column:
    """reference: metres to the nearest anchor, null without one."""
    basis = F.coalesce(reference, metres)
    bonus = F.when(reference.isNotNull(), F.greatest(F.lit(0.0), 620 - reference / 2)).otherwise(0.0)
    return weight * 9.0 + relevance + type_score + bonus + F.when(in_view, 260.0).otherwise(0.0) - F.least(F.lit(520.0), basis / 120)


def nearest_anchor(pois: DataFrame, anchors: DataFrame) -> DataFrame:
    """pois with anchor_idx and reference_m of the nearest of the anchors (48 at most), the first of equally near ones."""
    at = [F.col("lat_e7"), F.col("lon_e7")]
    anchor = F.struct(*[F.radians(G.degrees(c)).alias(n) for c, n in zip(at, ("la", "lo"), strict=True)], "ord", F.col("idx").alias("a_idx"))
    a = anchors.agg(F.collect_list(anchor).alias("_anchors"))  # one row of 48 at most

    def best(p: Column) -> Column:
        """As distance_m, with the radians of either side computed once."""
        apart = lambda c: F.struct(((c["lo"] - p["lo"]) * F.cos((p["la"] + c["la"]) / 2)).alias("x"), (c["la"] - p["la"]).alias("y"))
        metres = lambda c: bind(apart(c), lambda v: G.EARTH_M * F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))
        return F.array_min(F.transform(p["anchors"], lambda c: F.struct(metres(c).alias("d"), c["ord"].alias("ord"), c["a_idx"].alias("a_idx"))))

    # distances are the work here, so the places are dealt over all cores however small their table is
    spark = pois.sparkSession
    dealt = pois.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "idx")
    own = F.struct(*[F.radians(G.degrees(c)).alias(n) for c, n in zip(at, ("la", "lo"), strict=True)], F.col("_anchors").alias("anchors"))
    found = dealt.crossJoin(F.broadcast(a)).withColumn("b", bind(own, best))
    return found.select(*pois.columns, F.col("b.d").alias("reference_m"), F.col("b.a_idx").alias("anchor_idx"))


def natural_search(pois: DataFrame, intent: Intent, query: str, origin: Point, viewport: Box | None = None, use_viewport: bool = True, limit: int = 10, exact: bool = False) -> DataFrame:
    """rank, idx, label, weight, score, metres, reference_m, anchor_idx, in_view, lat, lon of the POIs that offer what an intent
    asks for, best first. exact: rank all within reach, not only the first 8 * limit that the rings meet."""
    limit = min(max(limit, 1), 50)
    at = [F.col("lat_e7"), F.col("lon_e7")]
    anchors, points = None, []
    if intent.reference_category:
        anchors = cut(reference_anchors(pois, intent.reference_category, origin, viewport if use_viewport else None))
        points = [(r["lat_e7"], r["lon_e7"]) for r in anchors.orderBy("ord").collect()]  # 48 at most
    weight = K.concept_weight(F.col("tag_key"), F.col("tag_value"), intent.concept, intent.product_family) if intent.type == CONCEPT else F.when(K.in_category(F.col("category"), F.col("tag_value"), intent.category), 100).otherwise(0)
    matches = pois.withColumn("weight", weight).where("weight > 0")
    rings = CONCEPT_RINGS if not points and intent.type == CONCEPT else NEAR_RINGS
    found = collect_in_rings(matches, [*points[:CENTRES], origin], rings, 2**62 if exact else limit * 8)
    found = nearest_anchor(found, anchors) if points else found.withColumn("reference_m", F.lit(None).cast("double")).withColumn("anchor_idx", F.lit(None).cast("int"))
    toks, label = lits(X.tokens_py(query)), poi_label(F.col("name"), F.col("brand"), F.col("category"))
    relevance = K.text_relevance(F.col("name"), F.col("brand"), label, F.col("category"), F.col("tag_value"), toks, F.lit(X.normalize_py(query)))
    metres = G.distance_m(F.lit(origin[0]), F.lit(origin[1]), *at)
    in_view = G.in_box(*at, *viewport) if viewport else F.lit(False)
    rows = found.select("idx", label.alias("label"), "weight", metres.alias("metres"), "reference_m", "anchor_idx", in_view.alias("in_view"), relevance.alias("_r"), K.type_score(F.col("tag_key"), F.col("tag_value"), toks).alias("_t"), G.degrees(at[0]).alias("lat"), G.degrees(at[1]).alias("lon"))
    rows = rows.withColumn("score", natural_score(F.col("weight"), F.col("_r"), F.col("_t"), F.col("metres"), F.col("reference_m"), F.col("in_view")))
    order = [F.desc("score"), F.desc("weight"), F.desc("in_view"), F.desc(F.col("reference_m").isNotNull()), F.asc_nulls_last("reference_m"), F.asc("metres"), F.asc("idx")]
    top = rows.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "idx", "label", "weight", "score", "metres", "reference_m", "anchor_idx", "in_view", "lat", "lon")
