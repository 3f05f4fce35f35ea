"""Spatial joins: points in polygons, nearest objects, boxes. All are equi-joins on grid cells with exact filters after."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geometry as G
from waymark.operators.graph import BROADCAST_ROWS, cut, small
from waymark.operators.segments import nearest_segments
from waymark.sources.schema import numbered

#: Places and segments that are held at once by a task of nearest_lines; classes of directions that segments are dealt by.
PLACES, SEGMENTS, DIRECTIONS = 400_000, 600_000, 256
#: Cells of a cover on each side (the bits of a long), and edges of a ring from which its area has one.
COVER, COVERED = 64, 256
#: Areas up to which all have a cover.
FEW_AREAS = 1_000


def _edges(rings: DataFrame) -> DataFrame:
    """rings: area_idx, ring_no, role, geometry (closed, 4 points or more count) -> area_idx, ring_no, role, a_lat, a_lon, b_lat,
    b_lon of edges. Edges without length are left out."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("geometry") - 1), lambda i: F.struct(F.get("geometry", i - 1).alias("a"), F.get("geometry", i).alias("b")))
    e = rings.where(F.size("geometry") >= 4).select("area_idx", "ring_no", "role", F.explode(pairs).alias("e"))
    e = e.select("area_idx", "ring_no", "role", *[F.col(f"e.{p}.{c}_e7").alias(f"{p}_{c}") for p in "ab" for c in ("lat", "lon")])
    return e.where("a_lat != b_lat or a_lon != b_lon")


def ring_edges(rings: DataFrame) -> DataFrame:
    """The edges of rings, each in every latitude band that it touches: area_idx, ring_no, role, band, a_lat, a_lon, b_lat, b_lon."""
    e = _edges(rings)
    lo, hi = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    return e.withColumn("band", F.explode(F.sequence(G.cell(lo, G.EDGE_BAND), G.cell(hi, G.EDGE_BAND))))


def _in_rings(near: DataFrame, edges: DataFrame) -> DataFrame:
    """near: point_id, lat_e7, lon_e7, area_idx; edges as of ring_edges -> point_id, area_idx of the points in an outer ring and in
    no inner ring of the area. Edges of the point's latitude band only; the parity of crossings is an aggregate, so a
    polygon is never held as one value beside a point."""
    edge = near.withColumn("band", G.cell(F.col("lat_e7"), G.EDGE_BAND)).join(edges, ["area_idx", "band"])
    at = [F.col(c) for c in ("lat_e7", "lon_e7", "a_lat", "a_lon", "b_lat", "b_lon")]
    by_ring = edge.groupBy("point_id", "lat_e7", "lon_e7", "area_idx", "ring_no", "role").agg(F.bool_or(G.on_edge(*at)).alias("edge"), F.sum(G.crosses(*at).cast("int")).alias("crossings"))
    by_ring = by_ring.withColumn("inside", F.col("edge") | (F.col("crossings") % 2 == 1))
    by_area = by_ring.groupBy("point_id", "area_idx").agg(F.bool_or((F.col("role") == 0) & F.col("inside")).alias("outer"), F.bool_or((F.col("role") == 1) & F.col("inside")).alias("inner"))
    return by_area.where("`outer` and not `inner`").select("point_id", "area_idx")


def _side(lo: str, hi: str) -> Column:
    """Height or width of the cells of a cover over a box."""
    return F.ceil((F.col(hi).cast("long") - F.col(lo) + 1) / COVER).cast("long")


def cell_cover(areas: DataFrame, rings: DataFrame, least: int | None = None) -> DataFrame:
    """areas: idx and box; rings: area_idx, ring_no, role, geometry -> area_idx, row, full, partial: COVER rows of COVER cells over the
    box of each area that has a ring of `least` edges or more (COVERED, if not given), its columns as bits. A cell that an edge comes near is partial; of the
    others those whose middle is in an outer ring and in no inner ring are full, and so is every point in them. Areas
    with a ring that isn't closed have no cover. At most COVER rows an area, fewer than its edges."""
    closed = F.col("geometry")[0] == F.element_at("geometry", -1)
    sizes = rings.where(F.size("geometry") >= 4).groupBy("area_idx").agg(F.max(F.size("geometry") - 1).alias("edges"), F.bool_and(closed).alias("closed"))
    boxes = areas.select(F.col("idx").alias("area_idx"), F.col("min_lat").cast("long").alias("lat0"), F.col("min_lon").cast("long").alias("lon0"), _side("min_lat", "max_lat").alias("h"), _side("min_lon", "max_lon").alias("w"))
    large = sizes.where((F.col("edges") >= (COVERED if least is None else least)) & F.col("closed")).join(boxes, "area_idx")
    pairs = F.transform(F.sequence(F.lit(1), F.size("geometry") - 1), lambda i: F.struct(F.get("geometry", i - 1).alias("a"), F.get("geometry", i).alias("b")))
    e = rings.where(F.size("geometry") >= 4).join(large, "area_idx").select("area_idx", "ring_no", "role", "lat0", "lon0", "h", "w", F.explode(pairs).alias("e"))
    e = e.select("area_idx", "ring_no", "role", "lat0", "lon0", "h", "w", *[F.col(f"e.{p}.{c}_e7").cast("long").alias(f"{p}_{c}") for p in "ab" for c in ("lat", "lon")])
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    # two units around an edge are more than on_edge allows and than doubles lose
    row = lambda c: F.floor((c - F.col("lat0")) / F.col("h"))
    e = e.withColumn("r0", F.greatest(F.lit(0), row(low - 2))).withColumn("r1", F.least(F.lit(COVER - 1), row(high + 2))).where("r0 <= r1")
    e = e.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("from", F.col("lat0") + F.col("row") * F.col("h"))
    # the part of the edge in the row, as longitudes
    slope = (F.col("b_lon") - F.col("a_lon")) / F.nullif(F.col("b_lat") - F.col("a_lat"), F.lit(0))
    lon_at = lambda lat: F.col("a_lon") + (F.greatest(low, F.least(high, lat)) - F.col("a_lat")) * slope
    ends = lon_at(F.col("from") - 2), lon_at(F.col("from") + F.col("h") + 2)
    west, east = F.coalesce(F.least(*ends), F.least("a_lon", "b_lon")), F.coalesce(F.greatest(*ends), F.greatest("a_lon", "b_lon"))
    column = lambda lon: F.floor((lon - F.col("lon0")) / F.col("w"))
    upto = lambda c: F.when(F.col(c) < 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned(-1L, cast({COVER - 1} - least({COVER - 1}, {c}) as int))"))
    e = e.withColumn("c0", column(west - 2) - 1).withColumn("c1", column(east + 2))
    # cells whose middle has the crossing of the row's middle to its east
    middle = F.col("from") + F.floor(F.col("h") / 2)
    crosses = (F.col("a_lat") > middle) != (F.col("b_lat") > middle)
    e = e.withColumn("k", F.when(crosses, F.floor((F.col("a_lon") + (middle - F.col("a_lat")) * slope - F.col("lon0") - F.floor(F.col("w") / 2)) / F.col("w"))).otherwise(-1))
    by_ring = e.groupBy("area_idx", "row", "ring_no", "role").agg(F.bit_or(upto("c1").bitwiseAND(F.bitwise_not(upto("c0")))).alias("partial"), F.bit_xor(upto("k")).alias("inside"))
    of = lambda role: F.bit_or(F.when(F.col("role") == role, F.col("inside")).otherwise(F.lit(0).cast("long")))
    by_row = by_ring.groupBy("area_idx", "row").agg(F.bit_or("partial").alias("partial"), of(0).alias("outer"), of(1).alias("inner"))
    full = F.col("outer").bitwiseAND(F.bitwise_not(F.col("inner").bitwiseOR(F.col("partial"))))
    return by_row.select("area_idx", F.col("row").cast("int").alias("row"), full.alias("full"), "partial")


def row_edges(areas: DataFrame, rings: DataFrame) -> DataFrame:
    """area_idx, row, ring_no, role, a_lat, a_lon, b_lat, b_lon: the edges of rings, each in every row of its area's box (COVER of them) that it
    comes near, as rows of cell_cover."""
    boxes = areas.select(F.col("idx").alias("area_idx"), F.col("min_lat").cast("long").alias("lat0"), _side("min_lat", "max_lat").alias("h"))
    row = lambda c: F.floor((c.cast("long") - F.col("lat0")) / F.col("h"))
    # two units around an edge are more than on_edge allows
    first, last = F.greatest(F.lit(0), row(F.least("a_lat", "b_lat") - 2)), F.least(F.lit(COVER - 1), row(F.greatest("a_lat", "b_lat") + 2))
    e = _edges(rings).join(boxes, "area_idx").withColumns({"first": first, "last": last}).where("first <= last")
    return e.withColumn("row", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int")))).drop("lat0", "h", "first", "last")


def _in_row(rings: Column) -> Column:
    """Whether the point lat_e7, lon_e7 is in an outer ring and in no inner ring of those whose edges near its row are given."""
    at = lambda e: (F.col("lat_e7"), F.col("lon_e7"), *[e[c] for c in ("a_lat", "a_lon", "b_lat", "b_lon")])
    odd = lambda r: F.aggregate(r["edges"], F.lit(0), lambda n, e: n + G.crosses(*at(e)).cast("int")) % 2 == 1
    inside = lambda role: F.exists(rings, lambda r: (r["role"] == role) & (F.exists(r["edges"], lambda e: G.on_edge(*at(e))) | odd(r)))
    return inside(0) & ~inside(1)


def covered(near: DataFrame, cover: DataFrame, row: bool = False) -> DataFrame:
    """near: point_id, lat_e7, lon_e7, area_idx and the area's box; cover as of cell_cover -> near with `sure`: whether the point is in the area,
    null if only edges can tell; row: also with its row."""
    own = F.floor((F.col("lat_e7") - F.col("min_lat").cast("long")) / _side("min_lat", "max_lat")).cast("int")
    bit = F.floor((F.col("lon_e7") - F.col("min_lon").cast("long")) / _side("min_lon", "max_lon")).cast("int")
    has = lambda mask: F.expr(f"shiftright({mask}, _bit) & 1L") == 1
    known = near.withColumn("row", own).withColumn("_bit", bit).join(cover, ["area_idx", "row"], "left")
    return known.withColumn("sure", F.when(F.col("partial").isNotNull() & ~has("partial"), has("full"))).drop("_bit", "full", "partial", *([] if row else ["row"]))


def points_in_areas(points: DataFrame, areas: DataFrame, rings: DataFrame) -> DataFrame:
    """points: point_id, lat_e7, lon_e7 (distinct rows); areas: idx and box; rings: their rings -> point_id, area_idx for each point in an
    outer ring and in no inner ring of an area. Boundaries count as inside.

    Equi-join on 0.25 degree cells, box, then the cover of the area, which settles all points but those near its outline;
    these, and those of areas of few edges, meet the edges of their latitude band."""
    at = AreaLookup(areas, rings)
    if at.rows is not None:
        return at.inside(points).select("point_id", "area_idx")
    told = at.told(points)
    return told.where("sure").select("point_id", "area_idx").unionByName(_in_rings(told.where("sure is null").drop("sure"), at.edges))


def shapes_in_areas(vertices: DataFrame, at: AreaLookup) -> DataFrame:
    """vertices: idx (not unique), lat_e7, lon_e7 -> idx, area_idx, distinct, of the areas that hold some of an idx's vertices. Covers settle
    vertices where they are, so that what is shuffled are pairs made distinct before, and the vertices near outlines."""
    if at.rows is not None:
        return at.inside(vertices.withColumnRenamed("idx", "point_id")).select(F.col("point_id").alias("idx"), "area_idx").distinct()
    told = at.told(vertices.withColumnRenamed("idx", "point_id"))
    rest = told.where("sure is null").select(F.struct("point_id", "lat_e7", "lon_e7").alias("point_id"), "lat_e7", "lon_e7", "area_idx").distinct()
    found = _in_rings(rest, at.edges).select("point_id.point_id", "area_idx")
    return told.where("sure").select("point_id", "area_idx").unionByName(found).select(F.col("point_id").alias("idx"), "area_idx").distinct()


class AreaLookup:
    """What points meet: the cells of areas' boxes, their covers and their edges; for areas: idx and box, and their rings. Of up to
    FEW_AREAS areas all have a cover, and the tables are computed once and joined by broadcast where they are counted small. If their edges by
    rows are few enough for that too (`rows`), points are settled where they are, those near outlines with the edges of their row."""

    def __init__(self, areas: DataFrame, rings: DataFrame) -> None:
        few = areas.limit(FEW_AREAS + 1).count() <= FEW_AREAS
        kept = lambda df: small(cut(df)) if few else df
        boxes = areas.select(F.col("idx").alias("area_idx"), "min_lat", "max_lat", "min_lon", "max_lon", F.explode(G.cells_of_box(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"), G.ADMIN_CELL)).alias("c"))
        self.boxes = kept(boxes.select("*", "c.lat_cell", "c.lon_cell").drop("c"))
        covers = few or rings.where(F.size("geometry") > COVERED).limit(1).count()
        self.cover = kept(cell_cover(areas, rings, 3 if few else None)) if covers else None
        self.rows = None
        if few:
            rows = cut(row_edges(areas, rings))
            if rows.count() <= BROADCAST_ROWS:
                by_ring = rows.groupBy("area_idx", "row", "ring_no", "role").agg(F.collect_list(F.struct("a_lat", "a_lon", "b_lat", "b_lon")).alias("edges"))
                self.rows = F.broadcast(cut(by_ring.groupBy("area_idx", "row").agg(F.collect_list(F.struct("role", "edges")).alias("rings"))))
        self.edges = kept(ring_edges(rings)) if self.rows is None else ring_edges(rings)

    def inside(self, points: DataFrame) -> DataFrame:
        """point_id, area_idx (not distinct) of points in areas, where `rows` are there."""
        told = covered(self._near(points), self.cover, row=True).where("sure is null or sure")
        # points that are settled have no row, so that no edges are laid beside them
        told = told.select("point_id", "lat_e7", "lon_e7", "area_idx", "sure", F.when(F.col("sure").isNull(), F.col("row")).alias("row"))
        known = told.join(self.rows, ["area_idx", "row"], "left")
        return known.where(F.coalesce("sure", _in_row(F.col("rings")), F.lit(False))).select("point_id", "area_idx")

    def masks(self, shapes: DataFrame, order: list[int]) -> DataFrame:
        """idx, m0, m1, ..: shapes (idx, not unique, lat_e7, lon_e7) in some area, with the places of their areas in `order` as bits. For
        few areas, where `rows` are there."""
        numbers = shapes.sparkSession.createDataFrame([(idx, n) for n, idx in enumerate(order)], "area_idx int, n int")
        pairs = self.inside(shapes.withColumnRenamed("idx", "point_id")).join(F.broadcast(numbers), "area_idx")
        bit = F.expr("shiftleft(1L, n % 64)")
        words = [F.bit_or(F.when(F.floor(F.col("n") / 64) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"m{w}") for w in range(-(-len(order) // 64))]
        return pairs.groupBy(F.col("point_id").alias("idx")).agg(*words)

    def ordered(self, shapes: DataFrame, order: list[int]) -> DataFrame:
        """idx, ord, area_idx of shapes, their areas as in `order`; a row for each shape is shuffled, not for each area."""
        has = lambda n: F.expr(f"shiftright(m{n // 64}, {n % 64}) & 1L") == 1
        own = F.array_remove(F.array(*[F.when(has(n), n).otherwise(-1) for n in range(len(order))]), -1)
        return self.masks(shapes, order).select("idx", F.posexplode(own).alias("ord", "n")).select("idx", "ord", F.get(F.lit(order), F.col("n")).cast("int").alias("area_idx"))

    def _near(self, points: DataFrame) -> DataFrame:
        """Points with the areas whose box holds them, and their boxes."""
        p = points.select("point_id", "lat_e7", "lon_e7", G.cell(F.col("lat_e7"), G.ADMIN_CELL).alias("lat_cell"), G.cell(F.col("lon_e7"), G.ADMIN_CELL).alias("lon_cell"))
        return p.join(self.boxes, ["lat_cell", "lon_cell"]).where(G.in_box(F.col("lat_e7"), F.col("lon_e7"), F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon")))

    def told(self, points: DataFrame) -> DataFrame:
        """point_id, lat_e7, lon_e7, area_idx, sure: points with the areas whose box holds them, and what their covers tell."""
        near = self._near(points)
        if self.cover is None:
            return near.select("point_id", "lat_e7", "lon_e7", "area_idx", F.lit(None).cast("boolean").alias("sure"))
        return covered(near, self.cover).select("point_id", "lat_e7", "lon_e7", "area_idx", "sure")


def points_in_rings(points: DataFrame, rings: DataFrame, by: str) -> DataFrame:
    """points: `by`, point_id, lat_e7, lon_e7; rings: `by`, area, geometry, one row per `by` and area -> `by`, point_id, area of each
    point in a ring of the same `by`, boundaries included.

    A ring's box takes up to four cells of a grid as coarse as itself, and a point one cell of each grid, so both meet by an
    equi-join however many of them share `by`; what the boxes leave meets edges, never whole rings."""
    box = G.bbox(F.col("geometry"))
    side = F.greatest(*[box[f"max_{c}"].cast("long") - box[f"min_{c}"] + 1 for c in ("lat", "lon")])
    grid = F.greatest(F.lit(0), F.ceil(F.log2(side) / 2)).cast("int")  # cells of 4 ** grid units
    of = lambda c, g: F.floor(c / F.pow(F.lit(4.0), g)).cast("int")
    key = F.struct(by, "area")
    boxes = rings.where(F.size("geometry") >= 4).select(by, key.alias("area_idx"), grid.alias("grid"), *[box[c].alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])
    for c in ("lat", "lon"):
        boxes = boxes.withColumn(f"{c}_cell", F.explode(F.sequence(of(F.col(f"min_{c}"), F.col("grid")), of(F.col(f"max_{c}"), F.col("grid")))))
    p = points.where("lat_e7 is not null and lon_e7 is not null").select(by, F.struct(by, "point_id").alias("point_id"), "lat_e7", "lon_e7", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("grid"))
    p = p.withColumns({f"{c}_cell": of(F.col(f"{c}_e7"), F.col("grid")) for c in ("lat", "lon")})
    near = p.join(boxes, [by, "grid", "lat_cell", "lon_cell"]).where(G.in_box(F.col("lat_e7"), F.col("lon_e7"), F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon")))
    edges = ring_edges(rings.select(key.alias("area_idx"), F.lit(0).alias("ring_no"), F.lit(0).alias("role"), "geometry"))
    return _in_rings(near.select("point_id", "lat_e7", "lon_e7", "area_idx"), edges).select(F.col(f"area_idx.{by}").alias(by), F.col("point_id.point_id").alias("point_id"), F.col("area_idx.area").alias("area"))


def fitted_cell(points: DataFrame, size: int, fill: int = 3) -> tuple[int, int]:
    """The cell size, at most `size`, at which points (distinct lat_e7, lon_e7) share their cells with some `fill` others on
    average, and the number of points. A point counts with its own cell, so dense places decide, not empty ones."""
    while True:
        cells = points.groupBy(G.cell(F.col("lat_e7"), size).alias("a"), G.cell(F.col("lon_e7"), size).alias("b")).agg(F.count("*").cast("double").alias("n"))
        n, squares = cells.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()
        if size == 1 or squares <= 2 * fill * n:
            return size, int(n)
        size = max(1, int(size * math.sqrt(fill * n / squares)))


def nearest_points(queries: DataFrame, points: DataFrame, size: int = G.POINT_CELL) -> DataFrame:
    """queries: point_id, lat_e7, lon_e7 (one row per id); points: idx, lat_e7, lon_e7 -> point_id, idx, metres of the
    nearest point, ties to the smaller idx; exact. No points give no rows.

    A query meets the points of the 3 x 3 cells around it; cells are of `size` at most, and smaller where points are dense,
    so that a query meets some dozens of them however many there are. If the best lies within the distance that these cells
    cover for certain it is settled; the others go on with cells four times as wide, until the cells cover everything. Of
    points at one place only the smallest idx can be found, so places are met, not points."""
    places = cut(points.where("lat_e7 is not null and lon_e7 is not null").groupBy(F.col("lat_e7").alias("p_lat"), F.col("lon_e7").alias("p_lon")).agg(F.min("idx").alias("idx")))
    width, n = fitted_cell(places.select(F.col("p_lat").alias("lat_e7"), F.col("p_lon").alias("lon_e7")), size)
    left = queries.where("lat_e7 is not null and lon_e7 is not null").select("point_id", "lat_e7", "lon_e7")
    todo = left.count()
    found: DataFrame | None = None
    while True:
        own = lambda c, width=width: G.cell(F.col(c), width)
        around = lambda c: F.explode(F.sequence(own(c) - 1, own(c) + 1))
        of_q, of_p = (own, around) if todo > n else (around, own)  # the smaller table is the one to repeat
        q = left.withColumn("lat_cell", of_q("lat_e7")).withColumn("lon_cell", of_q("lon_e7"))
        p = places.withColumn("lat_cell", of_p("p_lat")).withColumn("lon_cell", of_p("p_lon"))
        metres = G.distance_m(F.col("lat_e7"), F.col("lon_e7"), F.col("p_lat"), F.col("p_lon"))
        # a table that is repeated is larger than Spark takes it to be, so it must not be broadcast
        pairs = q.hint("merge").join(p.hint("merge"), ["lat_cell", "lon_cell"])
        best = pairs.groupBy("point_id").agg(F.min(F.struct(metres.alias("metres"), F.col("idx").alias("idx"))).alias("best"))
        whole = width >= 3_700_000_000  # more than 360 degrees
        if whole:
            out = best.select("point_id", "best.idx", "best.metres")
            return out if found is None else found.unionByName(out)
        # degrees that are covered on every side, in metres; a degree of longitude shrinks towards the poles
        far = F.radians(F.least(F.lit(89.9), F.abs(G.degrees(F.col("lat_e7"))) + width / G.SCALE))
        sure = width / G.SCALE * (G.EARTH_M * 3.141592653589793 / 180) * F.cos(far)
        tried = cut(left.hint("merge").join(best.hint("merge"), "point_id", "left").withColumn("settled", F.coalesce(F.col("best.metres") <= sure, F.lit(False))))
        done = tried.where("settled").select("point_id", "best.idx", "best.metres")
        found = done if found is None else found.unionByName(done)
        left = tried.where("not settled").select("point_id", "lat_e7", "lon_e7")
        todo = left.count()
        if not todo or not n:
            return found
        width *= 4


def nearest_shapes(queries: DataFrame, shapes: DataFrame, metres: Callable[[Column, Column], Column], rings: int, size: int, tie: list[Column] | None = None, within: float = 0.0) -> DataFrame:
    """queries: point_id, lat_e7, lon_e7; shapes: idx, box, geometry -> point_id, idx, metres of the nearest shape whose
    box touches a cell at most `rings` cells away; none beyond. Ties by `tie`, then the smaller idx; distances that
    differ by less than `within` metres are ties.

    The 3 x 3 cells around a query come first. Queries that they don't settle look as far as the distance found there, or
    where there is none as far as `rings` cells. A query and a shape that share several cells meet in the first of them
    only, so that no pair has to be removed again."""
    corner = lambda c: G.cell(F.col(c), size)
    cells = shapes.select("idx", corner("min_lat").alias("s_lat"), corner("min_lon").alias("s_lon"), F.explode(G.cells_of_box(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"), size)).alias("c"))
    cells = cells.select("idx", "s_lat", "s_lon", F.col("c.lat_cell").alias("c_lat"), F.col("c.lon_cell").alias("c_lon"))

    def look(q: DataFrame, reach: Column) -> DataFrame:
        q = q.withColumn("q_lat", corner("lat_e7") - reach).withColumn("q_lon", corner("lon_e7") - reach).withColumn("_n", 2 * reach)
        q = q.withColumn("lat_cell", F.explode(F.sequence("q_lat", F.col("q_lat") + F.col("_n")))).withColumn("lon_cell", F.explode(F.sequence("q_lon", F.col("q_lon") + F.col("_n"))))
        first = (F.col("lat_cell") == F.greatest("q_lat", "s_lat")) & (F.col("lon_cell") == F.greatest("q_lon", "s_lon"))
        pairs = q.join(cells, (F.col("lat_cell") == F.col("c_lat")) & (F.col("lon_cell") == F.col("c_lon")) & first).select("point_id", "lat_e7", "lon_e7", "idx")
        pairs = pairs.join(shapes, "idx").where(F.size("geometry") > 0)
        # a shape is no nearer than its box and no farther than its first vertex: most are ruled out by that
        k = F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(G.degrees(F.col("lat_e7"))))))
        flat = lambda dlat, dlon: F.sqrt(F.pow(G.degrees(dlat) * G.DEGREE_M, 2) + F.pow(G.degrees(dlon) * G.DEGREE_M * k, 2))
        gap = lambda c, lo, hi: F.greatest(F.lit(0), F.col(lo) - F.col(c), F.col(c) - F.col(hi))
        low = flat(gap("lat_e7", "min_lat", "max_lat"), gap("lon_e7", "min_lon", "max_lon")) * 0.99
        high = flat(F.col("lat_e7") - F.col("geometry")[0]["lat_e7"], F.col("lon_e7") - F.col("geometry")[0]["lon_e7"]) * 1.01 + within
        pairs = pairs.withColumn("low", low).withColumn("high", high)
        bound = pairs.groupBy("point_id").agg(F.min("high").alias("bound"))
        pairs = pairs.join(bound, "point_id").where(F.col("low") <= F.col("bound")).withColumn("metres", metres(F.col("lat_e7"), F.col("lon_e7")))
        rank = F.round(F.col("metres") / within) if within else F.col("metres")
        key = F.struct(rank.alias("r"), *[t.alias(f"t{i}") for i, t in enumerate(tie or [])], F.col("metres").alias("metres"), F.col("idx").alias("idx"))
        # null metres are passed over here, not by a filter, which would be moved before the join that rules pairs out
        best = pairs.groupBy("point_id").agg(F.min(F.when(F.col("metres").isNotNull(), key)).alias("best")).where("best is not null")
        return best.select("point_id", "best.idx", "best.metres")

    # distances are the work here, so the queries are dealt over all cores however small their table is
    spark = queries.sparkSession
    queries = queries.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "point_id")
    near = look(queries.select("point_id", "lat_e7", "lon_e7"), F.lit(1))
    # metres that a cell covers for certain, as far towards the pole as a query may look
    sure = lambda far: size / G.SCALE * (G.EARTH_M * 3.141592653589793 / 180) * F.cos(F.radians(F.least(F.lit(89.9), F.abs(G.degrees(F.col("lat_e7"))) + far * size / G.SCALE)))
    tried = cut(queries.select("point_id", "lat_e7", "lon_e7").join(near, "point_id", "left").withColumn("settled", F.coalesce(F.col("metres") + within < sure(1), F.lit(False))))
    far = F.least(F.lit(rings), F.coalesce(F.ceil((F.col("metres") + 1.01 * within + 1) / sure(rings)).cast("int"), F.lit(rings)))
    rest = tried.where("not settled").select("point_id", "lat_e7", "lon_e7", far.alias("reach"))
    again = look(rest, F.col("reach"))
    return tried.where("settled").select("point_id", "idx", "metres").unionByName(again)


def _dealt(counts: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(class, its first block, its number of blocks) of classes with their counts: neighbouring classes share a block of
    about `most`, a class of more has blocks of its own."""
    out, blocks, room = [], 0, 0
    for key, n in sorted(counts):
        if n > most:
            many, room = -(-n // most), 0
            out.append((key, blocks, many))
            blocks += many
            continue
        if n > room:
            blocks, room = blocks + 1, most
        out.append((key, blocks - 1, 1))
        room -= n
    return out


def on_vertices(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """queries: point_id, lat_e7, lon_e7; lines: idx, geometry -> point_id, idx of the queries that lie on a vertex of a line, hence
    0 metres away, and the smallest idx of the lines with that vertex. Lines with a null vertex are passed over."""
    none = lambda c: F.exists(F.col("geometry")[c], lambda x: x.isNull())
    vertices = lines.where(~(none("lat_e7") | none("lon_e7"))).select("idx", F.explode("geometry").alias("p")).groupBy("p.lat_e7", "p.lon_e7").agg(F.min("idx").alias("idx"))
    return queries.select("point_id", "lat_e7", "lon_e7").join(vertices, ["lat_e7", "lon_e7"]).select("point_id", "idx")


def nearest_lines(queries: DataFrame, lines: DataFrame, rings: int, size: int) -> DataFrame:
    """As nearest_shapes, for lines (idx, geometry, box): segment by segment. The nearest vertex bounds the distance; blocks of
    places (at most PLACES, by latitude) meet blocks of the segments that come as near as the bounds of the places allow,
    dealt by their directions, and each segment runs through its block's places as it lies, not as its box. Neither side is repeated over cells. The few
    queries whose nearest segment may lie beyond `rings` cells (or that find none) go by the boxes of whole lines."""
    spark = queries.sparkSession
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size("geometry") - 1, F.lit(1))), lambda i: F.struct(F.get("geometry", i - 1).alias("a"), F.coalesce(F.get("geometry", i), F.get("geometry", i - 1)).alias("b")))
    seg = lines.where(F.size("geometry") > 0).select("idx", (F.size("geometry") == 1).alias("one"), F.explode(ends).alias("e"))
    seg = cut(seg.select("idx", "one", *[F.col(f"e.{p}.{c}_e7").alias(f"{p}_{c}") for p in "ab" for c in ("lat", "lon")]).where("a_lat is not null and a_lon is not null and b_lat is not null and b_lon is not null"))
    asked = queries.where("lat_e7 is not null and lon_e7 is not null").select("point_id", "lat_e7", "lon_e7")
    spots = numbered(asked.select("lat_e7", "lon_e7").distinct(), F.col("lat_e7"), F.col("lon_e7"), name="point_id", kind="long")

    # a bound on segment_m to the nearest vertex from distance_m, which takes the cosine between the two latitudes
    vertex = nearest_points(spots, seg.select("idx", F.col("a_lat").alias("lat_e7"), F.col("a_lon").alias("lon_e7"))).select("point_id", F.col("metres").alias("to_vertex"))
    lat = F.abs(G.degrees(F.col("lat_e7")))
    k = F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(G.degrees(F.col("lat_e7"))))))
    between = F.cos(F.radians(F.least(F.lit(89.9), lat + F.col("to_vertex") / (2 * 111_000.0))))
    bound = F.col("to_vertex") * 1.0012 * F.greatest(F.lit(1.0), F.col("k") / between) + 1e-6
    # metres that a cell covers for certain, as far towards the pole as a query may look
    sure = lambda far: size / G.SCALE * (G.EARTH_M * 3.141592653589793 / 180) * F.cos(F.radians(F.least(F.lit(89.9), lat + far * size / G.SCALE)))
    reach = F.greatest(sure(1), rings * sure(rings) - 1)
    # without a vertex there is no line
    places = cut(spots.hint("merge").join(vertex.hint("merge"), "point_id").withColumn("k", k).withColumn("reach", reach).select("point_id", "lat_e7", "lon_e7", "k", "reach", F.least(bound, "reach").alias("within"), F.floor(F.col("point_id") / PLACES).cast("int").alias("part")))

    tall = F.ceil(F.col("within") / G.DEGREE_M * G.SCALE) + 2
    parts = places.groupBy("part").agg(F.min(F.col("lat_e7") - tall).alias("low"), F.max(F.col("lat_e7") + tall).alias("high"))
    parts = spark.createDataFrame(parts.collect(), parts.schema)  # a row for PLACES places
    real = seg.where("not one").join(F.broadcast(parts), (F.least("a_lat", "b_lat") <= F.col("high")) & (F.greatest("a_lat", "b_lat") >= F.col("low"))).drop("low", "high", "one")
    turn = F.atan2(*[F.col(f"b_{c}").cast("double") - F.col(f"a_{c}") for c in ("lat", "lon")])
    real = real.withColumn("turn", F.pmod(F.floor(turn / math.pi * DIRECTIONS), F.lit(DIRECTIONS)).cast("int"))
    counts: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for r in real.groupBy("part", "turn").agg(F.count("*").alias("n")).collect():  # DIRECTIONS rows at most for PLACES places
        counts[r["part"]].append((r["turn"], r["n"]))
    cores = spark.sparkContext.defaultParallelism
    few = -(-3 * cores // max(1, len(counts)))
    share = {p: -(-n // max(1, -(-n // SEGMENTS), min(few, n // (SEGMENTS // 16)))) for p, c in counts.items() for n in [sum(m for _, m in c)]}
    deal = {p: _dealt(c, share[p]) for p, c in counts.items()}
    blocks = {p: sum(rows[-1][1:]) for p, rows in deal.items()}
    found = spots.select("point_id", F.lit(None).cast(lines.schema["idx"].dataType).alias("idx"), F.lit(None).cast("double").alias("metres")).limit(0)
    if blocks:
        table = spark.createDataFrame([(p, n) for p, n in blocks.items()], "part int, blocks int")
        pick = F.col("first") + F.pmod(F.xxhash64("idx", "a_lat", "a_lon", "b_lat", "b_lon"), F.col("many").cast("long")).cast("int")
        dealt = [(p, *row) for p, rows in deal.items() for row in rows]
        left = real.join(F.broadcast(spark.createDataFrame(dealt, "part int, turn int, first int, many int")), ["part", "turn"]).withColumn("block", pick).drop("turn", "first", "many")
        right = places.join(F.broadcast(table), "part").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "block", "point_id", "lat_e7", "lon_e7", "k", "within")
        # distances are the work here, which Spark doesn't see from the size of the tables: as many tasks as there are blocks, and more for even shares
        tasks = min(3 * sum(blocks.values()), 2_000)
        met = right.repartition(tasks, "part", "block").groupBy("part", "block").cogroup(left.repartition(tasks, "part", "block").groupBy("part", "block"))
        found = met.applyInArrow(_nearest_of_block, T.StructType([T.StructField("point_id", T.LongType()), lines.schema["idx"], T.StructField("metres", T.DoubleType())]))
    ones = seg.where("one").select("idx", F.col("a_lat").alias("lat_e7"), F.col("a_lon").alias("lon_e7"))
    if ones.limit(1).count():
        found = found.unionByName(nearest_points(spots, ones))
    best = found.groupBy("point_id").agg(F.min(F.struct("metres", "idx")).alias("best"))
    done = places.hint("merge").join(best.hint("merge"), "point_id").where(F.col("best.metres") <= F.col("reach")).select("lat_e7", "lon_e7", "best.idx", "best.metres")
    tried = cut(asked.hint("merge").join(done.hint("merge"), ["lat_e7", "lon_e7"], "left"))
    out = tried.where("metres is not null").select("point_id", "idx", "metres")
    rest = tried.where("metres is null").select("point_id", "lat_e7", "lon_e7")
    if rest.limit(1).count():
        out = out.unionByName(nearest_shapes(rest, lines, lambda a, b: G.street_m(a, b, F.col("geometry")), rings, size))
    return out


def _nearest_of_block(places: pa.Table, segments: pa.Table) -> pa.Table:
    """point_id, idx, metres of the places that a segment of the block is near enough to."""
    of = lambda t, *names: [t.column(n).to_numpy() for n in names]
    idx = segments.column("idx")
    who, metres = nearest_segments(*of(places, "lat_e7", "lon_e7", "k", "within"), idx.to_numpy(), *of(segments, "a_lat", "a_lon", "b_lat", "b_lon"))
    some = np.flatnonzero(np.isfinite(metres))
    return pa.table({"point_id": places.column("point_id").take(some), "idx": pa.array(who[some]).cast(idx.type), "metres": pa.array(metres[some])})


def in_viewport(shapes: DataFrame, box: tuple[int, int, int, int], size: int, exact: Column | None = None) -> DataFrame:
    """Shapes (with boxes) whose box meets `box` = (min_lat, max_lat, min_lon, max_lon), with first_lat and first_lon: the
    first cell, in row order, that both touch. The filter on boxes reaches the scan; `exact` is applied after."""
    lo_lat, hi_lat, lo_lon, hi_lon = box
    own = (F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon"))
    out = shapes.where(G.boxes_meet(own, tuple(map(F.lit, box))))
    out = out.where(exact) if exact is not None else out
    first = lambda c, lo: F.greatest(G.cell(F.col(c), size), F.lit(lo // size))
    return out.withColumn("first_lat", first("min_lat", lo_lat)).withColumn("first_lon", first("min_lon", lo_lon))


def smallest_per_level(links: DataFrame, key: str, areas: DataFrame) -> DataFrame:
    """key, area_idx: of the areas that links (key, area_idx) ties to each key, on each level the one with the smallest box; ties
    go to the smaller osm_id, then idx."""
    level = areas.select(F.col("idx").alias("area_idx"), "admin_level", "osm_id", G.box_score(F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon")).alias("_size"))
    first = Window.partitionBy(key, "admin_level").orderBy("_size", "osm_id", "area_idx")
    return links.join(level, "area_idx").withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "area_idx")
