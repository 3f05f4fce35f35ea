"""Geometry over fixed-point coordinates (degrees * 1e7, as ints). Geometries are arrays of struct(lat_e7, lon_e7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.bind import bind

# Scale, radius of the earth, metres per degree, cell sizes in degrees * 1e7, latitude band of ring edges.
SCALE = 10_000_000
EARTH_M = 6_371_000.0
DEGREE_M = 111_320.0
POINT_CELL, STREET_CELL, ADMIN_CELL, EDGE_BAND = 200_000, 500_000, 2_500_000, 500_000
POINT = "struct<lat_e7:int,lon_e7:int>"


def quantize(degrees: Column) -> Column:
    """Degrees -> int degrees * 1e7, rounded half away from zero."""
    return F.round(degrees * SCALE).cast("int")


def degrees(e7: Column) -> Column:
    return e7 / F.lit(float(SCALE))


def cell(e7: Column, size: int) -> Column:
    """Grid cell of a coordinate; rounds down, for negative ones too."""
    return F.floor(e7 / F.lit(float(size))).cast("int")


def bbox(geometry: Column) -> Column:
    """struct(min_lat, max_lat, min_lon, max_lon); null for an empty geometry."""
    lat, lon = geometry["lat_e7"], geometry["lon_e7"]
    box = F.struct(F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lon).alias("max_lon"))
    return F.when(F.size(geometry) > 0, box)


def in_box(lat: Column, lon: Column, min_lat, max_lat, min_lon, max_lon) -> Column:
    return lat.between(min_lat, max_lat) & lon.between(min_lon, max_lon)


def boxes_meet(a: tuple, b: tuple) -> Column:
    """Boxes as (min_lat, max_lat, min_lon, max_lon); edges count."""
    return (a[0] <= b[1]) & (a[1] >= b[0]) & (a[2] <= b[3]) & (a[3] >= b[2])


def box_score(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column) -> Column:
    """Size of a box for choosing the smallest; an invalid one is larger than all."""
    size = F.greatest(F.lit(1.0), (max_lat - min_lat).cast("double")) * F.greatest(F.lit(1.0), (max_lon - min_lon).cast("double"))
    return F.coalesce(size, F.lit(1.7976931348623157e308))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between E7 points: equirectangular with the mean latitude."""
    la1, lo1, la2, lo2 = (F.radians(degrees(c)) for c in (lat1, lon1, lat2, lon2))
    x = (lo2 - lo1) * F.cos((la1 + la2) / 2)
    y = la2 - la1
    return EARTH_M * F.sqrt(x * x + y * y)


def lon_scale(lat: Column) -> Column:
    """What a degree of longitude is to one of latitude, in the plane of segment_m."""
    return F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(degrees(lat)))))


def segment_m(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, k: Column | None = None) -> Column:
    """Metres from a point to a segment, in a plane scaled at the point's latitude; k: its lon_scale, if it is there already."""
    k = lon_scale(lat) if k is None else k
    plane = lambda c, at, scale: degrees((c - at).cast("double")) * DEGREE_M * scale
    ends = F.struct(plane(a_lon, lon, k).alias("ax"), plane(a_lat, lat, 1.0).alias("ay"), plane(b_lon, lon, k).alias("bx"), plane(b_lat, lat, 1.0).alias("by"))

    def foot(e: Column) -> Column:
        length = e["dx"] * e["dx"] + e["dy"] * e["dy"]
        t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(e["ax"] * e["dx"] + e["ay"] * e["dy"]) / length))).otherwise(0.0)
        return bind(t, lambda t: F.struct((e["ax"] + t * e["dx"]).alias("x"), (e["ay"] + t * e["dy"]).alias("y")))

    sides = bind(ends, lambda e: F.struct(e["ax"].alias("ax"), e["ay"].alias("ay"), (e["bx"] - e["ax"]).alias("dx"), (e["by"] - e["ay"]).alias("dy")))
    return bind(bind(sides, foot), lambda p: F.sqrt(p["x"] * p["x"] + p["y"] * p["y"]))


def _segments(geometry: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(geometry) - 1), lambda i: f(F.get(geometry, i - 1), F.get(geometry, i)))


def street_m(lat: Column, lon: Column, geometry: Column) -> Column:
    """Metres from a point to a line; null for an empty one."""

    def metres(r: Column) -> Column:
        line = r["line"]
        one = distance_m(r["lat"], r["lon"], line[0]["lat_e7"], line[0]["lon_e7"])
        many = F.array_min(_segments(line, lambda a, b: segment_m(r["lat"], r["lon"], a["lat_e7"], a["lon_e7"], b["lat_e7"], b["lon_e7"], r["k"])))
        return F.when(F.size(line) == 1, one).when(F.size(line) > 1, many)

    return bind(F.struct(lat.alias("lat"), lon.alias("lon"), lon_scale(lat).alias("k"), geometry.alias("line")), metres)


def boundary_m(lat: Column, lon: Column, ring: Column) -> Column:
    """Metres from a point to the outline of a ring, its closing edge included; holes aren't looked at."""
    return street_m(lat, lon, F.concat(ring, F.slice(ring, 1, 1)))


def on_edge(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Whether a point lies on an edge, to one unit of the cross product; edges without length hold no point."""
    d = lambda x, y: (x - y).cast("double")
    dy, dx, py, px = d(b_lat, a_lat), d(b_lon, a_lon), d(lat, a_lat), d(lon, a_lon)
    dot, length = px * dx + py * dy, dx * dx + dy * dy
    return (length > 0) & (F.abs(px * dy - py * dx) <= 1) & (dot >= 0) & (dot <= length)


def crosses(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Whether a ray from a point to larger longitudes crosses an edge."""
    at = a_lon + (lat - a_lat).cast("double") * (b_lon - a_lon) / F.nullif(b_lat - a_lat, F.lit(0))
    return F.coalesce(((a_lat > lat) != (b_lat > lat)) & (at >= lon), F.lit(False))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Point in a closed ring (even-odd; the boundary is inside; fewer than 4 points: never)."""
    flag = lambda f: _segments(ring, lambda a, b: f(lat, lon, a["lat_e7"], a["lon_e7"], b["lat_e7"], b["lon_e7"]))
    edge = F.exists(flag(on_edge), lambda x: x)
    odd = F.size(F.filter(flag(crosses), lambda x: x)) % 2 == 1
    return F.when(F.size(ring) >= 4, edge | odd).otherwise(False)


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("int").alias("lat_e7"), lon.cast("int").alias("lon_e7"))


def _sum(geometry: Column, field: str) -> Column:
    return F.aggregate(geometry, F.lit(0).cast("long"), lambda acc, p: acc + p[field])


def mean_point(geometry: Column) -> Column:
    """Mean vertex, rounded; a closing vertex counts twice."""
    n = F.size(geometry)
    return F.when(n > 0, _point(F.round(_sum(geometry, "lat_e7") / n), F.round(_sum(geometry, "lon_e7") / n)))


def truncated_mean_point(geometry: Column) -> Column:
    """Mean vertex, truncated toward zero."""
    n = F.size(geometry)
    return F.when(n > 0, _point(F.signum(_sum(geometry, "lat_e7")) * F.floor(F.abs(_sum(geometry, "lat_e7")) / n), F.signum(_sum(geometry, "lon_e7")) * F.floor(F.abs(_sum(geometry, "lon_e7")) / n)))


def middle_vertex(geometry: Column) -> Column:
    return F.when(F.size(geometry) > 0, F.get(geometry, F.floor(F.size(geometry) / 2).cast("int")))


def _shoelace(geometry: Column) -> tuple[Column, Column, Column]:
    """(twice the signed area, its moments in latitude and longitude), in exact decimals relative to the first vertex, which keeps the products
    small."""
    lat0, lon0 = geometry[0]["lat_e7"].cast("long"), geometry[0]["lon_e7"].cast("long")
    zero = F.lit(0).cast("decimal(38,0)")
    dec = lambda c: c.cast("decimal(19,0)")

    def step(i: Column) -> Column:
        a, b = F.get(geometry, i - 1), F.get(geometry, i)
        ay, ax, by, bx = a["lat_e7"] - lat0, a["lon_e7"] - lon0, b["lat_e7"] - lat0, b["lon_e7"] - lon0
        cross = (dec(ax * by) - dec(bx * ay)).cast("decimal(20,0)")
        return F.struct(cross.cast("decimal(38,0)").alias("a"), (cross * (ay + by).cast("decimal(11,0)")).cast("decimal(38,0)").alias("y"), (cross * (ax + bx).cast("decimal(11,0)")).cast("decimal(38,0)").alias("x"))

    steps = F.transform(F.sequence(F.lit(1), F.size(geometry) - 1), step)
    total = lambda f: F.aggregate(steps, zero, lambda acc, s: (acc + s[f]).cast("decimal(38,0)"))
    return total("a"), total("y"), total("x")


def _centroid(geometry: Column, otherwise: Column) -> Column:
    a, y, x = _shoelace(geometry)
    lat = geometry[0]["lat_e7"] + F.round(y.cast("double") / (3 * a.cast("double")))
    lon = geometry[0]["lon_e7"] + F.round(x.cast("double") / (3 * a.cast("double")))
    return F.when(F.abs(a) < 1, otherwise).otherwise(_point(lat, lon))


def house_way_point(geometry: Column) -> Column:
    """Centroid of a closed way of 4 points or more, else (and for areas below 1) its mean vertex."""
    closed = (F.size(geometry) >= 4) & (geometry[0] == F.element_at(geometry, -1))
    return F.when(F.size(geometry) > 0, F.when(closed, _centroid(geometry, mean_point(geometry))).otherwise(mean_point(geometry)))


def admin_centroid(ring: Column) -> Column:
    """Centroid of a ring; of a degenerate one the middle of its box."""
    box = bbox(ring)
    half = lambda lo, hi: (box[lo].cast("long") + box[hi]) / 2
    trunc = lambda c: F.signum(c) * F.floor(F.abs(c))
    return F.when(F.size(ring) > 0, _centroid(ring, _point(trunc(half("min_lat", "max_lat")), trunc(half("min_lon", "max_lon")))))


def admin_interior_point(ring: Column) -> Column:
    """A point inside a ring: the centroid, else the middle of the box, else the first inside of every max(1, n / 64)th
    vertex, else the middle of the box."""
    box = bbox(ring)
    middle = _point(F.floor((box["min_lat"].cast("long") + box["max_lat"]) / 2), F.floor((box["min_lon"].cast("long") + box["max_lon"]) / 2))
    step = F.greatest(F.lit(1), F.floor(F.size(ring) / 64).cast("int"))
    tried = F.concat(F.array(admin_centroid(ring), middle), F.filter(ring, lambda p, i: i % step == 0))
    inside = F.filter(tried, lambda p: in_ring(p["lat_e7"], p["lon_e7"], ring))
    return F.coalesce(F.get(inside, F.lit(0)), middle)


def thin(geometry: Column, target: int) -> Column:
    """Every ceil(n / target)th vertex, and the last one."""
    step = F.ceil(F.size(geometry) / F.lit(float(target))).cast("int")
    last = F.size(geometry) - 1
    return F.filter(geometry, lambda p, i: (i % step == 0) | (i == last))


def cells_of_box(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, size: int) -> Column:
    """array of struct(lat_cell, lon_cell) that a box touches."""
    lats = F.sequence(cell(min_lat, size), cell(max_lat, size))
    lons = F.sequence(cell(min_lon, size), cell(max_lon, size))
    return F.flatten(F.transform(lats, lambda a: F.transform(lons, lambda b: F.struct(a.alias("lat_cell"), b.alias("lon_cell")))))
