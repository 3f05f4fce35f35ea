"""What lies in a viewport, evenly sampled where there is too much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.operators.spatial import in_viewport
from waymark.sources.schema import numbered

Box = tuple[int, int, int, int]  # min_lat, max_lat, min_lon, max_lon, in degrees * 1e7


def box_of(min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Box:
    """Degrees to a box; ValueError if they are no viewport."""
    if not (-90 <= min_lat <= max_lat <= 90 and -180 <= min_lon <= max_lon <= 180):
        raise ValueError("missing viewport parameters")
    return tuple(round(v * G.SCALE) for v in (min_lat, max_lat, min_lon, max_lon))


def even_sample(df: DataFrame, limit: int, *order: Column, n: int | None = None) -> DataFrame:
    """All rows with `ord` if there are at most limit; else those at places floor((i + 0.5) * n / limit) of the order. Places
    are counted by ranges, so that no task sorts more than its own."""
    n = df.count() if n is None else n
    if n <= limit:
        return df.withColumn("ord", F.row_number().over(Window.orderBy(*order)) - 1)
    ranked = numbered(df, *order, name="ord", kind="long")
    # place p is taken if some i has floor((i + 0.5) * n / limit) = p
    i = F.ceil(F.col("ord") * F.lit(limit) / F.lit(float(n)) - 0.5)
    return ranked.where((i >= 0) & (i < limit) & (F.floor((i + 0.5) * F.lit(float(n)) / F.lit(limit)) == F.col("ord")))


def _cells(box: Box, size: int) -> int:
    return (box[1] // size - box[0] // size + 1) * (box[3] // size - box[2] // size + 1)


def _per_cell(df: DataFrame, box: Box, limit: int, exact: Column) -> DataFrame:
    """One object a cell for evenly sampled cells: the first inside, from a place that the cell's hash gives on, in idx
    order around the cell."""
    n = df.select("lat_cell", "lon_cell").distinct().count()
    chosen = even_sample(df.select("lat_cell", "lon_cell").distinct(), limit, F.col("lat_cell"), F.col("lon_cell"), n=n)
    unsigned = lambda c: F.col(c).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    mix = (unsigned("lat_cell") * F.lit(73856093)).bitwiseXOR(unsigned("lon_cell") * F.lit(19349663))
    # both products stay below 2^63, so the remainder is that of unsigned numbers
    cell = Window.partitionBy("lat_cell", "lon_cell")
    rows = df.join(chosen, ["lat_cell", "lon_cell"]).withColumn("_n", F.count("*").over(cell)).withColumn("_k", F.row_number().over(cell.orderBy("idx")) - 1)
    turn = F.pmod(F.col("_k") - F.pmod(mix, F.col("_n")), F.col("_n"))
    inside = rows.where(exact).withColumn("_t", turn)
    return inside.withColumn("_r", F.row_number().over(cell.orderBy("_t"))).where("_r = 1").drop("_n", "_k", "_t", "_r")


def houses_in(houses: DataFrame, box: Box, limit: int = 1500) -> DataFrame:
    """Houses in a box with ord and truncated: all, or an even sample; over many cells one for each sampled cell."""
    limit = min(max(limit, 1), 100_000)
    size = G.POINT_CELL
    inside = G.in_box(F.col("lat_e7"), F.col("lon_e7"), *box)
    cells = lambda df: df.withColumn("lat_cell", G.cell(F.col("lat_e7"), size)).withColumn("lon_cell", G.cell(F.col("lon_e7"), size))
    if _cells(box, size) <= limit * 8:
        found = cells(houses.where(inside))
        n = found.count()
        return even_sample(found, limit, F.col("lat_cell"), F.col("lon_cell"), F.col("idx"), n=n).withColumn("truncated", F.lit(n > limit))
    # whole cells, for the place to start at in each counts houses of the cell outside the box too
    wide = tuple((v // size + up) * size - up for v, up in zip(box, (0, 1, 0, 1), strict=True))
    found = cells(houses.where(G.in_box(F.col("lat_e7"), F.col("lon_e7"), *wide)))
    n = found.select("lat_cell", "lon_cell").distinct().count()
    return _per_cell(found, box, limit, inside).withColumn("truncated", F.lit(n > limit))


def streets_in(streets: DataFrame, box: Box, limit: int | None = 2000) -> DataFrame:
    """Streets with a vertex in a box, their geometry clipped to such vertices, with ord and truncated: all, or an even
    sample of at most limit and 20,000 (None: all, however many)."""
    inside = lambda p: G.in_box(p["lat_e7"], p["lon_e7"], *box)
    found = in_viewport(streets, box, G.STREET_CELL, F.exists("geometry", inside)).withColumn("geometry", F.filter("geometry", inside))
    order = F.col("first_lat"), F.col("first_lon"), F.col("idx")
    if limit is None:
        return numbered(found, *order, name="ord").withColumn("truncated", F.lit(False))
    limit = min(max(limit, 1), 20_000)
    n = found.count()
    return even_sample(found, limit, *order, n=n).withColumn("truncated", F.lit(n > limit))


def areas_in(areas: DataFrame, box: Box, limit: int = 300, min_level: int = 2, max_level: int = 10, max_points: int | None = 500) -> DataFrame:
    """Areas of some levels whose box meets a box, thinned to max_points (None: in full), with ord and truncated."""
    limit = min(max(limit, 1), 5_000)
    found = in_viewport(areas.where(F.col("admin_level").between(min(max(min_level, 2), 12), min(max(max_level, 2), 12))), box, G.ADMIN_CELL)
    n = found.count()
    found = even_sample(found, limit, F.col("first_lat"), F.col("first_lon"), F.col("idx"), n=n).withColumn("truncated", F.lit(n > limit))
    return found if max_points is None else found.withColumn("outer", F.when(F.size("outer") > max_points, G.thin(F.col("outer"), max_points)).otherwise(F.col("outer")))


def area_by(areas: DataFrame, index: int | None = None, osm_id: int | None = None, max_points: int | None = 2000) -> DataFrame:
    """One area by idx or, the first, by OSM id; ValueError without either. No row if there is none."""
    if index is None and osm_id is None:
        raise ValueError("missing index or id")
    found = areas.where(F.col("idx") == index if index is not None else F.col("osm_id") == osm_id).orderBy("idx").limit(1)
    return found if max_points is None else found.withColumn("outer", F.when(F.size("outer") > max_points, G.thin(F.col("outer"), max_points)).otherwise(F.col("outer")))


def cell_counts(points: DataFrame, size: int = G.POINT_CELL) -> DataFrame:
    """lat_cell, lon_cell, n of cells that hold a point."""
    return points.groupBy(G.cell(F.col("lat_e7"), size).alias("lat_cell"), G.cell(F.col("lon_e7"), size).alias("lon_cell")).agg(F.count("*").alias("n"))
