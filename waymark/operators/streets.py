"""Streets: ring assembly and connecting segments."""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.graph import connected_components, cut, small

Point = tuple[int, int]


def assemble_rings(parts: list[list[Point]]) -> list[list[Point]]:
    """Closed rings from ways: each chain starts with the first unused way and takes the first one that fits its end or its
    start, either way round, until none does. Chains that don't close, or have fewer than 4 points, are dropped; the
    rings come by falling number of points. Ways are looked up by end point, so that a relation of many ways costs what
    it holds."""
    ways = [p for p in parts if len(p) >= 2]
    meeting: defaultdict[Point, list[int]] = defaultdict(list)  # the ways that end at a point, the last one first
    for i in reversed(range(len(ways))):
        for point in {ways[i][0], ways[i][-1]}:
            meeting[point].append(i)
    free, rings = [True] * len(ways), []

    def first_at(point: Point) -> int:
        left = meeting[point]
        while left and not free[left[-1]]:
            left.pop()
        return left[-1] if left else len(ways)

    for start, way in enumerate(ways):
        if not free[start]:
            continue
        free[start], chain = False, deque(way)
        while chain[0] != chain[-1] and (i := min(first_at(chain[-1]), first_at(chain[0]))) < len(ways):
            free[i], p = False, ways[i]
            if p[0] == chain[-1]:
                chain.extend(p[1:])
            elif p[-1] == chain[-1]:
                chain.extend(p[-2::-1])
            elif p[-1] == chain[0]:
                chain.extendleft(p[-2::-1])
            else:
                chain.extendleft(p[1:])
        if len(chain) >= 4 and chain[0] == chain[-1]:
            rings.append(list(chain))
    return sorted(rings, key=len, reverse=True)


def relation_rings(members: DataFrame) -> DataFrame:
    """members: relation_id, role (0 outer, 1 inner), ord, geometry of each member way -> relation_id, role, ring_no,
    geometry. Relations are small; each is assembled on its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for role, rows in pdf.sort_values("ord", kind="stable").groupby("role"):
            parts = [[(p["lat_e7"], p["lon_e7"]) for p in g] for g in rows["geometry"]]
            for k, ring in enumerate(assemble_rings(parts)):
                out.append((pdf["relation_id"].iloc[0], role, k, [{"lat_e7": a, "lon_e7": b} for a, b in ring]))
        return pd.DataFrame(out, columns=["relation_id", "role", "ring_no", "geometry"])

    schema = "relation_id long, role int, ring_no int, geometry array<struct<lat_e7:int,lon_e7:int>>"
    return members.select("relation_id", F.col("role").cast("int").alias("role"), "ord", "geometry").groupBy("relation_id").applyInPandas(run, schema)


def chains(lines: list[tuple[int, list[Point]]]) -> list[tuple[int, list[Point]]]:
    """(smallest id, geometry) of the chains of connected lines: from a node where other than two lines meet, else from the
    first unused line, on until such a node. Branches stay chains of their own; joints aren't repeated."""
    ends: dict[Point, list[int]] = defaultdict(list)
    for i, (_, g) in enumerate(lines):
        ends[g[0]].append(i)
        ends[g[-1]].append(i)
    used, out = [False] * len(lines), []

    def walk(i: int, start: Point) -> None:
        ids, path, at = [], [start], start
        while True:
            used[i] = True
            ids.append(lines[i][0])
            g = lines[i][1] if lines[i][1][0] == at else lines[i][1][::-1]
            path += g[1:]
            at = g[-1]
            following = [j for j in ends[at] if not used[j]]
            if len(ends[at]) != 2 or not following:
                break
            i = following[0]
        out.append((min(ids), path))

    for node in list(ends):
        if len(ends[node]) != 2:
            for i in ends[node]:
                if not used[i]:
                    walk(i, node)
    for i, (_, g) in enumerate(lines):
        if not used[i]:
            walk(i, g[0])
    return out


def linked_streets(streets: DataFrame) -> DataFrame:
    """idx, component (smallest idx) of the streets that share an end point with another one of the same name and kind, neither being
    closed or unnamed. Segments are linked to the first one at each end point, so hubs cost what they hold."""
    open_ = streets.where((F.size("geometry") >= 2) & (F.col("name") != "") & (F.col("geometry")[0] != F.element_at("geometry", -1)))
    ends = open_.select("idx", "name", "highway", F.explode(F.array(F.col("geometry")[0], F.element_at("geometry", -1))).alias("at"))
    hubs = ends.groupBy("name", "highway", "at").agg(F.min("idx").alias("hub"), F.count("*").alias("n")).where("n > 1")
    edges = ends.join(hubs, ["name", "highway", "at"]).select(F.col("idx").alias("src"), F.col("hub").alias("dst"))
    return connected_components(edges).select(F.col("node").alias("idx"), "component")


def street_components(streets: DataFrame) -> DataFrame:
    """idx, component of all streets, as of linked_streets; those that aren't linked stand alone."""
    return streets.select("idx").join(linked_streets(streets), "idx", "left").select("idx", F.coalesce("component", "idx").alias("component"))


def connect_streets(streets: DataFrame) -> DataFrame:
    """streets with connected segments merged to chains; columns osm_id (smallest of the chain), name, highway, geometry,
    and idx, new. Closed and unnamed streets are copied. Components, not names, are grouped: none grows with a frequent
    street name."""
    streets = cut(streets.select("idx", "osm_id", "name", "highway", "geometry"))
    linked = small(linked_streets(streets))  # two or more of each component
    alone = streets.join(linked, "idx", "left_anti").select(F.col("idx").alias("component"), "osm_id", "name", "highway", "geometry")

    schema = "component int, osm_id long, name string, highway string, geometry array<struct<lat_e7:int,lon_e7:int>>"
    fields = pa.schema([("component", pa.int32()), ("osm_id", pa.int64()), ("name", pa.string()), ("highway", pa.string()), ("geometry", pa.list_(pa.struct([("lat_e7", pa.int32()), ("lon_e7", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                made = chains([(x["osm_id"], [(p["lat_e7"], p["lon_e7"]) for p in x["geometry"]]) for x in row["lines"]])
                out += [{"component": row["component"], "osm_id": i, "name": row["name"], "highway": row["highway"], "geometry": [{"lat_e7": a, "lon_e7": b} for a, b in g]} for i, g in made]
            yield pa.RecordBatch.from_pylist(out, fields)

    # a row for each component, of mostly two lines; dealt over all cores, as their work doesn't show in their size
    spark = streets.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = F.array_sort(F.collect_list(F.struct("idx", "osm_id", "geometry"))).alias("lines")
    rows = streets.join(linked, "idx").repartition(tasks, "component").groupBy("component").agg(F.min("name").alias("name"), F.min("highway").alias("highway"), lines)
    merged = rows.select(F.col("component").cast("int").alias("component"), "name", "highway", "lines").mapInArrow(run, schema)
    return alone.select(F.col("component").cast("int").alias("component"), "osm_id", "name", "highway", "geometry").unionByName(merged)
