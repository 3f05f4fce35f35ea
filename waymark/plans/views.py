"""A geographic dataset derived from star-schema tables, for trying the operators at any scale.

Customers are houses, parts are nodes and points of interest, line items tie orders (streets) to parts (nodes), nations
are triangles of level 8 in a 5 x 5 grid and regions are rectangles of level 4 around the grid's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.schema import GeoDataset, with_box

LAT0, LON0, SPAN, SIDE = 470_000_000, 90_000_000, 8_000_000, 1_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(key: str) -> list[Column]:
    return [(LAT0 + (F.col(key) * 7919) % SPAN).cast("int").alias("lat_e7"), (LON0 + (F.col(key) * 104729) % SPAN).cast("int").alias("lon_e7")]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, lat_e7, lon_e7 of customers."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), *at("c_custkey"))


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    text = lambda c: c.cast("string")
    return table(spark, sf_dir, "customer").select(key.cast("int").alias("idx"), (key + 1).alias("osm_id"), *at("c_custkey"), text(key % 40 + 1).alias("house_number"), F.concat("c_mktsegment", F.lit("STRAßE")).alias("street"), text(10_000 + key % 90).alias("postcode"), F.concat(F.lit("Stadt "), text(F.col("c_nationkey"))).alias("city"), F.lit("").alias("country"), F.lit(1).cast("byte").alias("source"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat_e7, lon_e7 of parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *at("p_partkey"))


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"ECONOMY": "supermarket", "SMALL": "convenience", "MEDIUM": "bakery", "PROMO": "mobile_phone", "STANDARD": "chemist"}
    value = F.lit("department_store")
    for k, v in values.items():
        value = F.when(F.col("p_type") == k, v).otherwise(value)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("idx"), (F.col("p_partkey") + 1).alias("osm_id"), *at("p_partkey"), F.col("p_name").alias("name"), F.lit("shop").alias("category"), F.lit("shop").alias("tag_key"), value.alias("tag_value"), F.col("p_brand").alias("brand"), F.lit(1).cast("byte").alias("source"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, nodes (in order) of orders that have line items."""
    order = F.struct("l_linenumber", "l_partkey")  # what follows in the order can't tell between equal nodes
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(order)).alias("l"))
    return lines.select("id", F.transform("l", lambda x: x["l_partkey"]).alias("nodes"))


def raw_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, nodes, tags: named if the order is finished, roundabouts if it is pending; five kinds of highway."""
    orders = table(spark, sf_dir, "orders")
    kinds = {"1-URGENT": "primary", "2-HIGH": "residential", "3-MEDIUM": "footway", "4-NOT SPECIFIED": "service"}
    kind = F.lit("living_street")
    for k, v in kinds.items():
        kind = F.when(F.col("o_orderpriority") == k, v).otherwise(kind)
    tags = F.map_from_arrays(F.array(*map(F.lit, ("highway", "name", "junction"))), F.array(kind, F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" Weg "), (F.col("o_orderkey") % 200).cast("string"))).otherwise(""), F.when(F.col("o_orderstatus") == "P", "roundabout").otherwise("")))
    return way_nodes(spark, sf_dir).join(orders.select(F.col("o_orderkey").alias("id"), tags.alias("tags")), "id")


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One street an order of two nodes or more."""
    # the order of way_nodes, with the points joined before line items are gathered, so that they are gathered once, where they meet
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_partkey").alias("ref"))
    spots = nodes(spark, sf_dir).select(F.col("id").alias("ref"), F.struct("lat_e7", "lon_e7").alias("p"))
    lines = refs.join(spots, "ref").repartition("id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "ref", "p"))).alias("l")).select("id", F.col("l.p").alias("geometry"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority")
    rows = lines.where(F.size("geometry") >= 2).join(orders.hint("shuffle_hash"), "id")
    name = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("Weg "), (F.col("id") % 200).cast("string")))
    return with_box(rows.select(F.col("id").cast("int").alias("idx"), (F.col("id") + 1).alias("osm_id"), name.alias("name"), F.lower("o_orderpriority").alias("highway"), "geometry"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    def ring(corners: list[tuple[Column, Column]]) -> Column:
        return F.array(*[F.struct(a.cast("int").alias("lat_e7"), b.cast("int").alias("lon_e7")) for a, b in [*corners, corners[0]]])

    k, r = F.col("n_nationkey"), F.col("r_regionkey")
    lat, lon = LAT0 + F.floor(k / 5) * SIDE, LON0 + (k % 5) * SIDE
    nations = table(spark, sf_dir, "nation").select(k.cast("int").alias("idx"), F.col("n_name").alias("name"), F.lit(8).cast("byte").alias("admin_level"), ring([(lat, lon), (lat + SIDE, lon), (lat, lon + SIDE)]).alias("outer"))
    low, west, east = LAT0 + r * SIDE, F.lit(LON0), F.lit(LON0 + SPAN)
    regions = table(spark, sf_dir, "region").select((25 + r).cast("int").alias("idx"), F.col("r_name").alias("name"), F.lit(4).cast("byte").alias("admin_level"), ring([(low, west), (low + SIDE, west), (low + SIDE, east), (low, east)]).alias("outer"))
    both = nations.unionByName(regions)
    return with_box(both.select("idx", (F.col("idx") + 1).cast("long").alias("osm_id"), "name", "admin_level", F.lit(3).cast("byte").alias("source"), "outer"), "outer")


def dataset(spark: SparkSession, sf_dir: str) -> GeoDataset:
    a = areas(spark, sf_dir)
    rings = a.select(F.col("idx").alias("area_idx"), F.lit(0).alias("ring_no"), F.lit(0).cast("byte").alias("role"), F.col("outer").alias("geometry"))
    return GeoDataset({"houses": houses(spark, sf_dir), "streets": streets(spark, sf_dir), "pois": pois(spark, sf_dir), "admin_areas": a, "admin_rings": rings})
