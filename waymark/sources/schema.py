"""Schemas of the tables, raw and built, and the bundle of built tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geometry import POINT, bbox
from waymark.operators.graph import cut

LINE = f"array<{POINT}>"
BOX = "min_lat int, max_lat int, min_lon int, max_lon int"

RAW = {
    "osm_nodes": "id long, lat double, lon double, tags map<string,string>",
    "osm_ways": "id long, nodes array<long>, tags map<string,string>",
    "osm_relations": "id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>",
}

BUILT = {
    "houses": "idx int, osm_id long, lat_e7 int, lon_e7 int, house_number string, street string, postcode string, city string, country string, source byte",
    "streets": f"idx int, osm_id long, name string, highway string, geometry {LINE}, {BOX}",
    "admin_areas": f"idx int, osm_id long, name string, admin_level byte, source byte, `outer` {LINE}, {BOX}",
    "admin_rings": f"area_idx int, ring_no int, role byte, geometry {LINE}",
    "pois": "idx int, osm_id long, lat_e7 int, lon_e7 int, name string, category string, tag_key string, tag_value string, brand string, source byte",
    "house_admin": "idx int, ord int, area_idx int",
    "street_admin": "idx int, ord int, area_idx int",
    "poi_admin": "idx int, ord int, area_idx int",
    "admin_parent": "idx int, ord int, area_idx int",
    "postings_context": "token string, type byte, idx int",
    "postings_primary": "token string, type byte, idx int",
    "search_docs": "type byte, idx int, name_norm string, label_norm string, brand_norm string, name_tokens array<string>, number_tokens array<string>, number_norm string, street_norm string, postcode_tokens array<string>, city_tokens array<string>, own_tokens array<string>, brand_tokens array<string>, admin_tokens array<string>, name_is_place boolean, has_place_token boolean",
    "vocabulary": "token string",
}

#: Types of search results, and feature sources.
HOUSE, STREET, ADMIN, POI = 1, 2, 3, 4
NODE, WAY, RELATION = 1, 2, 3
TYPE_NAMES = {HOUSE: "house", STREET: "street", ADMIN: "admin_area", POI: "poi"}
TYPE_ALIASES = {"house": HOUSE, "houses": HOUSE, "address": HOUSE, "addresses": HOUSE, "street": STREET, "streets": STREET, "road": STREET, "roads": STREET, "admin": ADMIN, "admin_area": ADMIN, "area": ADMIN, "poi": POI, "pois": POI, "place": POI, "places": POI}


def type_number(name: str | None) -> int:
    """The type that a name stands for; 0 (all types) if it is none."""
    return TYPE_ALIASES.get((name or "").strip().lower(), 0)


def type_of(name: Column) -> Column:
    """type_number() of a column."""
    kinds = F.create_map(*map(F.lit, chain.from_iterable(TYPE_ALIASES.items())))
    return F.coalesce(F.try_element_at(kinds, F.lower(F.regexp_replace(name, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", ""))), F.lit(0))


def with_box(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    return df.withColumn("_b", bbox(F.col(geometry))).select("*", "_b.min_lat", "_b.max_lat", "_b.min_lon", "_b.max_lon").drop("_b")


def numbered(df: DataFrame, *order: Column, name: str = "idx", kind: str = "int") -> DataFrame:
    """df with a dense number from 0 in the given order. Rows are range-partitioned and counted per partition; no task
    holds more than its range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged.withColumn("_m", F.monotonically_increasing_id()))
    run = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first")).withColumn("_before", F.coalesce(F.sum("_n").over(run), F.lit(0)))
    out = ranged.join(F.broadcast(counts), "_p")  # a row per partition
    return out.withColumn(name, (F.col("_before") + F.col("_m") - F.col("_first")).cast(kind)).drop("_p", "_m", "_n", "_first", "_before")


@dataclass
class GeoDataset:
    """The built tables by name (see BUILT), and the language of names."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    language: str = "de"

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def indexed(self) -> bool:
        return "postings_context" in self.tables
