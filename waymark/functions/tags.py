"""Rules on tags (a map column): what counts as a house, street, boundary or point of interest, and its names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tag rules.
AMENITIES = ("fast_food", "restaurant", "cafe", "bar", "pub", "fuel", "hospital", "school", "university", "pharmacy", "bank", "parking", "atm", "charging_station", "dentist", "post_office", "toilets")
TOURISM = ("hotel", "museum", "attraction")
RAILWAY = ("station", "halt")
LEISURE = ("park", "garden", "playground", "sports_centre", "swimming_pool")
LANDUSE = ("recreation_ground", "village_green")
BLOCKED_HIGHWAYS = ("construction", "proposed", "path", "footway", "cycleway", "bridleway", "steps", "pedestrian", "platform", "corridor")
RECOVERED_HIGHWAYS = ("motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "unclassified", "residential", "living_street", "road")
AREA_VALUES = ("yes", "1", "true")
CONNECTOR_NODES, ROUNDABOUT_NODES = 24, 128


def tag(tags: Column, key: str) -> Column:
    """A tag's value, trimmed; empty if missing."""
    return F.coalesce(F.regexp_replace(tags[key], r"^[ \t\n\r]+|[ \t\n\r]+$", ""), F.lit(""))


def localized(tags: Column, key: str, lang: str) -> Column:
    """The tag in a language where it has a value (before trimming), else the plain one."""
    if not lang:
        return tag(tags, key)
    own = F.coalesce(tags[f"{key}:{lang}"], F.lit(""))
    return F.when(own != "", tag(tags, f"{key}:{lang}")).otherwise(tag(tags, key))


def first_of(*columns: Column) -> Column:
    """The first that isn't empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def street_name(tags: Column, lang: str = "") -> Column:
    return first_of(localized(tags, "name", lang), localized(tags, "official_name", lang), tag(tags, "ref"))


def poi_name(tags: Column, lang: str = "") -> Column:
    return first_of(localized(tags, "name", lang), localized(tags, "brand", lang), localized(tags, "operator", lang))


def poi_class(tags: Column) -> Column:
    """struct(key, value, category); all empty if the object is no point of interest. The first rule that fits wins."""
    v = {k: tag(tags, k) for k in ("amenity", "shop", "tourism", "railway", "leisure", "landuse")}

    def made(key: str, category: Column) -> Column:
        return F.struct(F.lit(key).alias("key"), v[key].alias("value"), category.alias("category"))

    none = F.struct(F.lit("").alias("key"), F.lit("").alias("value"), F.lit("").alias("category"))
    return (
        F.when(v["amenity"].isin(*AMENITIES), made("amenity", v["amenity"]))
        .when((v["shop"] != "") & (v["shop"] != "no"), made("shop", F.lit("shop")))
        .when(v["tourism"].isin(*TOURISM), made("tourism", v["tourism"]))
        .when(v["railway"].isin(*RAILWAY), made("railway", F.lit("railway_station")))
        .when(v["leisure"].isin(*LEISURE), made("leisure", F.when(v["leisure"] == "garden", "park").otherwise(v["leisure"])))
        .when(v["landuse"].isin(*LANDUSE), made("landuse", F.lit("park")))
        .otherwise(none)
    )


def has_address(tags: Column) -> Column:
    return (tag(tags, "addr:housenumber") != "") | (tag(tags, "addr:street") != "")


def is_building_house(tags: Column) -> Column:
    """Ways and relations with an address are houses only if they are buildings."""
    return (tag(tags, "building") != "") & has_address(tags)


def is_street_like(tags: Column) -> Column:
    highway = tag(tags, "highway")
    return (highway != "") & ~tag(tags, "area").isin(*AREA_VALUES) & ~highway.isin(*BLOCKED_HIGHWAYS)


def is_named_street(tags: Column) -> Column:
    return is_street_like(tags) & (street_name(tags) != "")


def is_roundabout(tags: Column) -> Column:
    return tag(tags, "junction") == "roundabout"


def is_recovery_candidate(tags: Column) -> Column:
    """A street without a name that may connect named ones."""
    return is_street_like(tags) & (street_name(tags) == "") & (is_roundabout(tags) | tag(tags, "highway").isin(*RECOVERED_HIGHWAYS))


def admin_level(tags: Column) -> Column:
    """The number that admin_level starts with, if it lies in 2..12; else null."""
    level = F.regexp_extract(tag(tags, "admin_level"), r"^\s*([+-]?\d{1,9})", 1).try_cast("int")
    return F.when(level.between(2, 12), level)


def is_boundary(tags: Column) -> Column:
    return (tag(tags, "boundary") == "administrative") & admin_level(tags).isNotNull()


def way_classes(tags: Column, in_relation: Column, recovered: Column) -> Column:
    """struct of the kinds that a way is; it may be several at once."""
    return F.struct(
        in_relation.alias("needed_for_relation"),
        is_building_house(tags).alias("house"),
        (is_named_street(tags) | recovered).alias("street"),
        is_boundary(tags).alias("admin"),
        (poi_class(tags)["category"] != "").alias("poi"),
    )


def house_label(street: Column, number: Column) -> Column:
    return F.concat_ws(" ", F.nullif(street, F.lit("")), F.nullif(number, F.lit("")))


def street_label(name: Column, highway: Column) -> Column:
    return first_of(name, F.when(highway != "", F.concat(F.lit("unnamed "), highway, F.lit(" road"))).otherwise("unnamed road"))


def poi_label(name: Column, brand: Column, category: Column) -> Column:
    return first_of(name, brand, category, F.lit("POI"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
