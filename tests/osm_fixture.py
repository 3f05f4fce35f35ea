"""A small town made by hand: raw nodes, ways and relations."""

from waymark.sources.schema import RAW


def square(first: int, lat: float, lon: float, side: float) -> list[tuple]:
    """Four corner nodes."""
    return [(first + i, lat + side * a, lon + side * b, {}) for i, (a, b) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))]


NODES = [
    *square(100, 48.0, 9.0, 1.0),  # outer boundary of Musterstadt
    *square(110, 48.4, 9.4, 0.2),  # hole in it
    *square(120, 48.02, 9.02, 0.1),  # Altstadt, a closed way
    *square(130, 50.0, 11.0, 0.5),  # second outer ring of Musterstadt
    *square(140, 48.05, 9.05, 0.0004),  # a building
    (1, 48.051, 9.051, {"addr:street": "Königstraße", "addr:housenumber": "1", "addr:postcode": "70173", "addr:city": "Musterstadt"}),
    (2, 48.052, 9.051, {"addr:street": "Königstraße"}),
    (3, 48.06, 9.06, {"amenity": "cafe", "name": "Cafe Blau", "name:de": " Café Blau "}),
    (4, 48.061, 9.061, {"leisure": "garden", "name": "Rosengarten"}),
    (5, 48.062, 9.062, {"shop": "mobile_phone", "brand": "Fon"}),
    (6, 48.063, 9.063, {"shop": "no"}),
    (7, 48.0605, 9.0605, {"shop": "supermarket", "name": "Markt Eins"}),
    (20, 48.0500, 9.0600, {}), (21, 48.0510, 9.0600, {}), (22, 48.0520, 9.0600, {}), (23, 48.0510, 9.0610, {}), (24, 48.0530, 9.0600, {}),
    (25, 48.0535, 9.0605, {}), (26, 48.0540, 9.0600, {}), (27, 49.5, 9.9, {}), (28, 49.5001, 9.9, {}), (29, 49.5001, 9.9001, {}),
    (0, 48.0, 9.0, {"addr:street": "Nirgendwo"}),
]
WAYS = [
    (10, [20, 21], {"highway": "residential", "name": "Königstraße"}),
    (11, [21, 22], {"highway": "residential", "name": "Königstraße"}),
    (12, [21, 23], {"highway": "residential", "name": "Königstraße"}),
    (13, [22, 24], {"highway": "tertiary", "name": "Königstraße"}),
    (14, [24, 999, 25], {"highway": "residential"}),  # touches a named street; a node is missing
    (15, [27, 28], {"highway": "residential"}),  # touches none
    (16, [25, 26, 24, 25], {"highway": "service", "junction": "roundabout"}),
    (17, [22, 24], {"highway": "footway", "name": "Fußweg"}),
    (18, [22, 24], {"highway": "residential", "name": "Platz", "area": "yes"}),
    (19, [26, 29], {"highway": "primary", "ref": "A 5"}),
    (30, [140, 141, 142, 143, 140], {"building": "yes", "addr:street": "Weg", "addr:housenumber": "7"}),
    (31, [140, 141, 142, 143, 140], {"addr:street": "Weg", "addr:housenumber": "8"}),
    (40, [100, 101], {}), (41, [102, 101], {}), (42, [102, 103, 100], {}),
    (43, [110, 111, 112, 113, 110], {}),
    (44, [130, 131, 132, 133, 130], {}),
    (45, [120, 121, 122, 123, 120], {"boundary": "administrative", "admin_level": "9", "name": "Altstadt"}),
]
RELATIONS = [
    (1, [("way", 40, "outer"), ("way", 41, "outer"), ("way", 42, "outer"), ("way", 43, "inner"), ("way", 44, "outer"), ("node", 1, "label")], {"boundary": "administrative", "admin_level": "8;9", "name": "Musterstadt"}),
    (2, [("way", 44, "outer")], {"boundary": "administrative", "admin_level": "1", "name": "Zu hoch"}),
    (3, [("way", 44, "outer")], {"boundary": "administrative", "admin_level": "x", "name": "Keine Zahl"}),
]


def raw(spark):
    return tuple(spark.createDataFrame(rows, RAW[name]) for name, rows in (("osm_nodes", NODES), ("osm_ways", WAYS), ("osm_relations", RELATIONS)))
