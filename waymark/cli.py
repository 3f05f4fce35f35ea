"""Command line: python -m waymark.cli --parse DIR | --load DIR [--save DIR] [--geojson DIR] [--geocode Q] [--natural Q]
[--reverse LAT,LON]. DIR of --parse holds osm_nodes, osm_ways and osm_relations as Parquet, or is a .pbf file."""

from __future__ import annotations

import argparse
import sys

from waymark.api import GeoEngine
from waymark.session import build_session, ship
from waymark.sources.pbf import read_raw


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="waymark", description=__doc__)
    one = p.add_mutually_exclusive_group(required=True)
    one.add_argument("--parse")
    one.add_argument("--load")
    p.add_argument("--save")
    p.add_argument("--lang", default="de")
    p.add_argument("--connect-streets", action="store_true")
    p.add_argument("--geojson")
    for kind, n in (("houses", 25_000), ("streets", 5_000), ("admin", 500)):
        p.add_argument(f"--geojson-{kind}", type=int, default=n)
    p.add_argument("--geocode")
    p.add_argument("--natural")
    p.add_argument("--reverse")
    a = p.parse_args(argv)
    spark = ship(build_session())
    engine = GeoEngine.parse(*read_raw(spark, a.parse), language=a.lang, connect_streets=a.connect_streets) if a.parse else GeoEngine.load(spark, a.load, a.connect_streets)
    if a.save:
        engine.save(a.save)
    if a.geojson:
        engine.export_geojson(a.geojson, max_houses=a.geojson_houses, max_streets=a.geojson_streets, max_admin=a.geojson_admin)
    engine.stats().show(vertical=True)
    if a.geocode:
        engine.geocode(a.geocode).rows.show(truncate=False)
    if a.natural:
        engine.natural(a.natural).rows.show(truncate=False)
    if a.reverse:
        engine.reverse_one(*map(float, a.reverse.split(","))).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
