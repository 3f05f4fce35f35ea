"""GeoEngine: everything that can be asked of a built dataset, as DataFrames."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import intent as I
from waymark.functions import text as X
from waymark.functions.rules import concepts, family_in, reference_category, service_in, target_concept
from waymark.functions.tags import any_of
from waymark.functions.text import ordered_tokens_py
from waymark.operators import forward, natural, reverse, viewport
from waymark.operators.forward import Forward, QueryError
from waymark.plans import build as B
from waymark.plans.index import add_index
from waymark.sources import snapshot
from waymark.sources.export import write_geojson
from waymark.sources.schema import POI, TYPE_ALIASES, GeoDataset


def coordinate(value: float | str | None, most: float) -> int | None:
    """Degrees * 1e7 of a number or its text; None if it is missing, has trailing characters or is out of range."""
    try:
        v = float(value)
    except (TypeError, ValueError):
        return None
    return round(v * 1e7) if math.isfinite(v) and abs(v) <= most else None


def clamp(value: int | str | None, low: int, high: int, default: int) -> int:
    """An integer within bounds; the default if it is none."""
    try:
        return min(max(int(value), low), high)
    except (TypeError, ValueError):
        return default


@dataclass
class Answer:
    """Rows, and what else there is to say about them."""

    rows: DataFrame
    info: dict


class GeoEngine:
    def __init__(self, data: GeoDataset, generate: Callable[[str], str] | None = None):
        """generate: a language model (prompt -> text) for natural(use_model=True)."""
        self.data, self.generate = data, generate

    @classmethod
    def parse(cls, nodes: DataFrame, ways: DataFrame, relations: DataFrame, language: str = "de", connect_streets: bool = False, **options) -> GeoEngine:
        """From raw tables (sources.schema.RAW): entities, areas, text index."""
        return cls(add_index(B.build(nodes, ways, relations, language, connect_streets)), **options)

    @classmethod
    def load(cls, spark: SparkSession, path: str, connect_streets: bool = False, **options) -> GeoEngine:
        """From a snapshot. connect_streets: connects them now, and attributes and indexes anew."""
        data = snapshot.load_snapshot(spark, path)
        return cls(add_index(B.attribute(B.connected(data))) if connect_streets else data, **options)

    def save(self, path: str) -> None:
        snapshot.write_snapshot(self.data, path)

    def export_geojson(self, path: str, **limits: int) -> None:
        write_geojson(self.data, path, **limits)

    def stats(self) -> DataFrame:
        return B.counters(self.data)

    def geocode(self, q: str | None, limit: int | str | None = 20, type: str | None = None, lat=None, lon=None, box: tuple[float, float, float, float] | None = None, explain: bool = False) -> Answer:
        """Addresses, streets, areas and places for a text. box: min_lat, max_lat, min_lon, max_lon. Raises QueryError."""
        focus = (coordinate(lat, 90), coordinate(lon, 180))
        asked = Forward(self.data, q or "", clamp(limit, 1, 100, 20), type, focus if None not in focus else None, viewport.box_of(*box) if box else None)
        rows = asked.labelled()
        if explain:
            rows.explain("formatted")
        return Answer(rows, {"query": q, "normalized": asked.query.norm, "index": "primary" if asked.query.plain else "context", "address_resolution": asked.resolution, "message": forward.MESSAGES[asked.resolution], "exact_house": asked.exact_house, "street_level": asked.resolution == "street_level"})

    def _place(self, query: str) -> str:
        spans = I.place_spans(query)
        places = forward.Places(self.data, sorted({t for s in spans for t in s}))
        return next((" ".join(s) for s in spans if places.known(s)), "")

    def _is_place(self, words: list[str]) -> bool:
        return forward.Places(self.data, words).any_of(words)

    def has_named_poi(self, name: str, place: str) -> bool:
        """Whether some POI's name or brand has the phrase, and the place (if any) in full among its areas' names."""
        words, norm = X.tokens_py(name), X.normalize_py(name)
        if not words:
            return False
        docs = self.data.search_docs.where((F.col("type") == POI) & X.has_all(F.col("own_tokens"), forward.lits(words)))
        docs = docs.where(X.has_phrase(F.col("name_norm"), F.lit(norm)) | X.has_phrase(F.col("brand_norm"), F.lit(norm)))
        if place:
            docs = docs.where(any_of([X.has_all(F.col("admin_tokens"), forward.lits(v)) for v in forward._word_variants(X.tokens_py(place))]))
        return docs.limit(1).count() > 0

    def intent(self, q: str, use_model: bool = False) -> I.Intent:
        """What a query asks for: by rules, or by the model and then set right by rules and the loaded names."""
        plain = I.deterministic(q)
        found = I.from_model(q, self.generate) if use_model and self.generate else plain
        place = self._place(q)
        plain, found = (replace(x, place=place) if x.type == I.NAMED and not x.place else x for x in (plain, found))
        if found is not plain and found.from_model:
            reference = reference_category(q)
            free = not (reference or family_in(q) or service_in(q) or target_concept(q))
            outright = not reference and bool({"at", "bei"} & set(ordered_tokens_py(q)))
            named = plain.type == I.NAMED and (free or outright) and self.has_named_poi(plain.poi_name, plain.place)
            reclassified = free and plain.type == I.NAMED and found.type in (I.CATEGORY, I.CONCEPT)
            backed = found.type == I.NAMED and self.has_named_poi(found.poi_name, found.place)
            if (named or reclassified) and not backed:
                found = replace(plain, from_model=True, verified=found.verified, corrected="loaded names" if named else "named-entity grammar", summary=found.summary)
        if found.type in (I.CATEGORY, I.CONCEPT) and not found.address:
            found = replace(found, address=place)
        return found

    def natural(self, q: str | None, limit: int | str | None = 10, type: str | None = None, lat=None, lon=None, box: tuple[float, float, float, float] | None = None, use_model: bool = False, exact: bool = False) -> Answer:
        """Places that offer what a sentence asks for, near an address in it or near lat, lon. Raises QueryError."""
        if not forward.Query(q or "").norm:
            raise QueryError("missing q parameter")
        found = self.intent(q, use_model)
        if found.type == I.UNKNOWN:
            raise QueryError("query intent not understood")
        asked = forward.Query(q)
        if asked.short_address():
            answer = self.geocode(q, clamp(limit, 1, 100, 20), type, lat, lon, box)
            return Answer(answer.rows, answer.info | {"intent": "address", "origin_source": "address"})
        if found.type == I.NAMED:
            answer = self.geocode(f"{found.place} {found.poi_name}".strip(), clamp(limit, 1, 100, 20), type, lat, lon, box)
            return Answer(answer.rows, answer.info | {"intent": found.type, "poi_name": found.poi_name, "place": found.place})
        info = {"intent": found.type, "category": found.category, "concept": found.concept, "concept_label": concepts().get(found.concept, ("",))[0], "product_family": found.product_family, "ignored_address": "", "ignored_reason": "", "corrected": found.corrected}
        if found.address:
            refusal = I.anchor_refusal(q, found.address, found.from_model, self._is_place)
            if refusal:
                info |= {"ignored_address": found.address, "ignored_reason": refusal}
                found = replace(found, address="", reference_category=found.reference_category or reference_category(found.address))
        found = replace(found, reference_category=found.reference_category or reference_category(q))
        origin, source = None, "none"
        if found.address:
            try:
                first = self.geocode(found.address, 1).rows.first()
            except QueryError:
                first = None
            if first:
                origin, source = (round(first["lat"] * 1e7), round(first["lon"] * 1e7)), "address"
        here = (coordinate(lat, 90), coordinate(lon, 180))
        if origin is None and None not in here:
            origin, source = here, "viewport"
        info |= {"address": found.address, "reference_category": found.reference_category, "origin_source": source}
        view = viewport.box_of(*box) if box else None
        rows = natural.natural_search(self.data.pois, found, q, origin or (0, 0), view, source != "address", clamp(limit, 1, 50, 10), exact)
        kind = TYPE_ALIASES.get((type or "").strip().lower(), 0)
        return Answer(rows if origin is not None and kind in (0, POI) else rows.where("false"), info)

    def reverse(self, points: DataFrame) -> DataFrame:
        """points: point_id, lat, lon. See operators.reverse.reverse_geocode."""
        return reverse.reverse_geocode(points, self.data)

    def reverse_areas(self, points: DataFrame, results: DataFrame) -> DataFrame:
        return reverse.result_areas(points, results, self.data)

    def reverse_one(self, lat: float, lon: float) -> DataFrame:
        if coordinate(lat, 90) is None or coordinate(lon, 180) is None:
            raise QueryError("missing or invalid coordinates")
        return self.reverse(self.data.houses.sparkSession.createDataFrame([(0, float(lat), float(lon))], "point_id long, lat double, lon double"))

    def houses(self, min_lat: float, max_lat: float, min_lon: float, max_lon: float, limit: int = 1500) -> DataFrame:
        return viewport.houses_in(self.data.houses, viewport.box_of(min_lat, max_lat, min_lon, max_lon), limit)

    def streets(self, min_lat: float, max_lat: float, min_lon: float, max_lon: float, limit: int = 2000) -> DataFrame:
        return viewport.streets_in(self.data.streets, viewport.box_of(min_lat, max_lat, min_lon, max_lon), limit)

    def areas(self, min_lat: float, max_lat: float, min_lon: float, max_lon: float, limit: int = 300, min_level: int = 2, max_level: int = 10, detail: str = "", max_points: int = 500) -> DataFrame:
        points = None if detail == "full" else clamp(max_points, 20, 200_000, 500)
        return viewport.areas_in(self.data.admin_areas, viewport.box_of(min_lat, max_lat, min_lon, max_lon), limit, min_level, max_level, points)

    def area(self, index: int | None = None, osm_id: int | None = None, detail: str = "", max_points: int = 2000) -> DataFrame:
        points = None if detail == "full" else clamp(max_points, 20, 200_000, 2000)
        return viewport.area_by(self.data.admin_areas, index, osm_id, points)
