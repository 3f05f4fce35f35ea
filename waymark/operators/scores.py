"""Scores of candidates for a query whose parts are columns: literals for one query, columns of a table for many."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import rules as K
from waymark.functions import text as X

STRINGS = "array<string>"


def lits(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast(STRINGS)


def points(condition: Column, n: int | Column) -> Column:
    return F.when(condition, n).otherwise(0)


def best_of(variants: Column, toks: Column) -> Column:
    """The most matches that any of several lists of words has with toks."""
    return F.coalesce(F.array_max(F.transform(variants, lambda v: X.matches(v, toks))), F.lit(0))


@dataclass(frozen=True)
class Asked:
    """The parts of a query: its numbers, postcodes and other words, its number of tokens and its normalized text; for one token,
    all that stands for it (alternatives); for one word, its spellings (qualities); the words with each place name exchanged
    (variants), and whether they name an area (known)."""

    numbers: Column
    postcodes: Column
    words: Column
    n_tokens: Column
    norm: Column
    alternatives: Column
    qualities: Column
    variants: Column
    known: Column

    @property
    def single(self) -> Column:
        return self.n_tokens == 1

    @property
    def numbered(self) -> Column:
        return F.size(self.numbers) > 0

    @property
    def coded(self) -> Column:
        return F.size(self.postcodes) > 0

    def quality(self, toks: Column) -> Column:
        return F.when(self.single, X.best_quality(self.qualities, toks)).otherwise(0)


def house(a: Asked, matched: Column) -> Column:
    """Null for houses that the query doesn't ask for."""
    number = F.arrays_overlap("number_tokens", a.numbers)
    postcode = ~a.coded | F.arrays_overlap("postcode_tokens", a.postcodes)
    score = 120 + 15 * matched + 80 + points(a.coded, 45) + 25 * X.matches(a.words, F.col("name_tokens")) + 12 * (X.matches(a.words, F.col("city_tokens")) + X.matches(a.words, F.col("admin_tokens")))
    return F.when(a.numbered & number & postcode, score)


def street(a: Asked, matched: Column) -> Column:
    toks, n = F.col("name_tokens"), F.size(a.words)
    quality = a.quality(toks)
    phrase = X.has_phrase(a.norm, F.col("name_norm"))
    found = X.matches(a.words, toks)
    placelike = (n > F.size(toks)) & (F.col("name_is_place") | ((F.size(toks) == 1) & toks[0].isin(*X.PLACE_NAMES)))
    mostly = (n > found) & ~phrase & F.col("has_place_token")
    score = F.when(a.numbered, 35).otherwise(95) + 15 * matched + 25 * found + 10 * X.matches(a.words, F.col("admin_tokens"))
    score = score + points(F.col("name_norm") == a.norm, 50) + points(X.same_street_as(a.words, toks), 1100) + points(phrase, 620 + 240 * F.size(toks))
    score = score + 3 * quality - points(placelike, 420) - points(mostly, 420)
    return F.when(~a.single | (quality > 0) | F.arrays_overlap(toks, a.alternatives), score)


def admin_importance(level: Column, box: dict[str, Column]) -> Column:
    lat, lon = (box["max_lat"].cast("long") - box["min_lat"]), (box["max_lon"].cast("long") - box["min_lon"])
    spread = F.when((lat > 0) & (lon > 0), F.floor(F.least(F.lit(900.0), F.sqrt(G.degrees(lat) * G.degrees(lon)) * 360.0))).otherwise(0)
    return F.greatest(F.lit(0), 14 - level.cast("int")) * 90 + F.coalesce(spread, F.lit(0)).cast("int")


def admin(a: Asked, matched: Column) -> Column:
    toks, level, n = F.col("name_tokens"), F.col("admin_level").cast("int"), F.size(a.words)
    quality = a.quality(toks)
    exact = X.equals_place(F.col("name_norm"), a.norm, a.words)
    names, parents = best_of(a.variants, toks), best_of(a.variants, F.col("admin_tokens"))
    boost = F.when(a.single, F.when(level <= 6, 2600).when(level <= 8, 1700).otherwise(200)).otherwise(F.when(level <= 8, 2600).otherwise(1700))
    score = F.when(a.numbered, 10).when(a.single, 135).otherwise(75) + 15 * matched + 25 * names + 8 * parents + 3 * F.greatest(F.lit(0), 14 - level) + points(exact, boost)
    by_level = F.when(level == 0, 0).when(level <= 6, 2600).when(level == 7, 1150).when(level == 8, 200).when(level == 9, -900).otherwise(-3200)
    box = {c: F.col(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")}
    alone = 4 * quality + points(F.size(toks) == 1, 850) + F.least(admin_importance(level, box), F.when(exact, 1000).otherwise(700)) + by_level
    score = score + points(a.single, alone)
    score = score + points(a.known, points(exact & (level <= 8), 900) + points((names == n) & (level <= 8), 900))
    plain_word = ~a.numbered & ~a.coded & (n > 0)
    return F.when(~a.single | ((quality > 0) & (~plain_word | ~X.street_like(F.get(a.words, F.lit(0))))), score)


def poi(a: Asked, matched: Column, focus: tuple[int, int] | None = None, viewport: tuple[int, int, int, int] | None = None) -> Column:
    own = F.col("own_tokens")
    quality = a.quality(own)
    in_admin = best_of(a.variants, F.col("admin_tokens"))
    named = [(F.length(c) >= 3) & X.has_phrase(a.norm, F.col(c)) for c in ("name_norm", "brand_norm")]
    score = F.when(a.numbered, 20).otherwise(105) + 15 * matched + 30 * X.matches(a.words, own) + 12 * in_admin + points(F.col("label_norm") == a.norm, 55) + points(named[0] | named[1], 1100)
    score = score + K.text_relevance(F.col("name"), F.col("brand"), F.col("label"), F.col("category"), F.col("tag_value"), a.words, a.norm) + K.type_score(F.col("tag_key"), F.col("tag_value"), a.words)
    if focus:
        d = G.distance_m(F.lit(focus[0]), F.lit(focus[1]), F.col("lat_e7"), F.col("lon_e7"))
        score = score + F.greatest(F.lit(0), 180 - F.floor(F.least(F.lit(180.0), d / 250)).cast("int"))
    if viewport:
        score = score + points(G.in_box(F.col("lat_e7"), F.col("lon_e7"), *viewport), 160)
    score = score + 2 * quality + points(a.known, F.when(in_admin > 0, 420).otherwise(-1900))
    return F.when(~a.single | (quality > 0) | F.arrays_overlap(own, a.alternatives), score)


def street_place(words: Column, norm: Column, street: Column, named: Column, rarity: Column) -> Column:
    """Of a street (name_tokens, name_norm, name_is_place, same, in_place, near) under a split of a text into street and place."""
    toks = F.col("name_tokens")
    phrase = X.has_phrase(norm, F.col("name_norm"))
    placelike = (F.size(words) > F.size(toks)) & F.col("name_is_place")
    score = 170 + 38 * F.size(street) + 28 * F.col("in_place") + 6 * (X.matches(words, toks) + F.col("in_place")) + points(F.col("same"), 30) + F.when(named, 240).otherwise(-110)
    return score + points(F.col("near").isNotNull(), 900) + F.coalesce("near", F.lit(0)) + rarity + points(phrase, 220 + 160 * F.size(toks)) - points(placelike, 360)


def brand_place(brand: Column, in_place: Column) -> Column:
    """Of a POI (own, label, brand_tokens, name_norm, brand_norm) under a split of a query into brand and place."""
    phrase, n = F.array_join(brand, " "), F.size(brand)
    field = X.has_all(F.col("brand_tokens"), brand)
    score = 520 + 70 * n + 180 * in_place + points(field, 420) + points(X.has_phrase(F.col("label"), phrase), 130)
    score = score + points((F.col("name_norm") == phrase) | (F.col("brand_norm") == phrase), 1200) - points(in_place == 0, 260)
    return score - points((n == 1) & ~field & (F.size("own") > 3), 220)
