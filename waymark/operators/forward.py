"""Forward geocoding: token plans, candidate scoring, planners and ranking.

The plan of a query (which spellings of which token, which splits into street and place) is made on the driver from a few
small lookups in the vocabulary and in area names; matching and scoring is one lazy plan over the postings and the
prepared texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import text as X
from waymark.functions import tags as R
from waymark.functions.tags import any_of, poi_label
from waymark.operators import scores as S
from waymark.operators.graph import cut
from waymark.operators.scores import admin_importance, lits  # noqa: F401
from waymark.plans.index import expansions, posting_counts
from waymark.sources.schema import ADMIN, HOUSE, POI, STREET, TYPE_NAMES, GeoDataset, type_number

# Bounds on postings of expanded tokens, and of the planners.
SINGLE_REFS, MULTI_REFS = 30_000, 250_000
SEMANTIC_ANCHOR = 500_000
BROAD_QUERIES = ("strasse", "strasze", "street", "road", "weg", "gasse", "place", "poi")
MESSAGES = {
    "exact_house": "Exact house point found.",
    "street_level": "Exact house point not found. Showing the matching street.",
    "house_not_found": "Exact house point not found.",
    "street_requested": "A matching house exists, but the street result type was requested.",
    "exact_house_filtered": "A matching house exists, but it is excluded by the selected result type.",
    "address_not_found": "No matching house or street was found in the requested administrative area.",
    "not_address": "",
}
RESULT = ["type", "idx", "matched", "score"]


class QueryError(ValueError):
    """A query that is answered with an error."""


@dataclass
class Query:
    """A query text taken apart."""

    raw: str
    tokens: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.tokens = X.tokens_py(self.raw)
        self.postcodes = [t for t in self.tokens if re.fullmatch("[0-9]{5}", t)]
        self.numbers = [t for t in self.tokens if re.search("[0-9]", t) and t not in self.postcodes]
        self.words = [t for t in self.tokens if t not in self.postcodes and t not in self.numbers]
        self.norm = X.normalize_py(self.raw)
        self.ordered = X.ordered_tokens_py(self.raw)

    @property
    def plain(self) -> bool:
        return not self.numbers and not self.postcodes

    def check(self) -> None:
        if not self.norm:
            raise QueryError("missing q parameter")
        if re.search(r"(^|[\s,;])-[0-9]", self.raw):
            raise QueryError("negative house numbers are invalid")
        if self.plain and len(self.words) == 1 and self.words[0] in BROAD_QUERIES:
            raise QueryError("query is too broad")

    def short_address(self) -> bool:
        return len(self.numbers) == 1 and not self.postcodes and 2 <= len(self.words) <= 4


class Places:
    """Which words of a query are names of areas. One job finds, over all areas, which sets of the query's words (and of
    their names in the other language) occur in a name."""

    def __init__(self, data: GeoDataset, words: Sequence[str]):
        every = sorted({v for w in words for s in X.place_variants([w]) for v in s} | set(words))
        self.sets: list[frozenset[str]] = []
        if every:
            docs = data.search_docs.where((F.col("type") == ADMIN) & F.arrays_overlap("name_tokens", lits(every)))
            found = docs.select(F.array_sort(F.array_intersect("name_tokens", lits(every))).alias("s")).distinct()
            self.sets = [frozenset(r["s"]) for r in found.collect()]

    def exact(self, words: Sequence[str]) -> bool:
        """Whether some area's name has all words."""
        return bool(words) and any(s.issuperset(words) for s in self.sets)

    def known(self, words: Sequence[str]) -> bool:
        return any(self.exact(v) for v in X.place_variants(list(words)))

    def any_of(self, words: Sequence[str]) -> bool:
        return any(X.is_place_alias(w) or self.known([w]) for w in words)

    def resolve(self, words: Sequence[str]) -> tuple[list[str], bool]:
        """The variant that names an area, and whether there is one."""
        for v in X.place_variants(list(words)):
            if self.exact(v):
                return v, True
        return list(words), False


def token_plan(data: GeoDataset, query: Query, postings: DataFrame) -> dict[str, list[str]] | None:
    """For each query token the tokens that stand for it; None if one has none."""
    single = len(query.tokens) == 1
    spelled = {t: X.alternatives(t) for t in query.tokens}
    every = sorted({a for s in spelled.values() for a in s})
    bound = SINGLE_REFS if single else MULTI_REFS

    def counts(toks: Sequence[str]) -> dict[str, int]:
        return {r["token"]: r["n"] for r in posting_counts(postings.where(F.col("token").isin(list(toks)))).collect()} if toks else {}

    have = counts(every)
    spread = {t for t in query.tokens if single or t not in have}
    # a token without postings, or the only one, is expanded in all spellings; of others, those spellings without postings
    wanted = {t: [a for a in spelled[t] if t in spread or (a != t and a not in have)] for t in query.tokens}
    found: dict[str, list[tuple[bool, int, str]]] = {}
    for r in expansions(data.vocabulary, sorted({a for w in wanted.values() for a in w}), 96, 24).collect():
        found.setdefault(r["spelling"], []).append((r["fuzzy"], r["rank"], r["token"]))
    expanded: dict[str, set[str]] = {}
    for t in query.tokens:
        substrings, fuzzy = (96, 24) if t in spread else (64, 12)
        expanded[t] = {e for a in wanted[t] for near, rank, e in found.get(a, []) if rank <= (fuzzy if near else substrings)}
    more = counts(sorted(set().union(*expanded.values())))
    plan: dict[str, list[str]] = {}
    for t in query.tokens:
        fit = {e for e in expanded[t] if e in more and (t not in spread or (e not in spelled[t] and more[e] <= bound))}
        plan[t] = sorted({a for a in spelled[t] if a in have} | fit)
        if not plan[t]:
            return None
    return plan


def candidates(postings: DataFrame, plan: dict[str, list[str]]) -> DataFrame:
    """type, idx, matched of records that have for every query token one of its alternatives."""
    rows = [(a, i) for i, alts in enumerate(plan.values()) for a in alts]
    pairs = postings.sparkSession.createDataFrame(rows, "token string, q int")  # bounded by the expansions of one query
    wanted = postings.where(F.col("token").isin(sorted({a for a, _ in rows})))
    hits = wanted.join(F.broadcast(pairs), "token").groupBy("type", "idx").agg(F.count_distinct("q").alias("matched"))
    return hits.where(F.col("matched") == len(plan))


def asked(query: Query, alternatives: Sequence[str] = (), qualities: Sequence[str] = (), known_place: bool = False) -> S.Asked:
    """One query as literal columns."""
    variants = _word_variants(query.words)
    return S.Asked(lits(query.numbers), lits(query.postcodes), lits(query.words), F.lit(len(query.tokens)), F.lit(query.norm), lits(alternatives), lits(qualities), F.array(*map(lits, variants)), F.lit(known_place))


def house_score(query: Query, matched: Column) -> Column:
    """Null for houses that the query doesn't ask for."""
    return S.house(asked(query), matched)


def street_score(query: Query, matched: Column, alternatives: Sequence[str], qualities: Sequence[str]) -> Column:
    """alternatives: all that the single token stands for; qualities: its spellings, for the quality of the match."""
    return S.street(asked(query, alternatives, qualities), matched)


def admin_score(query: Query, matched: Column, known_place: bool, qualities: Sequence[str]) -> Column:
    return S.admin(asked(query, (), qualities, known_place), matched)


def _word_variants(words: Sequence[str]) -> list[list[str]]:
    """The words, and the words with each place name exchanged for its other name."""
    out = [list(words)]
    for i, w in enumerate(words):
        out += [[*words[:i], v[0], *words[i + 1 :]] for v in X.place_variants([w])[1:]]
    return out


def poi_score(query: Query, matched: Column, alternatives: Sequence[str], qualities: Sequence[str], known_place: bool, focus: tuple[int, int] | None, viewport: tuple[int, int, int, int] | None) -> Column:
    return S.poi(asked(query, alternatives, qualities, known_place), matched, focus, viewport)


class Forward:
    """One query against one dataset."""

    def __init__(self, data: GeoDataset, text: str, limit: int = 20, type_: str | None = None, focus: tuple[int, int] | None = None, viewport: tuple[int, int, int, int] | None = None):
        if not data.indexed:
            raise QueryError("the text index is missing")
        self.data, self.query, self.limit = data, Query(text), min(max(limit, 1), 100)
        self.type = type_number(type_)
        self.focus, self.viewport = focus, viewport
        self.query.check()
        self.places = Places(data, self.query.words)
        if self.query.numbers and not self.query.postcodes and len(self.query.words) == 1 and self.places.exact(self.query.words):
            raise QueryError("address query needs a street name")
        self.resolution = "not_address"
        self.exact_house = False

    @cached_property
    def docs(self) -> DataFrame:
        return self.data.search_docs

    @property
    def postings(self) -> DataFrame:
        return self.data.postings_primary if self.query.plain else self.data.postings_context

    def _of(self, kind: int) -> DataFrame:
        return self.docs.where(F.col("type") == kind)

    def _named_streets(self, records: DataFrame) -> DataFrame:
        """Streets met with records (idx), and their words, which need no areas: type, idx, name_tokens."""
        names = self.data.streets.where("name != ''").select("idx", "name")
        return names.join(records, "idx", "left_semi").select(F.lit(STREET).cast("byte").alias("type"), "idx", X.tokens(F.col("name")).alias("name_tokens"))

    def scored(self) -> DataFrame:
        """Candidates that have every token, with their scores."""
        q, data = self.query, self.data
        plan = token_plan(data, q, self.postings) if q.tokens else None
        if plan is None:
            return data.search_docs.sparkSession.createDataFrame([], "type byte, idx int, matched long, score int")
        hits = cut(candidates(self.postings, plan))
        known = q.plain and 0 < len(q.words) <= 3 and self.places.known(q.words)
        first = next(iter(plan.values()))
        alternatives = sorted({*first, *X.alternatives(q.tokens[0])})
        qualities = X.alternatives(q.words[0]) if len(q.words) == 1 else []
        matched = F.col("matched").cast("int")
        beside = lambda kind: hits.where(F.col("type") == kind).join(self._of(kind), ["type", "idx"])
        kinds = {r["type"] for r in hits.select("type").distinct().collect()}  # four at most; documents of other kinds aren't read
        parts = [hits.select("type", "idx", "matched", F.lit(None).cast("int").alias("score")).where("false")]
        if q.numbers and HOUSE in kinds:
            parts.append(beside(HOUSE).select("type", "idx", "matched", house_score(q, matched).alias("score")))
        if STREET in kinds:
            parts.append(beside(STREET).select("type", "idx", "matched", street_score(q, matched, alternatives, qualities).alias("score")))
        areas = data.admin_areas.select("idx", "admin_level", "min_lat", "max_lat", "min_lon", "max_lon")
        if ADMIN in kinds:
            parts.append(beside(ADMIN).join(areas, "idx").select("type", "idx", "matched", admin_score(q, matched, known, qualities).alias("score")))
        pois = data.pois.select("idx", "lat_e7", "lon_e7", "name", "brand", "category", "tag_key", "tag_value", poi_label(F.col("name"), F.col("brand"), F.col("category")).alias("label"))
        if POI in kinds:
            parts.append(beside(POI).join(pois, "idx").select("type", "idx", "matched", poi_score(q, matched, alternatives, qualities, known, self.focus, self.viewport).alias("score")))
        return reduce(DataFrame.unionByName, parts).where("score is not null").select("type", "idx", "matched", F.col("score").cast("int").alias("score"))

    def street_place(self, text: str, complete: bool = False, every: bool = False) -> DataFrame:
        """Streets for the splits of a text into street and place, either way round; the best split of each street.
        complete: only areas that are named in full count. The best 4 x limit of all streets; every: all of them."""
        q = Query(text)
        none = self.docs.sparkSession.createDataFrame([], "type byte, idx int, matched int, score int")
        if not q.plain or not 2 <= len(q.ordered) <= 10 or len(q.words) < 2:
            return none
        places = self.places if set(q.words) <= set(self.query.words) else Places(self.data, q.words)
        splits = [(X.tokens_py(" ".join(a)), X.tokens_py(" ".join(b))) for k in range(1, len(q.ordered)) for a, b in ((q.ordered[:k], q.ordered[k:]), (q.ordered[k:], q.ordered[:k]))]
        asked = sorted({a for s, _ in splits for t in s for a in X.alternatives(t)})
        # words of a street's context are its own or of its areas' names
        placed = self._of(ADMIN).where(F.arrays_overlap("name_tokens", lits(asked))).limit(1).count() > 0
        streets = (self.data.postings_context if placed else self.data.postings_primary).where((F.col("type") == STREET) & F.col("token").isin(asked))
        spellings = [(a, t) for t in sorted({t for s, _ in splits for t in s}) for a in X.alternatives(t)]
        spark = streets.sparkSession
        own = streets.join(F.broadcast(spark.createDataFrame(spellings, "token string, q string")), "token").select("idx", "q").distinct()
        own = cut(own)
        size = {r["q"]: r["n"] for r in own.groupBy("q").agg(F.count("*").alias("n")).collect()}
        having = own.groupBy("idx").agg(F.collect_set("q").alias("have"))
        tried = []
        for k, (s, p) in enumerate(splits):
            resolved, named = places.resolve(p)
            anchor = min((size.get(t, 0) for t in s), default=0)
            if not p or not anchor or (complete and not named):
                continue
            rarity = next((b for top, b in ((25, 150), (100, 125), (500, 95), (2000, 65), (10_000, 35)) if anchor <= top), 0)
            tried.append((k, s, resolved, named, rarity, any(map(X.street_like_py, s))))
        if not tried:
            return none
        plans = spark.createDataFrame(tried, "split int, street array<string>, place array<string>, named boolean, rarity int, formed boolean")
        # a row per street and split that fits: at most 18 splits
        rows = having.crossJoin(F.broadcast(plans)).where(F.size(F.array_except("street", "have")) == 0)
        rows = rows.join(self._of(STREET).select("idx", "name_norm", "name_tokens", "admin_tokens", "name_is_place"), "idx")
        rows = rows.withColumn("same", F.size("name_tokens") == F.size("street")).withColumn("in_place", X.matches(F.col("place"), F.col("admin_tokens")))
        if complete:
            rows = rows.where(F.col("same") | F.col("formed")).where(F.col("in_place") == F.size("place"))
        rows = rows.join(self._nearness(rows.select("idx", "split", "place")), ["idx", "split"], "left")
        full = X.matches(lits(q.words), F.col("name_tokens")) + F.col("in_place")
        score = S.street_place(lits(q.words), F.lit(q.norm), F.col("street"), F.col("named"), F.col("rarity"))
        best = rows.select("idx", "split", full.alias("matched"), score.cast("int").alias("score")).groupBy("idx").agg(F.max(F.struct("score", (-F.col("split")).alias("s"), "matched")).alias("b"))
        out = best.select(F.lit(STREET).cast("byte").alias("type"), "idx", F.col("b.matched").alias("matched"), F.col("b.score").alias("score"))
        return out if every else out.orderBy(F.desc("score"), "idx").limit(4 * self.limit)

    def _nearness(self, rows: DataFrame) -> DataFrame:
        """idx, split, near: for streets in an area that is named just so, up to 600 points the nearer its middle."""
        links = rows.distinct().join(self.data.street_admin.select("idx", "area_idx"), "idx")
        names = self._of(ADMIN).select(F.col("idx").alias("area_idx"), F.col("name_tokens").alias("area_tokens"))
        links = links.join(names, "area_idx").where(F.col("area_tokens") == F.col("place"))
        middle = self.data.streets.select("idx", G.middle_vertex(F.col("geometry")).alias("m"))
        centre = self.data.admin_areas.select(F.col("idx").alias("area_idx"), G.truncated_mean_point(F.col("outer")).alias("c"))
        d = G.distance_m(F.col("m.lat_e7"), F.col("m.lon_e7"), F.col("c.lat_e7"), F.col("c.lon_e7"))
        near = F.greatest(F.lit(0), 600 - F.floor(d / 50).cast("int"))
        return links.join(middle, "idx").join(centre, "area_idx").groupBy("idx", "split").agg(F.max(near).alias("near"))

    def semantic_streets(self) -> DataFrame:
        """Streets whose words are the query's, street forms being equal."""
        q, toks = self.query, F.col("name_tokens")
        anchors = [t for t in q.words if not X.street_like_py(t)]
        fits = q.plain and 2 <= len(q.words) <= 5 and bool(anchors)
        having = self.data.postings_primary.where((F.col("type") == STREET) & (F.col("token") == (anchors[0] if fits else ""))).select("idx")
        # cut, or the filter moves before the join and reads the words of all streets
        rows = cut(self._named_streets(having)).where(X.same_street(q.words, toks) if fits else F.lit(False))
        if fits:
            n = posting_counts(self.data.postings_primary.where(F.col("token").isin(anchors))).agg(F.min("n")).first()[0]
            if n is None or n > SEMANTIC_ANCHOR:
                rows = rows.where("false")
        return rows.select("type", "idx", F.lit(len(q.words)).alias("matched"), F.lit(3200).alias("score"))

    def brand_place(self, every: bool = False) -> DataFrame:
        """POIs for the splits of a query into brand and place, the place being an area; the best split of each. The best 4 x limit
        of all POIs; every: all of them."""
        q, none = self.query, self.docs.sparkSession.createDataFrame([], "type byte, idx int, matched int, score int")
        if not q.plain or not 2 <= len(q.ordered) <= 8:
            return none
        parts = []
        for k in range(1, len(q.ordered)):
            for a, b in ((q.ordered[:k], q.ordered[k:]), (q.ordered[k:], q.ordered[:k])):
                brand, place = X.tokens_py(" ".join(a)), X.tokens_py(" ".join(b))
                if self.places.known(place):
                    parts.append((brand, place))
        if not parts:
            return none
        label = X.normalize(poi_label(F.col("name"), F.col("brand"), F.col("category")))
        docs = self._of(POI).select("idx", "name_norm", "brand_norm", "brand_tokens", "admin_tokens").join(self.data.pois.select("idx", label.alias("label"), X.tokens(F.col("name"), F.col("brand"), F.col("category")).alias("own")), "idx")
        found = []
        for brand, place in parts:
            toks = lits(brand)
            in_place = S.best_of(F.array(*map(lits, _word_variants(place))), F.col("admin_tokens"))
            rows, score = docs.where(X.has_all(F.col("own"), toks)), S.brand_place(toks, in_place)
            found.append(rows.select("idx", (len(brand) + in_place).alias("matched"), score.cast("int").alias("score")))
        best = reduce(DataFrame.unionByName, found).groupBy("idx").agg(F.max(F.struct("score", "matched")).alias("b"))
        out = best.select(F.lit(POI).cast("byte").alias("type"), "idx", F.col("b.matched").alias("matched"), F.col("b.score").alias("score"))
        return out if every else out.orderBy(F.desc("score"), "idx").limit(4 * self.limit)

    def alias_streets(self) -> DataFrame:
        """For queries with a place name of two languages: streets that have all other words."""
        q = self.query
        rest = [t for t in q.words if not X.is_place_alias(t)]
        fits = q.plain and 2 <= len(q.words) <= 5 and rest and len(rest) < len(q.words)
        aliases = lits([p for ab in X.PLACE_PAIRS for p in ab])
        rows = self._of(STREET).where(X.has_all(F.col("name_tokens"), lits(rest)) & ~F.arrays_overlap("name_tokens", aliases) if fits else F.lit(False))
        return rows.select("type", "idx", F.lit(len(rest)).alias("matched"), F.lit(620 + 40 * len(rest)).alias("score"))

    def address(self, results: DataFrame) -> DataFrame:
        """Results of a query with one number and two words or more: the house, else its street. Sets resolution."""
        q = self.query
        if len(q.numbers) != 1 or len(q.words) < 2:
            return results
        text = " ".join(t for t in q.ordered if t not in q.numbers and t not in q.postcodes)
        in_area = self.places.any_of(q.words)
        planned, validated = self.street_place(text, True, every=True), self.street_place(text, False, every=True)
        if in_area:
            names = self._of(ADMIN).select(F.col("idx").alias("area_idx"), "name_tokens")
            full = [X.has_all(lits(v), F.col("name_tokens")) for v in _word_variants(Query(text).words)]
            areas = names.where((F.size("name_tokens") > 0) & any_of(full))
            ok = self.data.street_admin.join(areas, "area_idx", "left_semi").select("idx").distinct()
            validated = validated.join(ok, "idx", "left_semi").select(*RESULT)
        # the better of both, of a street that both find
        both = planned.select(*RESULT).unionByName(validated.select(*RESULT)).groupBy("type", "idx").agg(F.max(F.struct("score", "matched")).alias("b"))
        planned = cut(both.select("type", "idx", "b.matched", "b.score"))
        if not planned.limit(1).count():
            if in_area and any(map(X.street_like_py, q.words)):
                self.resolution = "address_not_found"
                return results.where("false")
            return results
        names = planned.join(self._of(STREET), ["type", "idx"]).select(F.col("name_norm").alias("street_norm")).distinct()
        local = self.data.street_admin.join(planned, "idx", "left_semi").select("area_idx").distinct().join(self.data.admin_areas.where("admin_level >= 6").select(F.col("idx").alias("area_idx")), "area_idx", "left_semi")
        local = cut(local)
        houses = results.where(F.col("type") == HOUSE).join(self._of(HOUSE).where(F.col("number_norm") == q.numbers[0]), ["type", "idx"]).join(names, "street_norm", "left_semi")
        if local.limit(1).count():
            houses = houses.join(self.data.house_admin.join(local, "area_idx", "left_semi").select("idx"), "idx", "left_semi")
        houses = cut(houses.select("type", "idx", "matched", (F.col("score") + 10_000).alias("score")))
        self.exact_house = houses.limit(1).count() > 0
        if self.type in (0, HOUSE):
            self.resolution = "exact_house" if self.exact_house else "street_level" if not self.type else "house_not_found"
            return houses if self.exact_house else planned if not self.type else results.where("false")
        if self.type == STREET:
            self.resolution = "street_requested" if self.exact_house else "street_level"
            return planned
        self.resolution = "exact_house_filtered" if self.exact_house else "house_not_found"
        return results.where("false")

    def results(self) -> DataFrame:
        """rank (from 1), type, idx, matched, score, best first."""
        q = self.query
        results = self.address(cut(self.scored()))
        if q.plain and len(q.tokens) >= 2:
            results = merge(results, self.street_place(q.raw, every=True))
            results = merge(results, self.semantic_streets(), best=True)
            results = merge(results, self.brand_place(every=True))
        results = merge(results, self.alias_streets())
        if len(q.words) >= 2:
            results = cut(results)
            streets = self._named_streets(results.where(F.col("type") == STREET).select("idx").distinct())
            aliases = lits([p for ab in X.PLACE_PAIRS for p in ab])
            bad = F.coalesce((len(q.words) > X.matches(lits(q.words), F.col("name_tokens"))) & F.arrays_overlap("name_tokens", aliases), F.lit(False))
            results = results.join(streets, ["type", "idx"], "left").withColumn("score", F.col("score") - S.points(bad, 600)).select(*RESULT)
        return ranked(results, self.limit, self.type)

    def labelled(self) -> DataFrame:
        """results with type_name, label and position in degrees."""
        return label(self.results(), self.data)


def merge(results: DataFrame, more: DataFrame, best: bool = False) -> DataFrame:
    """Union of candidates without repeats: those in results stay as they are, or take the larger score with `best`."""
    r, m = (d.select("type", "idx", F.col("matched").cast("int").alias("matched"), F.col("score").cast("int").alias("score")) for d in (results, more))
    if best:
        return r.unionByName(m).groupBy("type", "idx").agg(F.max("matched").alias("matched"), F.max("score").alias("score"))
    return r.unionByName(m.join(r.select("type", "idx"), ["type", "idx"], "left_anti").select(*RESULT))


def ranked(results: DataFrame, limit: int, type_: int = 0) -> DataFrame:
    """The best by score, type, idx, with rank."""
    rows = results.where(F.col("type") == type_) if type_ else results
    top = rows.orderBy(F.desc("score"), "type", "idx").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "type", "idx"))).select("rank", *RESULT)


def label(results: DataFrame, data: GeoDataset) -> DataFrame:
    mid = lambda p: [p["lat_e7"].alias("lat_e7"), p["lon_e7"].alias("lon_e7")]
    own = [
        data.houses.select(F.lit(HOUSE).alias("type"), "idx", "osm_id", R.house_label(F.col("street"), F.col("house_number")).alias("label"), "lat_e7", "lon_e7"),
        data.streets.select(F.lit(STREET).alias("type"), "idx", "osm_id", R.street_label(F.col("name"), F.col("highway")).alias("label"), *mid(G.middle_vertex(F.col("geometry")))),
        data.admin_areas.select(F.lit(ADMIN).alias("type"), "idx", "osm_id", F.col("name").alias("label"), *mid(G.truncated_mean_point(F.col("outer")))),
        data.pois.select(F.lit(POI).alias("type"), "idx", "osm_id", R.poi_label(F.col("name"), F.col("brand"), F.col("category")).alias("label"), "lat_e7", "lon_e7"),
    ]
    names = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    parts = [F.broadcast(results.where(F.col("type") == k)).join(df.drop("type"), "idx") for k, df in zip((HOUSE, STREET, ADMIN, POI), own, strict=True)]  # at most `limit` results
    out = reduce(DataFrame.unionByName, parts)
    return out.select("rank", "type", names[F.col("type").cast("int")].alias("type_name"), "idx", "osm_id", "label", "matched", "score", G.degrees(F.col("lat_e7")).alias("lat"), G.degrees(F.col("lon_e7")).alias("lon")).orderBy("rank")
