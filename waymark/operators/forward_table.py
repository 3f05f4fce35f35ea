"""Forward geocoding of a table of texts: one plan for all of them, with the answers that Forward gives for each.

Texts are taken apart in columns. Spellings meet the vocabulary in equi-joins (the rarest three letters of a spelling for
substrings, every three letters with a length for near ones), and only pairs that meet are looked at. A text's candidates
start from the token with the fewest postings, as counted before, and are then checked for the other tokens. What is met are the sets
of words asked for that records hold, each set once however many records hold it; a set's records join at the end. The planners for street and place, brand and place, and names of two languages start at their rarest
word in the same way, and refuse a text where even that is too frequent.

Nothing is collected: the answers stay a table, the best of each text found by rank, which drops rows before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import text as X
from waymark.functions.tags import poi_label
from waymark.operators import scores as S
from waymark.operators.forward import BROAD_QUERIES, MULTI_REFS, SEMANTIC_ANCHOR, SINGLE_REFS
from waymark.operators.graph import BROADCAST_ROWS, cut, small
from waymark.plans.index import fuzzy_join, substring_join
from waymark.sources.schema import ADMIN, HOUSE, POI, STREET, GeoDataset, type_number

KEY = ["query_id", "type", "idx"]
RESULT = [*KEY, "matched", "score"]
NOT_ADDRESS = "not_address"


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def splits_of(df: DataFrame) -> DataFrame:
    """df with a row for each split (number) of `ordered` into street and place, either way round; as many as words, twice."""
    part = lambda k, turn: F.struct((2 * (k - 1) + turn).alias("split"), F.slice("ordered", 1, k).alias("a"), F.slice("ordered", k + 1, F.size("ordered")).alias("b"))
    n = F.size("ordered")
    both = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.array(part(k, 0), part(k, 1))))
    rows = df.where(n >= 2).select("*", F.explode(both).alias("s"))
    words = lambda c: F.array_sort(F.array_distinct(c))
    turned = F.col("s.split") % 2 == 1
    return rows.select("*", F.col("s.split").cast("int").alias("split"), words(F.when(turned, F.col("s.b")).otherwise(F.col("s.a"))).alias("street"), words(F.when(turned, F.col("s.a")).otherwise(F.col("s.b"))).alias("place")).drop("s")


@dataclass
class ForwardTable:
    """Texts (query_id, text) against one dataset. query_id is unique; a null text is empty. A text that Forward refuses has an error
    and no rows."""

    data: GeoDataset
    texts: DataFrame
    limit: int = 20
    type_: str | None = None

    def __post_init__(self) -> None:
        if not self.data.indexed:
            raise ValueError("the text index is missing")
        self.limit, self.kind = min(max(self.limit, 1), 100), type_number(self.type_)

    def _of(self, kind: int) -> DataFrame:
        return self.data.search_docs.where(F.col("type") == kind)

    # texts taken apart

    @cached_property
    def parsed(self) -> DataFrame:
        """Every text with its parts and its error, if it has one that the text alone tells."""
        return cut(taken_apart(self.texts))

    @cached_property
    def asked(self) -> DataFrame:
        """The texts that are answered, with `known`: whether the words are the name of an area."""
        rows = self.parsed.where("error is null").join(self.places.select(F.col("place").alias("words"), "exact", F.col("named").alias("_named")), "words", "left")
        lone = (F.size("numbers") > 0) & (F.size("postcodes") == 0) & (F.size("words") == 1) & F.coalesce("exact", F.lit(False))
        known = F.col("plain") & F.size("words").between(1, 3) & F.coalesce("_named", F.lit(False))
        return cut(rows.withColumn("known", known).withColumn("error", F.when(lone, "address query needs a street name")).drop("exact", "_named"))

    @cached_property
    def active(self) -> DataFrame:
        return self.asked.where("error is null")

    @cached_property
    def places(self) -> DataFrame:
        """place (words that may name an area), exact (some area's name has them all), named (they, or their other name, do) and
        resolved (which of them)."""
        ok = self.parsed.where("error is null")
        whole = ok.where(F.size("words") > 0).select(F.col("words").alias("place"))
        each = ok.select(F.explode("words").alias("w")).select(F.array("w").alias("place"))
        plain = self._plain_texts(ok).select("ordered").unionByName(self._address_texts(ok).select("ordered"))
        sets = whole.unionByName(each).unionByName(splits_of(plain).select("place")).distinct()
        tried = sets.select("place", F.posexplode(X.place_variants_of(F.col("place"))).alias("k", "v"))
        areas = self._of(ADMIN).select(F.col("idx").alias("area"), "name_tokens")
        by_word = cut(areas.select(F.explode("name_tokens").alias("token"), "name_tokens").distinct())
        counts = by_word.groupBy("token").agg(F.count("*").alias("n"))
        words = tried.select("*", F.explode("v").alias("token")).join(counts, "token", "left")
        rarest = words.groupBy("place", "k", "v").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.max(F.col("n").isNull()).alias("gap")).where("not gap")
        found = rarest.join(by_word, "token").where(X.has_all(F.col("name_tokens"), F.col("v"))).select("place", "k", "v").distinct()
        found = found.groupBy("place").agg(F.min("k").alias("k"), F.min_by("v", "k").alias("resolved"))
        out = sets.join(found, "place", "left")
        return cut(out.select("place", F.coalesce(F.col("k") == 0, F.lit(False)).alias("exact"), F.col("k").isNotNull().alias("named"), F.coalesce("resolved", "place").alias("resolved")))

    @staticmethod
    def _plain_texts(rows: DataFrame) -> DataFrame:
        """Texts that are split into street (or brand) and place."""
        return rows.where(F.col("plain") & F.size("ordered").between(2, 10))

    @staticmethod
    def _address_texts(rows: DataFrame) -> DataFrame:
        """Texts with one number and two words or more, without their numbers and postcodes."""
        rest = F.filter("ordered", lambda t: ~t.rlike("[0-9]"))
        rows = rows.where((F.size("numbers") == 1) & (F.size("words") >= 2)).withColumn("ordered", rest)
        return rows.withColumn("norm", F.array_join("ordered", " ")).where(F.size("ordered").between(2, 10))

    # candidates that have every token

    @cached_property
    def postings(self) -> DataFrame:
        """Both kinds of postings, `plain` telling which texts they are for; those of plain texts only, if all are."""
        primary, context = (p.select(F.lit(k).alias("plain"), "token", "type", "idx") for k, p in ((True, self.data.postings_primary), (False, self.data.postings_context)))
        return primary.unionByName(context) if self.active.where("not plain").limit(1).count() else primary

    def counts(self, tokens: DataFrame) -> DataFrame:
        """plain, token, n: postings of tokens."""
        return self.postings.join(small(cut(tokens.select("token").distinct())), "token", "left_semi").groupBy("plain", "token").agg(F.count("*").alias("n"))

    @cached_property
    def plan(self) -> DataFrame:
        """query_id, q, token, n: for each token q of a text what stands for it, with its postings."""
        q = self.active.select("query_id", "plain", (F.size("tokens") == 1).alias("single"), F.explode("tokens").alias("q"))
        spelled = cut(q.select("*", F.explode(X.alternatives_of(F.col("q"))).alias("token")))
        have = cut(spelled.join(self.counts(spelled), ["plain", "token"], "left"))
        own = F.max(F.when((F.col("token") == F.col("q")) & F.col("n").isNotNull(), True)).over(Window.partitionBy("query_id", "q"))
        have = have.withColumn("spread", F.col("single") | own.isNull())
        # a token without postings, or the only one, is expanded in all spellings; of others, those spellings without postings
        wanted = have.where(F.col("spread") | ((F.col("token") != F.col("q")) & F.col("n").isNull())).withColumnRenamed("token", "spelling").drop("n")
        wanted = cut(wanted)
        spellings = cut(wanted.select(F.col("spelling").alias("token")).distinct())
        hits = cut(substring_join(self.data.vocabulary, spellings, 96).withColumn("fuzzy", F.lit(False)).unionByName(fuzzy_join(self.data.vocabulary, spellings, 24).withColumn("fuzzy", F.lit(True))))
        found = wanted.join(hits.withColumnRenamed("token", "spelling").withColumnRenamed("found", "token"), "spelling")
        found = found.where(F.col("rank") <= F.when(F.col("spread"), F.when(F.col("fuzzy"), 24).otherwise(96)).otherwise(F.when(F.col("fuzzy"), 12).otherwise(64)))
        more = self.counts(hits.select(F.col("found").alias("token")))
        found = found.select("query_id", "plain", "single", "spread", "q", "token").distinct().join(more, ["plain", "token"])
        bound = F.when(F.col("single"), SINGLE_REFS).otherwise(MULTI_REFS)
        new = found.where(~F.col("spread") | (~F.array_contains(X.alternatives_of(F.col("q")), F.col("token")) & (F.col("n") <= bound)))
        rows = have.where("n is not null").select("query_id", "plain", "q", "token", "n").unionByName(new.select("query_id", "plain", "q", "token", "n")).distinct()
        whole = rows.groupBy("query_id").agg(F.count_distinct("q").alias("k")).join(self.active.select("query_id", F.size("tokens").alias("n_tokens")), "query_id").where("k = n_tokens")
        return cut(rows.join(whole.select("query_id", "n_tokens"), "query_id"))

    @cached_property
    def candidates(self) -> DataFrame:
        """query_id, type, idx of records that have for every token of the text one of what stands for it."""
        size = self.plan.groupBy("query_id", "q").agg(F.sum("n").alias("n"))
        anchor = first_by(size, ["query_id"], F.asc("n"), F.asc("q")).select("query_id", "q", F.lit(True).alias("anchor"))
        plan = cut(self.plan.join(anchor, ["query_id", "q"], "left"))
        # records that hold the same of the words asked for are met as one; a text starts from the fewest of them
        asked = small(cut(plan.select("plain", "token").distinct()))
        held = self.postings.join(asked, ["plain", "token"], "left_semi").groupBy("plain", "type", "idx").agg(F.array_sort(F.collect_set("token")).alias("held"))
        held = cut(held.withColumn("has", F.xxhash64("held")))
        sets = cut(held.select("plain", "has", "held").distinct())
        words = sets.select("plain", "has", "held", F.explode("held").alias("token"))
        start = words.join(small(cut(plan.where("anchor").select("query_id", "plain", "n_tokens", "token"))), ["plain", "token"]).select("query_id", "plain", "n_tokens", "has", "held").distinct()
        rest = small(cut(plan.where("anchor is null").select("query_id", "token", "q")))
        checked = start.where("n_tokens > 1").select("*", F.explode("held").alias("token")).join(rest, ["query_id", "token"])
        checked = checked.groupBy("query_id", "plain", "n_tokens", "has", "held").agg(F.count_distinct("q").alias("k")).where("k = n_tokens - 1")
        met = start.where("n_tokens = 1").select("query_id", "plain", "has", "held").unionByName(checked.select("query_id", "plain", "has", "held"))
        return cut(held.join(small(cut(met)), ["plain", "has", "held"]).select(*KEY))

    @cached_property
    def scored(self) -> DataFrame:
        single = self.plan.where("n_tokens = 1").groupBy("query_id", "q").agg(F.collect_set("token").alias("stands"))
        single = single.select("query_id", F.array_distinct(F.concat("stands", X.alternatives_of(F.col("q")))).alias("alternatives"))
        none = S.lits([])
        q = self.active.join(single, "query_id", "left").select(
            "query_id", "numbers", "postcodes", "words", F.size("tokens").alias("n_tokens"), "norm", "known", F.coalesce("alternatives", none).alias("alternatives"),
            F.when(F.size("words") == 1, X.alternatives_of(F.get("words", F.lit(0)))).otherwise(none).alias("qualities"), X.word_variants_of(F.col("words")).alias("variants"))
        q = small(cut(q.select("query_id", F.struct(*[c for c in q.columns if c != "query_id"]).alias("a"))))
        part = lambda c: F.col("a")[c]
        a = S.Asked(*(part(c) for c in ("numbers", "postcodes", "words", "n_tokens", "norm", "alternatives", "qualities", "variants", "known")))
        matched = a.n_tokens
        areas = self.data.admin_areas.select("idx", "admin_level", "min_lat", "max_lat", "min_lon", "max_lon")
        pois = self.data.pois.select("idx", "lat_e7", "lon_e7", "name", "brand", "category", "tag_key", "tag_value", poi_label(F.col("name"), F.col("brand"), F.col("category")).alias("label"))
        more = {HOUSE: None, STREET: None, ADMIN: areas, POI: pois}
        score = {HOUSE: S.house(a, matched), STREET: S.street(a, matched), ADMIN: S.admin(a, matched), POI: S.poi(a, matched)}
        parts = []
        for kind, extra in more.items():
            docs = self._of(kind) if extra is None else self._of(kind).join(extra, "idx")
            rows = self.candidates.where(F.col("type") == kind).join(docs.drop("type"), "idx").join(q, "query_id")
            parts.append(rows.select(*KEY, matched.alias("matched"), score[kind].cast("int").alias("score")))
        return cut(reduce(DataFrame.unionByName, parts).where("score is not null"))

    # planners

    def _street_splits(self, texts: DataFrame) -> DataFrame:
        """query_id, idx, split, score, matched, full, bad: every street that has all street words of a split of texts (query_id,
        ordered, norm, words) into street and place; full: the split's area is named in full and holds the street; bad: see _bad."""
        texts = cut(texts.where(F.size("words") >= 2))
        splits = cut(splits_of(texts.select("query_id", "ordered")).join(self.places, "place").drop("ordered"))
        own = splits.select(F.explode("street").alias("q")).distinct().select("q", F.explode(X.alternatives_of(F.col("q"))).alias("token"))
        postings = self.data.postings_context.where(F.col("type") == STREET)
        # streets that have the same of the words asked for meet the splits as one
        held = cut(postings.join(small(cut(own)), "token").groupBy("idx").agg(F.array_sort(F.collect_set("q")).alias("held")))
        sets = cut(held.groupBy("held").agg(F.count("*").alias("n")))
        size = sets.select(F.explode("held").alias("q"), "n").groupBy("q").agg(F.sum("n").alias("n"))
        tokens = splits.select("query_id", "split", F.explode("street").alias("q")).join(small(cut(size)), "q", "left")
        anchor = tokens.groupBy("query_id", "split").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by("q", F.struct("n", "q")).alias("q"))
        tried = splits.join(anchor.where(F.col("n") > 0), ["query_id", "split"]).where(F.size("place") > 0)
        rarity = F.when(F.col("n") <= 25, 150).when(F.col("n") <= 100, 125).when(F.col("n") <= 500, 95).when(F.col("n") <= 2000, 65).when(F.col("n") <= 10_000, 35).otherwise(0)
        tried = cut(tried.select("query_id", "split", "street", F.col("resolved").alias("place"), "named", "q", rarity.alias("rarity"), F.exists("street", X.street_like).alias("formed")))
        met = sets.select("held", F.explode("held").alias("q")).join(small(tried), "q").where(X.has_all(F.col("held"), F.col("street"))).drop("q")
        met = small(cut(met.join(small(texts.select("query_id", "words", "norm")), "query_id")))
        places = small(cut(met.select("held", "place").distinct()))
        rows = small(cut(held.join(small(cut(met.select("held").distinct())), "held", "left_semi")))
        near = self._nearness(rows.join(places, "held").select("idx", "place"))
        rows = rows.join(self._of(STREET).select("idx", "name_norm", "name_tokens", "admin_tokens", "name_is_place"), "idx").join(near, "idx", "left").join(met, "held")
        rows = rows.withColumn("same", F.size("name_tokens") == F.size("street")).withColumn("in_place", X.matches(F.col("place"), F.col("admin_tokens")))
        rows = rows.withColumn("near", F.array_max(F.transform(F.filter("nears", lambda x: x["place"] == F.col("place")), lambda x: x["near"])))
        score = S.street_place(F.col("words"), F.col("norm"), F.col("street"), F.col("named"), F.col("rarity"))
        full = F.col("named") & (F.col("same") | F.col("formed")) & (F.col("in_place") == F.size("place"))
        return rows.select("query_id", "idx", "split", score.cast("int").alias("score"), (X.matches(F.col("words"), F.col("name_tokens")) + F.col("in_place")).alias("matched"), full.alias("full"), self._bad().alias("bad"))

    @staticmethod
    def _bad() -> Column:
        """Whether a street (name_tokens) lacks some of several words and has a place name of two languages."""
        return F.coalesce((F.size("words") >= 2) & (F.size("words") > X.matches(F.col("words"), F.col("name_tokens"))) & F.arrays_overlap("name_tokens", S.lits(X.PLACE_NAMES)), F.lit(False))

    def street_place(self, texts: DataFrame, complete: bool = False, every: bool = False) -> DataFrame:
        """Streets for the splits of texts (query_id, ordered, norm, words) into street and place; the best split of each street.
        complete: only areas that are named in full count. The best 4 x limit of all streets of a text; every: all of them."""
        rows = self._street_splits(texts)
        rows = rows.where("full") if complete else rows
        best = rows.groupBy("query_id", "idx").agg(F.max(F.struct("score", (-F.col("split")).alias("s"), "matched")).alias("b"))
        out = best.select("query_id", F.lit(STREET).cast("byte").alias("type"), "idx", F.col("b.matched").alias("matched"), F.col("b.score").alias("score"))
        return out if every else top_by(out, ["query_id"], 4 * self.limit, F.desc("score"), F.asc("idx"))

    def _nearness(self, rows: DataFrame) -> DataFrame:
        """idx, nears (place, near): for streets (idx, place) in an area that is named just so, up to 600 points the nearer its middle."""
        places = small(cut(rows.select("place").distinct()))
        centre = self.data.admin_areas.select(F.col("idx").alias("area_idx"), G.truncated_mean_point(F.col("outer")).alias("c"))
        areas = self._of(ADMIN).select(F.col("idx").alias("area_idx"), F.col("name_tokens").alias("place")).join(places, "place", "left_semi").join(centre, "area_idx")
        links = self.data.street_admin.select("idx", "area_idx").join(small(cut(areas)), "area_idx")
        if rows.count() <= BROADCAST_ROWS:  # of more, those that aren't asked for are few beside them
            links = links.join(F.broadcast(rows), ["idx", "place"], "left_semi")
        middle = self.data.streets.select("idx", G.middle_vertex(F.col("geometry")).alias("m"))
        d = G.distance_m(F.col("m.lat_e7"), F.col("m.lon_e7"), F.col("c.lat_e7"), F.col("c.lon_e7"))
        near = F.greatest(F.lit(0), 600 - F.floor(d / 50).cast("int"))
        return links.join(middle, "idx").groupBy("idx").agg(F.collect_list(F.struct("place", near.alias("near"))).alias("nears"))

    def _rarest(self, rows: DataFrame, words: str, kind: int) -> DataFrame:
        """rows with `token`, that of their words with the fewest primary postings of a kind; rows of which a word has none go."""
        each = rows.select("_row", F.explode(words).alias("token"))
        n = self.data.postings_primary.where(F.col("type") == kind).join(small(cut(each.select("token").distinct())), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
        least = each.join(small(cut(n)), "token", "left").groupBy("_row").agg(F.min_by("token", F.struct("n", "token")).alias("token"), F.max(F.col("n").isNull()).alias("gap")).where("not gap")
        return rows.join(least.select("_row", "token"), "_row")

    def semantic_streets(self) -> DataFrame:
        """Streets whose words are the text's, street forms being equal."""
        anchors = F.filter("words", lambda w: ~X.street_like(w))
        fits = self.active.where(F.col("plain") & F.size("words").between(2, 5)).select("query_id", "words", anchors.alias("anchors")).where(F.size("anchors") > 0)
        each = fits.select("query_id", F.explode("anchors").alias("token"))
        n = self.data.postings_primary.join(small(cut(each.select("token").distinct())), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
        ok = each.join(small(cut(n)), "token").groupBy("query_id").agg(F.min("n").alias("n")).where(F.col("n") <= SEMANTIC_ANCHOR).select("query_id")
        start = cut(fits.join(ok, "query_id").select("query_id", "words", F.col("anchors")[0].alias("token")))
        streets = self.data.postings_primary.where(F.col("type") == STREET).join(small(start), "token").join(self._of(STREET).select("idx", "name_tokens"), "idx").where(X.same_street_as(F.col("words"), F.col("name_tokens")))
        return streets.select("query_id", F.lit(STREET).cast("byte").alias("type"), "idx", F.size("words").alias("matched"), F.lit(3200).alias("score"))

    def brand_place(self, every: bool = False) -> DataFrame:
        """POIs for the splits of a text into brand and place, the place being an area; the best split of each. The best 4 x limit of
        all POIs of a text; every: all of them."""
        texts = self.active.where(F.col("plain") & F.size("ordered").between(2, 8)).select("query_id", "ordered")
        splits = splits_of(texts).join(self.places.where("named"), "place").select("query_id", F.col("street").alias("brand"), "place")
        splits = cut(splits.where(F.size("brand") > 0).distinct().withColumn("_row", F.xxhash64("query_id", "brand", "place")))
        start = small(cut(self._rarest(splits, "brand", POI)))
        docs = self._of(POI).select("idx", "name_norm", "brand_norm", "brand_tokens", "admin_tokens").join(self.data.pois.select("idx", X.normalize(poi_label(F.col("name"), F.col("brand"), F.col("category"))).alias("label"), X.tokens(F.col("name"), F.col("brand"), F.col("category")).alias("own")), "idx")
        rows = self.data.postings_primary.where(F.col("type") == POI).join(start, "token").join(docs, "idx").where(X.has_all(F.col("own"), F.col("brand")))
        in_place = S.best_of(X.word_variants_of(F.col("place")), F.col("admin_tokens"))
        rows = rows.withColumn("in_place", in_place)
        score = S.brand_place(F.col("brand"), F.col("in_place"))
        best = rows.groupBy("query_id", "idx").agg(F.max(F.struct(score.cast("int").alias("score"), (F.size("brand") + F.col("in_place")).alias("matched"))).alias("b"))
        out = best.select("query_id", F.lit(POI).cast("byte").alias("type"), "idx", F.col("b.matched").alias("matched"), F.col("b.score").alias("score"))
        return out if every else top_by(out, ["query_id"], 4 * self.limit, F.desc("score"), F.asc("idx"))

    def alias_streets(self) -> DataFrame:
        """For texts with a place name of two languages: streets that have all other words."""
        rest = F.filter("words", lambda w: ~w.isin(*X.PLACE_NAMES))
        fits = self.active.where(F.col("plain") & F.size("words").between(2, 5)).select("query_id", F.col("query_id").alias("_row"), F.size("words").alias("n"), rest.alias("rest")).where((F.size("rest") > 0) & (F.size("rest") < F.col("n")))
        start = small(cut(self._rarest(fits, "rest", STREET)))
        rows = self.data.postings_primary.where(F.col("type") == STREET).join(start, "token").join(self._of(STREET).select("idx", "name_tokens"), "idx")
        rows = rows.where(X.has_all(F.col("name_tokens"), F.col("rest")) & ~F.arrays_overlap("name_tokens", S.lits(X.PLACE_NAMES)))
        return rows.select("query_id", F.lit(STREET).cast("byte").alias("type"), "idx", F.size("rest").alias("matched"), (620 + 40 * F.size("rest")).alias("score"))

    @cached_property
    def addresses(self) -> tuple[DataFrame, DataFrame]:
        """(rows, resolutions) of the texts with one number and two words or more: the house, else its street."""
        texts = cut(self.active.where((F.size("numbers") == 1) & (F.size("words") >= 2)))
        named = self.places.where(F.col("named") & (F.size("place") == 1)).select(F.col("place")[0].alias("w"))
        each = texts.select("query_id", F.explode("words").alias("w"))
        in_area = each.where(F.col("w").isin(*X.PLACE_NAMES)).select("query_id").unionByName(each.join(named, "w", "left_semi").select("query_id")).distinct().withColumn("in_area", F.lit(True))
        texts = cut(texts.join(in_area, "query_id", "left").withColumn("in_area", F.coalesce("in_area", F.lit(False))))
        # texts that differ in their number only ask for the same streets, as `ask`, which has all their words
        parts = cut(self._address_texts(texts).withColumnRenamed("norm", "ask"))
        of, asks = parts.select("query_id", "ask"), cut(parts.select("ask", "ordered", "words", "in_area").distinct())
        best_if = lambda c: F.max(F.when(c, F.struct("score", (-F.col("split")).alias("s"), "matched", "bad")))
        streets = self._street_splits(asks.select(F.col("ask").alias("query_id"), "ordered", "words", F.col("ask").alias("norm")))
        streets = streets.groupBy(F.col("query_id").alias("ask"), "idx").agg(best_if(F.col("full")).alias("full"), best_if(F.lit(True)).alias("some"))
        # areas whose whole name is among the words, found by the name's first word
        tried = asks.where("in_area").select("ask", F.explode(X.word_variants_of(F.col("words"))).alias("v")).select("ask", "v", F.explode("v").alias("first"))
        areas = self._of(ADMIN).where(F.size("name_tokens") > 0).select(F.col("idx").alias("area_idx"), "name_tokens", F.col("name_tokens")[0].alias("first"))
        inside = small(cut(tried.join(areas, "first").where(X.has_all(F.col("v"), F.col("name_tokens"))).groupBy("area_idx").agg(F.collect_set("ask").alias("asks"))))
        # from the streets found to their areas, as an area holds streets without number
        held = self.data.street_admin.select("idx", "area_idx").join(inside, "area_idx").groupBy("idx").agg(F.array_distinct(F.flatten(F.collect_list("asks"))).alias("asks"))
        streets = streets.join(small(asks.select("ask", "in_area")), "ask").join(held, "idx", "left")
        valid = ~F.col("in_area") | F.coalesce(F.array_contains("asks", F.col("ask")), F.lit(False))
        planned = cut(streets.where(valid | F.col("full").isNotNull()).select("ask", "idx", F.when(valid, F.col("some")).otherwise(F.col("full")).alias("b")).select("ask", F.lit(STREET).cast("byte").alias("type"), "idx", "b.matched", "b.score", "b.bad"))
        have = of.join(planned.select("ask").distinct(), "ask", "left_semi").select("query_id").withColumn("planned", F.lit(True))
        mine = self.scored.where(F.col("type") == HOUSE).join(texts.select("query_id", F.col("numbers")[0].alias("number")), "query_id").join(of, "query_id")
        mine = cut(mine.join(self._of(HOUSE).select("idx", "number_norm", "street_norm"), "idx").where("number_norm = number"))
        asking = planned.join(small(cut(mine.select("ask").distinct())), "ask", "left_semi")
        names = asking.join(self._of(STREET).select("idx", F.col("name_norm").alias("street_norm")), "idx").select("ask", "street_norm").distinct()
        houses = cut(mine.join(names, ["ask", "street_norm"], "left_semi"))
        deep = self.data.admin_areas.where("admin_level >= 6").select(F.col("idx").alias("area_idx"))
        asking = planned.join(small(cut(houses.select("ask").distinct())), "ask", "left_semi")
        local = cut(asking.select("ask", "idx").join(self.data.street_admin.select("idx", "area_idx"), "idx").join(deep, "area_idx", "left_semi").select("ask", "area_idx").distinct())
        some = local.select("ask").distinct()
        near = houses.select("query_id", "ask", "idx").join(self.data.house_admin.select("idx", "area_idx"), "idx").join(local, ["ask", "area_idx"], "left_semi").select("query_id", "idx").distinct()
        houses = cut(houses.join(some, "ask", "left_anti").select(*RESULT).unionByName(houses.join(some, "ask", "left_semi").join(near, ["query_id", "idx"], "left_semi").select(*RESULT)).withColumn("score", F.col("score") + 10_000))
        # in the order of results, which nothing else meets for these texts
        planned = small(cut(top_by(planned, ["ask"], self.limit, F.desc(F.col("score") - S.points(F.col("bad"), 600)), F.asc("idx")))).join(of, "ask").select(*RESULT)
        exact = houses.select("query_id").distinct().withColumn("exact", F.lit(True))
        state = texts.join(have, "query_id", "left").join(exact, "query_id", "left")
        yes = lambda c: F.coalesce(c, F.lit(False))
        lost = F.col("in_area") & F.exists("words", X.street_like)
        if self.kind in (0, HOUSE):
            then = F.when(yes("exact"), "exact_house").otherwise("house_not_found" if self.kind else "street_level")
        elif self.kind == STREET:
            then = F.when(yes("exact"), "street_requested").otherwise("street_level")
        else:
            then = F.when(yes("exact"), "exact_house_filtered").otherwise("house_not_found")
        state = cut(state.select("query_id", F.when(yes("planned"), then).when(lost, "address_not_found").otherwise(NOT_ADDRESS).alias("resolution"), yes("planned").alias("planned"), yes("exact").alias("exact")))
        took = {0: ("exact", "planned and not exact"), HOUSE: ("exact", "false"), STREET: ("false", "planned")}.get(self.kind, ("false", "false"))
        as_found = state.where((F.col("resolution") == NOT_ADDRESS) & ~F.col("planned")).select("query_id")
        rows = [houses.join(state.where(took[0]), "query_id", "left_semi"), planned.join(state.where(took[1]), "query_id", "left_semi"), self.scored.join(as_found, "query_id", "left_semi")]
        return cut(reduce(DataFrame.unionByName, [r.select(*RESULT) for r in rows])), state.select("query_id", "resolution")

    def results(self) -> DataFrame:
        """query_id, rank (from 1), type, idx, matched, score: the best of each text, best first."""
        rows, of = self.addresses
        first = self.scored.join(of, "query_id", "left_anti").select(*RESULT).unionByName(rows)
        several = self.active.where(F.size("tokens") >= 2)
        parts = [first, self.street_place(self._plain_texts(several).select("query_id", "ordered", "words", "norm"), every=True), self.semantic_streets(), self.brand_place(every=True), self.alias_streets()]
        every = reduce(DataFrame.unionByName, [p.select(*RESULT, F.lit(k).alias("step")) for k, p in enumerate(parts)])
        # a record stays as the earlier step has it, but takes the larger score of a street with just the text's words
        of_step = lambda k: F.max(F.when(F.col("step") == k, F.struct("matched", "score")))
        met = every.groupBy(*KEY).agg(*[of_step(k).alias(f"s{k}") for k in range(5)])
        base = F.coalesce("s0", "s1")
        best = lambda c: F.greatest(base[c], F.col("s2")[c])
        kept = F.when(base.isNotNull() | F.col("s2").isNotNull(), F.struct(best("matched").alias("matched"), best("score").alias("score"))).otherwise(F.coalesce("s3", "s4"))
        met = met.select(*KEY, kept.alias("k")).select(*KEY, "k.matched", "k.score")
        met = met.where(F.col("type") == self.kind) if self.kind else met
        met = met.join(small(cut(self.active.select("query_id", "words"))), "query_id").join(self._of(STREET).select("type", "idx", "name_tokens"), ["type", "idx"], "left")
        met = met.select(*KEY, "matched", (F.col("score") - S.points(self._bad(), 600)).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "type", "idx"))
        return met.withColumn("rank", rank).where(F.col("rank") <= self.limit).select("query_id", "rank", "type", "idx", "matched", "score")

    def answers(self) -> DataFrame:
        """query_id, error, resolution of every text."""
        _, of = self.addresses
        errors = self.parsed.where("error is not null").select("query_id", "error").unionByName(self.asked.where("error is not null").select("query_id", "error"))
        rows = self.parsed.select("query_id").join(errors, "query_id", "left").join(of, "query_id", "left")
        return rows.select("query_id", "error", F.when(F.col("error").isNull(), F.coalesce("resolution", F.lit(NOT_ADDRESS))).alias("resolution"))


def raw_negative(raw: Column) -> Column:
    """Whether a text has a number after a minus sign at its start or after white space, a comma or a semicolon."""
    return raw.rlike("(?U)(^|[\\s\\x{1c}-\\x{1f},;])-[0-9]")


def taken_apart(texts: DataFrame) -> DataFrame:
    """Texts (query_id, text) with their parts, and the error of those that are refused for their text alone."""
    raw = F.coalesce("text", F.lit(""))
    rows = texts.select("query_id", raw.alias("raw"), X.normalize(raw).alias("norm"), X.ordered_tokens(raw).alias("ordered"))
    rows = rows.withColumn("tokens", F.array_sort(F.array_distinct("ordered")))
    rows = rows.withColumns({"postcodes": X.postcodes(F.col("tokens")), "numbers": X.numbers(F.col("tokens")), "words": X.words(F.col("tokens"))})
    rows = rows.withColumn("plain", (F.size("numbers") == 0) & (F.size("postcodes") == 0))
    error = F.when(F.col("norm") == "", "missing q parameter").when(raw_negative(F.col("raw")), "negative house numbers are invalid")
    error = error.when(F.col("plain") & (F.size("words") == 1) & F.get("words", F.lit(0)).isin(*BROAD_QUERIES), "query is too broad")
    return rows.withColumn("error", error)


def geocode_all(data: GeoDataset, texts: DataFrame, limit: int = 20, type_: str | None = None) -> DataFrame:
    """The answers to all texts (query_id, text): query_id, rank, type, idx, matched, score."""
    return ForwardTable(data, texts, limit, type_).results()
