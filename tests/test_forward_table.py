"""Geocoding a table of texts against geocoding one by one, and the joins with the vocabulary against their single forms."""

import os
import random

import pytest
from pyspark.sql import functions as F

from waymark.operators.forward import Forward, QueryError
from waymark.operators.forward_table import ForwardTable, geocode_all
from waymark.operators.graph import cut
from waymark.plans.index import add_index, add_words, fuzzy_expansions, fuzzy_join, substring_expansions, substring_join
from waymark.sources.schema import BUILT, GeoDataset

BOX = (470000000, 480000000, 90000000, 100000000)
AREAS = [(0, "Bayern", 4), (1, "München", 6), (2, "Wien", 6), (3, "Sankt Anton", 8), (4, "Anton", 8), (5, "Bad Wien", 8), (6, "Weinberg", 9)]
STREETS = ["Hauptstraße", "Wiener Straße", "Antonweg", "München Straße", "Hauptstr.", "Am Anton", "Weinberg", "Rosengasse", "Vienna Road", "Lange Straße", "Hauptstraße", "Bad Wien Weg"]
HOUSES = [("Hauptstraße", "7", "80331", "München"), ("Hauptstraße", "7a", "80331", "München"), ("Wiener Straße", "12", "1010", "Wien"), ("Antonweg", "7", "", "Anton"), ("Hauptstraße", "7", "1010", "Wien"), ("", "3", "", "")]
POIS = [("Café Anton", "cafe", "amenity", "cafe", ""), ("", "shop", "shop", "bakery", "Müller"), ("Müller München", "shop", "shop", "chemist", "Müller"), ("Parkhaus", "parking", "amenity", "parking", ""), ("Weinstube Wien", "restaurant", "amenity", "restaurant", "Wein"), ("Hauptpost", "post", "amenity", "post_office", "")]
TEXTS = ["Hauptstraße München", "munchen", "Müller München", "Hauptstr. 7 München", "Hauptstraße 99 Anton", "Weinbrg", "7 anton", "Lange Straße Vienna", "strasse anton am", ""]
#: Compared too where SLOW_TESTS is set; one by one, each takes some seconds.
MORE = ["Vienna", "Straße Hauptstrasse 80331 7", "Sankt Anton Weinberg", "Bad Wien Weg", "Cafe Anton", "anton", "muller vienna", "Wiener Str. 12", "rosengase", "80331", "nirgends nichts", "weg", "-5 Weg", "Hauptstr 7 Vienna", "Wein Wien", "bayern hauptpost", "haupt", "Parkhaus", "Antonweg 7 Sankt Anton", "wien 12 wiener strasse"]
ALL = [(TEXTS, 20, None), (TEXTS[3:4], 5, "house"), (TEXTS[3:4], 5, "street"), *[(MORE, 20, None)] * bool(os.environ.get("SLOW_TESTS"))]


def point(k):
    return {"lat_e7": 470000000 + k * 1000, "lon_e7": 90000000 + k * 700}


@pytest.fixture(scope="module")
def town(spark):
    rng = random.Random(1)
    table = lambda name, rows: spark.createDataFrame(rows, BUILT[name])
    links = lambda n: [(i, o, a) for i in range(n) for o, a in enumerate(sorted(rng.sample(range(len(AREAS)), rng.randint(1, 3))))]
    data = GeoDataset({
        "houses": table("houses", [(i, i, *point(i).values(), number, street, code, city, "", 1) for i, (street, number, code, city) in enumerate(HOUSES)]),
        "streets": table("streets", [(i, i, name, "residential", [point(i), point(i + 5), point(i + 9)], *BOX) for i, name in enumerate(STREETS)]),
        "admin_areas": table("admin_areas", [(i, i, name, level, 3, [point(i), point(i + 50), point(i + 90), point(i)], *BOX) for i, name, level in AREAS]),
        "pois": table("pois", [(i, i, *point(i).values(), name, category, key, value, brand, 1) for i, (name, category, key, value, brand) in enumerate(POIS)]),
        "house_admin": table("house_admin", links(len(HOUSES))), "street_admin": table("street_admin", links(len(STREETS))),
        "poi_admin": table("poi_admin", links(len(POIS))), "admin_parent": table("admin_parent", [(1, 0, 0), (3, 0, 0), (4, 0, 0)]),
    })
    found = add_index(GeoDataset({n: cut(t) for n, t in data.tables.items()}))
    return found


def one_by_one(town, texts, limit, type_):
    rows, answers = {}, {}
    for i, text in enumerate(texts):
        try:
            asked = Forward(town, text, limit, type_)
            rows[i] = [tuple(r) for r in asked.results().orderBy("rank").collect()]
            answers[i] = (None, asked.resolution)
        except QueryError as e:
            rows[i], answers[i] = [], (str(e), None)
    return rows, answers


def together(spark, town, texts, limit, type_):
    asked = ForwardTable(town, spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), limit, type_)
    rows = {i: [] for i in range(len(texts))}
    for r in asked.results().orderBy("query_id", "rank").collect():
        rows[r["query_id"]].append(tuple(r)[1:])
    return rows, {r["query_id"]: (r["error"], r["resolution"]) for r in asked.answers().collect()}


@pytest.mark.parametrize("texts,limit,type_", ALL)
def test_a_table_of_texts_and_one_by_one(spark, town, texts, limit, type_):
    want, said = one_by_one(town, texts, limit, type_)
    got, told = together(spark, town, texts, limit, type_)
    for i, text in enumerate(texts):
        assert got[i] == want[i], text
        assert told[i] == said[i], text
    assert type_ or sum(map(bool, got.values())) > 6


def test_no_texts(spark, town):
    none = spark.createDataFrame([], "query_id long, text string")
    assert geocode_all(town, none).count() == 0
    null = spark.createDataFrame([(1, None), (2, "!!")], "query_id long, text string")
    asked = ForwardTable(town, null)
    assert asked.results().count() == 0
    assert {r["error"] for r in asked.answers().collect()} == {"missing q parameter"}


def test_joins_with_the_vocabulary(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))
    vocab = cut(spark.createDataFrame([(w,) for w in {word() for _ in range(250)}], "token string"))
    wanted = sorted({word() for _ in range(14)} | {"ab", "abc", "a"})
    table = spark.createDataFrame([(w,) for w in wanted], "token string")
    for join, single, most in ((substring_join, substring_expansions, 7), (fuzzy_join, fuzzy_expansions, 7)):
        got = {w: [] for w in wanted}
        for r in join(vocab, table, most).orderBy("token", "rank").collect():
            got[r["token"]].append(r["found"])
        assert got == {w: [r["token"] for r in single(vocab, w, most).collect()] for w in wanted}
        assert join(vocab, table).count() >= sum(map(len, got.values())) > 20
        assert join(vocab.limit(0), table).count() == join(vocab, table.where(F.lit(False))).count() == 0


def test_a_word_of_more_than_250000_streets_is_planned(spark):
    """The SQL of fg6 and fg10 has no bound on a word's streets."""
    way = spark.range(250_001).select(F.col("id").cast("int").alias("idx"))
    point, words = F.struct(F.lit(470000000).alias("lat_e7"), F.lit(90000000).alias("lon_e7")), lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    inside = F.when(F.col("idx") % 50 == 7, words("bayern")).otherwise(words())
    streets = way.select(F.lit(2).cast("byte").alias("type"), "idx", F.lit("weg").alias("name_norm"), words("weg").alias("name_tokens"), inside.alias("admin_tokens"), F.lit(False).alias("name_is_place"))
    area = spark.range(1).select(F.lit(3).cast("byte").alias("type"), F.lit(0).alias("idx"), F.lit("bayern").alias("name_norm"), words("bayern").alias("name_tokens"), words().alias("admin_tokens"), F.lit(False).alias("name_is_place"))
    postings = way.select(F.lit("weg").alias("token"), F.lit(2).cast("byte").alias("type"), "idx")
    data = GeoDataset({
        "search_docs": streets.unionByName(area), "postings_context": postings, "postings_primary": postings,
        "street_admin": way.where("idx % 50 = 7").select("idx", F.lit(0).alias("ord"), F.lit(0).alias("area_idx")),
        "streets": way.select("idx", F.array(point, point).alias("geometry")), "admin_areas": spark.range(1).select(F.lit(0).alias("idx"), F.array(point, point).alias("outer")),
    })
    asked = ForwardTable(data, spark.createDataFrame([("a", "Weg Bayern")], "query_id string, text string"))
    found = asked.street_place(asked._plain_texts(asked.active).select("query_id", "ordered", "words", "norm"))
    want = [50 * i + 7 for i in range(80)]
    assert sorted(r["idx"] for r in found.collect()) == want
    assert sorted(r["idx"] for r in Forward(data, "Weg Bayern").street_place("Weg Bayern").collect()) == want


def test_addresses_go_from_streets_found_to_their_areas(spark, town, monkeypatch):
    """Texts that ask for the same street meet it once, not once a text."""
    asked_for, nearness = [], ForwardTable._nearness
    monkeypatch.setattr(ForwardTable, "_nearness", lambda self, rows: asked_for.append(rows) or nearness(self, rows))
    texts = [f"Hauptstraße {n} München" for n in range(20, 30)]
    asked = ForwardTable(town, spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"))
    found = {tuple(r) for r in asked.addresses[0].select("query_id", "idx").collect()}
    assert len({q for q, _ in found}) in (0, len(texts))
    for rows in asked_for:
        assert sorted(rows.columns) == ["idx", "place"] and rows.count() <= 3 * 4  # three such streets; places that the words name


def test_words_without_areas_are_those_of_the_index(spark, town):
    """Plain texts read primary postings only, and the vocabulary needs no areas of entities."""
    rows = lambda df, *cols: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    words = add_words(GeoDataset({n: t for n, t in town.tables.items() if n not in ("postings_context", "postings_primary", "search_docs", "vocabulary")}))
    for name in ("vocabulary", "postings_primary", "postings_context", "search_docs"):
        assert rows(words.tables[name], *town.tables[name].columns) == rows(town.tables[name], *town.tables[name].columns), name
    asked = ForwardTable(words, spark.createDataFrame([(0, "Müller München"), (1, "Cafe Anton")], "query_id int, text string"))
    assert asked.postings.where("not plain").count() == 0
    assert ForwardTable(town, spark.createDataFrame([(0, "Hauptstr. 7 München")], "query_id int, text string")).postings.where("not plain").count() > 0


def test_candidates_need_every_word_and_meet_equal_records_once(spark, town):
    texts = ["Müller München", "Cafe Anton", "Hauptstr. 7", "anton"]
    asked = ForwardTable(town, spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"))
    stands = {}
    for r in asked.plan.collect():
        stands.setdefault(r["query_id"], {}).setdefault(r["q"], set()).add((r["plain"], r["token"]))
    held = {}
    for r in asked.postings.collect():
        held.setdefault((r["type"], r["idx"]), set()).add((r["plain"], r["token"]))
    want = {(q, *record) for q, parts in stands.items() for record, has in held.items() if all(has & some for some in parts.values())}
    got = [tuple(r) for r in asked.candidates.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({q for q, *_ in got}) >= 3
