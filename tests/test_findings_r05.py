"""Findings of round 5: all streets of a split are rated, and a street by its best split."""

import pytest
from pyspark.sql import functions as F

from waymark.operators.forward_table import ForwardTable
from waymark.operators.graph import cut
from waymark.sources.schema import GeoDataset

N = 6_100


def words(*w):
    return F.array(*map(F.lit, w)).cast("array<string>")


@pytest.fixture(scope="module")
def weg(spark):
    """N streets `weg <number>`; the last 30 are in Middle East, and have its words."""
    last = F.col("idx") >= N - 30
    way = cut(spark.range(N).select(F.col("id").cast("int").alias("idx")))
    at = lambda d: F.struct((F.lit(470000000) + d).cast("int").alias("lat_e7"), F.lit(90000000).alias("lon_e7"))
    number = (F.col("idx") % 200).cast("string")
    docs = lambda df, kind, name, inside: df.select(F.lit(kind).cast("byte").alias("type"), "idx", F.array_join(name, " ").alias("name_norm"), name.alias("name_tokens"), inside.alias("admin_tokens"), F.lit(False).alias("name_is_place"), F.lit("").alias("number_norm"), F.lit("").alias("street_norm"))
    streets = docs(way, 2, F.array(F.lit("weg"), number), F.when(last, words("east", "middle")).otherwise(words()))
    area = docs(spark.range(1).select(F.col("id").cast("int").alias("idx")), 3, words("east", "middle"), words())
    token = F.explode(F.when(last, words("weg", "east", "middle")).otherwise(words("weg"))).alias("token")
    return GeoDataset({
        "search_docs": cut(streets.unionByName(area)), "postings_context": cut(way.select(token, F.lit(2).cast("byte").alias("type"), "idx")),
        "street_admin": way.where(last).select("idx", F.lit(0).alias("ord"), F.lit(0).alias("area_idx")),
        "house_admin": way.where("false").select("idx", F.lit(0).alias("ord"), F.lit(0).alias("area_idx")),
        "streets": way.select("idx", F.array(at(0), at((N - F.col("idx")) * 10_000)).alias("geometry")),
        "admin_areas": spark.range(1).select(F.lit(0).alias("idx"), F.lit(4).alias("admin_level"), F.array(at(0), at(0)).alias("outer")),
    })


def asked(spark, data, *texts):
    return ForwardTable(data, spark.createDataFrame([(t, t) for t in texts], "query_id string, text string"))


def test_streets_past_the_first_6000_are_met(spark, weg):
    """they were left out, however well they fit."""
    table = asked(spark, weg, "Weg Middle East")
    found = table.street_place(table._plain_texts(table.active).select("query_id", "ordered", "words", "norm"))
    best = [r["idx"] for r in found.orderBy(F.desc("score"), "idx").collect()]
    assert len(best) == 80 and set(best[:30]) == set(range(N - 30, N)) and best[30:] == list(range(50))


@pytest.fixture(scope="module")
def addresses(spark, weg):
    table = asked(spark, weg, "Weg 7 Middle East", "Weg 8 Middle East")
    table.scored = spark.createDataFrame([], "query_id string, type byte, idx int, matched int, score int")  # no houses
    rows, said = table.addresses
    return rows.collect(), said.collect()


def test_addresses_meet_streets_past_the_first_6000(addresses):
    """the best 20 are the last of 6,100."""
    rows, said = addresses
    assert {r["resolution"] for r in said} == {"street_level"} and len(rows) == 40
    for text in ("Weg 7 Middle East", "Weg 8 Middle East"):
        assert {r["idx"] for r in rows if r["query_id"] == text} == set(range(N - 20, N))  # the nearest to its middle


def test_a_street_has_its_best_split(addresses):
    """`weg` in `middle east` counts, not `weg middle` in `east`, which is named in full too."""
    assert all(r["matched"] == 3 and r["score"] > 1_422 for r in addresses[0])
