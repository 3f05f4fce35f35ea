"""Queries of forward geocoding over tables of texts, and of the joins with the vocabulary. Imported for what it adds to
queries.QUERIES and queries.SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import text as X
from waymark.operators.forward_table import ForwardTable, taken_apart
from waymark.plans import build as B
from waymark.plans import index as IX
from waymark.plans import views as V
from waymark.queries import _indexed, _vocabulary, long, meters, query, toks

_PART_WORDS = f"(SELECT DISTINCT unnest({toks('p_name || chr(32) || p_type')}) AS token FROM part)"
_DOC_WORDS = f"(SELECT DISTINCT unnest({toks('text')}) AS found FROM documents)"


def _part_words(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "part").select(F.explode(X.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("token")).distinct()


@query(
    f"SELECT token, found, row_number() OVER (PARTITION BY token ORDER BY NOT starts_with(found, token), abs(length(found) - length(token)), length(found), encode(found)) AS rank FROM {_PART_WORDS} p JOIN {_DOC_WORDS} d ON length(token) >= 3 AND contains(found, token) QUALIFY rank <= 96",
    views=False,
)
def ix4_substring_table(spark: SparkSession, sf: str) -> DataFrame:
    found = IX.substring_join(_vocabulary(spark, sf), _part_words(spark, sf), 96)
    return found.select("token", "found", long("rank"))


_SEED = "greatest(3, least(5, length(token) // (CASE WHEN length(token) <= 5 THEN 2 ELSE 3 END)))"
_NEAR = f"""length(token) >= 4 AND abs(length(found) - length(token)) <= CASE WHEN length(token) <= 5 THEN 1 ELSE 2 END
AND levenshtein(found, token) <= CASE WHEN length(token) <= 5 THEN 1 ELSE 2 END
AND len(list_filter(range(1, length(token) - {_SEED} + 2), lambda i: contains(found, substr(token, i, {_SEED})))) > 0"""
_SHARED = "len(list_filter(range(1, least(length(token), length(found)) + 1), lambda i: left(token, i) = left(found, i)))"


@query(f"SELECT token, found, row_number() OVER (PARTITION BY token ORDER BY levenshtein(found, token), -{_SHARED}, length(found), encode(found)) AS rank FROM {_PART_WORDS} p JOIN {_DOC_WORDS} d ON {_NEAR}", views=False)
def ix5_fuzzy_table(spark: SparkSession, sf: str) -> DataFrame:
    """All near words, not only the best."""
    return IX.fuzzy_join(_vocabulary(spark, sf), _part_words(spark, sf)).select("token", "found", long("rank"))


# Forward geocoding of tables


def _asked(spark: SparkSession, sf: str, texts: DataFrame, limit: int = 20) -> ForwardTable:
    return ForwardTable(_indexed(spark, sf), texts.select(F.col("text").alias("query_id"), "text"), limit)


def _asked_words(spark: SparkSession, sf: str, texts: DataFrame) -> ForwardTable:
    """As _asked, for steps that read words of plain texts and prepared texts of a kind at most, so that streets don't meet areas."""
    texts = texts.select(F.col("text").alias("query_id"), "text")
    if taken_apart(texts).where("not plain").limit(1).count():
        return ForwardTable(_indexed(spark, sf), texts)
    return ForwardTable(IX.add_words(B.attribute(V.dataset(spark, sf))), texts)


def _poi_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Names with their kind, and names that lack their last letter."""
    kind = F.concat(F.lit(" "), F.replace("tag_value", F.lit("_"), F.lit(" ")))
    pois = V.pois(spark, sf)
    cut_short = F.expr("left(name, length(name) - 1)")
    return pois.select(F.concat("name", kind).alias("text")).unionByName(pois.select(F.concat(cut_short, kind).alias("text"))).distinct()


_POI_PLACES = """(SELECT p.idx, list(DISTINCT unnest_token) AS w FROM (SELECT q.idx, unnest(string_split(lower(regexp_replace(a.name, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) AS unnest_token
 FROM pois q JOIN areas a ON q.lat BETWEEN lat0 AND lat0 + h AND q.lon BETWEEN lon0 AND lon0 + w AND (level = 4 OR (q.lat - lat0) + (q.lon - lon0) <= 1600000)) p GROUP BY p.idx)"""

_CANDIDATES = f"""
, texts AS (SELECT DISTINCT name || ' ' || replace(tag_value, '_', ' ') AS text FROM pois UNION SELECT DISTINCT left(name, length(name) - 1) || ' ' || replace(tag_value, '_', ' ') FROM pois),
q AS (SELECT text, unnest(ts) AS q, len(ts) AS n_tokens FROM (SELECT text, {toks('text')} AS ts FROM texts)),
alt AS (SELECT DISTINCT q, unnest(list_distinct([q] || CASE WHEN length(q) BETWEEN 4 AND 32 THEN list_transform(list_filter(range(1, length(q) + 1), lambda i: substr(q, i, 1) IN ('a', 'o', 'u') AND substr(q, i + 1, 1) <> 'e')[1:4], lambda i: left(q, i) || 'e' || substr(q, i + 1)) ELSE [] END)) AS a FROM q),
post AS (SELECT unnest({toks("street || ' ' || house_number || ' ' || postcode")}) AS token, 1 AS type, idx FROM houses
  UNION SELECT unnest({toks('name')}), 2, idx FROM streets UNION SELECT unnest({toks('name')}), 3, idx FROM areas UNION SELECT unnest({toks("name || ' ' || brand || ' shop ' || tag_value")}), 4, idx FROM pois),
cnt AS (SELECT token, count(*) AS n FROM post GROUP BY token),
vocab AS (SELECT token AS found FROM cnt UNION SELECT unnest({toks('city')}) FROM houses),
wanted AS (SELECT alt.q, alt.a AS token, own.token IS NULL AS spread FROM alt LEFT JOIN cnt own ON own.token = alt.q LEFT JOIN cnt c ON c.token = alt.a WHERE own.token IS NULL OR (alt.a <> alt.q AND c.token IS NULL)),
near AS (SELECT token, found, true AS fuzzy, row_number() OVER (PARTITION BY token ORDER BY levenshtein(found, token), -{_SHARED}, length(found), encode(found)) AS rank FROM (SELECT DISTINCT token FROM wanted) w JOIN vocab ON {_NEAR}
  UNION ALL SELECT token, found, false, row_number() OVER (PARTITION BY token ORDER BY NOT starts_with(found, token), abs(length(found) - length(token)), length(found), encode(found)) FROM (SELECT DISTINCT token FROM wanted) w JOIN vocab ON length(token) >= 3 AND contains(found, token)),
more AS (SELECT w.q, found AS a FROM wanted w JOIN near ON near.token = w.token JOIN cnt ON cnt.token = found
  WHERE rank <= CASE WHEN spread AND fuzzy THEN 24 WHEN spread THEN 96 WHEN fuzzy THEN 12 ELSE 64 END
    AND (NOT spread OR (n <= 250000 AND NOT EXISTS (SELECT 1 FROM alt x WHERE x.q = w.q AND x.a = found)))),
plan AS (SELECT q, a FROM alt JOIN cnt ON cnt.token = a UNION SELECT q, a FROM more)
"""


@query(_CANDIDATES + "SELECT text AS query_id, type::BIGINT AS type, idx FROM q JOIN plan ON plan.q = q.q JOIN post ON post.token = plan.a GROUP BY text, type, idx, n_tokens HAVING count(DISTINCT q.q) = n_tokens")
def fg13_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Records that have every token of a text, or what stands for it, for all texts drawn from the points of interest."""
    return _asked_words(spark, sf, _poi_texts(spark, sf)).candidates.select("query_id", long("type"), long("idx"))


@query(_CANDIDATES + "SELECT DISTINCT text AS query_id, q.q AS q, a AS token FROM q JOIN plan ON plan.q = q.q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.text = q.text AND NOT EXISTS (SELECT 1 FROM plan p WHERE p.q = o.q))")
def fg5_token_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What stands for each token of those texts."""
    return _asked_words(spark, sf, _poi_texts(spark, sf)).plan.select("query_id", "q", "token")


@query()
def fg13_geocode_table(spark: SparkSession, sf: str) -> DataFrame:
    """The answers to all those texts."""
    return _asked(spark, sf, _poi_texts(spark, sf)).results()


def _region_texts(spark: SparkSession, sf: str) -> DataFrame:
    regions = V.table(spark, sf, "region")
    return regions.select(F.concat(F.lit("Weg "), "r_name").alias("text")).unionByName(regions.select(F.concat("r_name", F.lit(" Weg")).alias("text")))


# The split into the street `weg` and the region is the best for every street: other splits find no area of that name, or
# fewer words, and stay hundreds of points below. All streets are rated, however many have the word.
_WEG = f"""
, every AS (SELECT idx FROM streets WHERE name <> ''),
mid AS (SELECT idx, max(CASE WHEN pos = n // 2 + 1 THEN lat END) AS lat, max(CASE WHEN pos = n // 2 + 1 THEN lon END) AS lon FROM street_points GROUP BY idx),
within AS (SELECT DISTINCT s.idx, a.idx AS area FROM street_points s JOIN areas a ON level = 4 AND s.lat BETWEEN lat0 AND lat0 + h AND s.lon BETWEEN lon0 AND lon0 + w),
scored AS (SELECT a.name, every.idx, within.idx IS NOT NULL AS within, CASE WHEN within.idx IS NULL THEN 0 ELSE len(string_split(a.name, ' ')) END AS m,
  CASE WHEN within.idx IS NULL THEN 0 ELSE 900 + greatest(0, 600 - floor({meters('mid.lat, mid.lon', '(a.lat0 + 640000), (a.lon0 + 3200000)')} / 50)) END AS near,
  CASE WHEN k <= 25 THEN 150 WHEN k <= 100 THEN 125 WHEN k <= 500 THEN 95 WHEN k <= 2000 THEN 65 WHEN k <= 10000 THEN 35 ELSE 0 END AS rarity
  FROM every JOIN mid ON mid.idx = every.idx CROSS JOIN (SELECT * FROM areas WHERE level = 4) a CROSS JOIN (SELECT count(*) AS k FROM every) LEFT JOIN within ON within.idx = every.idx AND within.area = a.idx),
rated AS (SELECT name, idx, within, 1 + m AS matched, (170 + 38 + 28*m + 6*(1 + m) + 240 + near + rarity)::BIGINT AS score FROM scored)
"""


@query(_WEG + "SELECT text AS query_id, 2::BIGINT AS type, idx, matched::BIGINT AS matched, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, idx) AS r FROM rated) JOIN (SELECT r_name, 'Weg ' || r_name AS text FROM region UNION ALL SELECT r_name, r_name || ' Weg' FROM region) ON r_name = name WHERE r <= 80")
def fg6_street_place(spark: SparkSession, sf: str) -> DataFrame:
    asked = _asked(spark, sf, _region_texts(spark, sf))
    return asked.street_place(asked._plain_texts(asked.active).select("query_id", "ordered", "words", "norm")).select("query_id", *map(long, ("type", "idx", "matched", "score")))


@query(_WEG + "SELECT text AS query_id, r AS rank, 2::BIGINT AS type, idx, matched::BIGINT AS matched, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, idx) AS r FROM rated WHERE within) JOIN (SELECT DISTINCT r_name, 'Weg ' || house_number || ' ' || r_name AS text FROM region CROSS JOIN houses) ON r_name = name WHERE r <= 20")
def fg10_address(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of a number in a region: no house stands in such a street, so the streets answer."""
    numbers = V.houses(spark, sf).select("house_number").distinct()
    texts = numbers.crossJoin(F.broadcast(V.table(spark, sf, "region").select("r_name"))).select(F.concat(F.lit("Weg "), "house_number", F.lit(" "), "r_name").alias("text"))
    return _asked(spark, sf, texts).results().select("query_id", *map(long, ("rank", "type", "idx", "matched", "score")))


@query(f"""
, texts AS (SELECT DISTINCT lower(name || ' ' || r_name) AS text, name || ' ' || r_name AS query_id FROM pois CROSS JOIN region),
o AS (SELECT query_id, string_split(text, ' ') AS ws FROM texts),
s AS (SELECT query_id, ws, unnest(range(1, len(ws))) AS k FROM o),
parts AS (SELECT query_id, list_sort(list_distinct(ws[1:k])) AS brand, list_sort(list_distinct(ws[k+1:])) AS place FROM s UNION SELECT query_id, list_sort(list_distinct(ws[k+1:])), list_sort(list_distinct(ws[1:k])) FROM s),
named AS (SELECT query_id, brand, place FROM parts WHERE EXISTS (SELECT 1 FROM areas WHERE list_has_all({toks('areas.name')}, place))),
poi AS (SELECT pois.idx, {toks("name || ' ' || brand || ' shop'")} AS own, lower(name) AS n, {toks('brand')} AS b, coalesce(w, []) AS w FROM pois LEFT JOIN {_POI_PLACES} x ON x.idx = pois.idx),
met AS (SELECT query_id, poi.idx, named.brand, len(list_intersect(place, w)) AS m, own, n, b FROM named JOIN poi ON list_has_all(own, named.brand)),
rated AS (SELECT query_id, idx, len(brand) + m AS matched, 520 + 70*len(brand) + 180*m + CASE WHEN list_has_all(b, brand) THEN 420 ELSE 0 END + CASE WHEN contains(' ' || n || ' ', ' ' || array_to_string(brand, ' ') || ' ') THEN 130 ELSE 0 END
  + CASE WHEN n = array_to_string(brand, ' ') THEN 1200 ELSE 0 END - CASE WHEN m = 0 THEN 260 ELSE 0 END - CASE WHEN len(brand) = 1 AND NOT list_has_all(b, brand) AND len(own) > 3 THEN 220 ELSE 0 END AS score FROM met),
best AS (SELECT query_id, idx, max({{'score': score, 'matched': matched}}) AS x FROM rated GROUP BY ALL)
SELECT query_id, 4::BIGINT AS type, idx, x.matched::BIGINT AS matched, x.score::BIGINT AS score FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x.score DESC, idx) <= 80""")
def fg8_brand_place(spark: SparkSession, sf: str) -> DataFrame:
    """Names of points of interest with the name of a region, for all of both."""
    names = V.pois(spark, sf).select("name").distinct()
    texts = names.crossJoin(F.broadcast(V.table(spark, sf, "region").select("r_name"))).select(F.concat("name", F.lit(" "), "r_name").alias("text"))
    return _asked_words(spark, sf, texts).brand_place().select("query_id", *map(long, ("type", "idx", "matched", "score")))
