"""The queries of the operators, one opN_<name> each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import corpus_queries
from waymark.llm.ball_tree import top_k
from waymark.llm.common import fold
from waymark.llm.hilbert_ann import nearest
from waymark.llm.language_id import fit_languages, identify_languages
from waymark.llm.mixing import mix
from waymark.llm.packing import pack
from waymark.llm.quality_cnn import fit_quality, score_quality
from waymark.llm.setsketch import near_duplicates
from waymark.llm.token_count import count_tokens
from waymark.llm.token_store import store_and_read
from waymark.llm.url_filter import Rule, filter_urls

RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged. Null urls and those without `://` have an empty host and path and the default verdict; repeated rows,
    null ids and long urls are answered row by row, ties go to the longer rule, then the earlier one; an empty table gives an
    empty table; columns of the same names in `pages` are left behind."""
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the words that the mix takes of it. Null texts have size 0 and are taken 0 words; a null source is a
    source, last; rows that tie at the cut are taken as far as they fit; an empty table gives an empty table."""
    return mix(table(spark, sf_dir, "documents"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth id. Vectors that are null or hold null or non-finite components, and rows with a null id,
    take no part; every other row is a candidate, also where it repeats an id; ties go to the smaller id; an empty table
    gives an empty table."""
    return top_k(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored. Null and empty texts score 0; long texts are read whole; repeated rows and null ids are scored
    each by its text; null labels are passed over; an empty table gives an empty table, and without labels every text
    scores one half."""
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 4) == 2
    net = fit_quality(docs, labels.where(~held_out))
    return score_quality(docs, net).withColumn("held_out", held_out).select("doc_id", "held_out", "score", "predicted")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text counted whole. Null and empty texts have 0 bytes and 0 tokens; repeated rows and null ids are counted row by
    row; an empty table gives an empty table."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, written and read back. Null and empty texts hold the end id alone; null ids come first, rows of the
    same id in order of a hash of the text; an empty table writes no file and gives an empty table."""
    return store_and_read(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language. Null, empty and letterless texts are `und` with score 0; of equal sizes the first language in
    code point order wins; repeated rows and null ids are answered row by row; an empty table gives an empty table."""
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    model = fit_languages(docs.where(~held_out))
    return identify_languages(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component. Null and empty texts have no shingles and link with nothing; rows with a null id take no part
    (component null, kept); rows that repeat an id count as one document; an empty table gives an empty table."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and bins; equal texts are the clusters (near-duplicates aren't sought here: pass cluster_col for
    that). Null and empty texts are one row without a bin; repeated rows are packed each; an empty table gives an empty
    table."""
    return pack(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth id. Vectors that are null, zero or hold null or non-finite components, and rows
    with a null id, take no part; every other row is indexed and a candidate, also where it repeats an id; ties go to the
    smaller id; an empty table gives an empty table."""
    return nearest(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filter, op2_source_mix, op3_exact_top_k, op4_quality, op5_token_counts, op6_token_store, op7_language, op8_near_duplicates, op9_packing, op10_nearest]
    return {f.__name__: f for f in found} | corpus_queries.queries()


_OP1 = """
WITH u AS (SELECT page_id, coalesce(url, '') AS url, position('://' IN coalesce(url, '')) AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, said) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                               ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
hit AS (SELECT host, path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(said, length(rh || rp)) AS said
        FROM (SELECT DISTINCT host, path FROM p)
        JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(said, 'allow') AS verdict
FROM p LEFT JOIN hit ON p.host = hit.host AND p.path = hit.path
"""

_OP2 = """
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS name FROM documents),
k AS (SELECT *, (('0x' || substr(md5('mix:' || name || ':' || size::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
           FROM k GROUP BY source),
reshare(source, source_size, weight, capped, level, round) AS (
  SELECT source, source_size, weight, false, NULL::DOUBLE, 0 FROM totals
  UNION ALL
  SELECT source, source_size, weight, capped OR coalesce(3 * source_size <= now * weight, false), now, round + 1
  FROM (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE
                  / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0)::DOUBLE AS now FROM reshare)
  WHERE round <= (SELECT count(*) FROM totals)),
aims AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target,
                CASE WHEN capped THEN 3 ELSE coalesce(floor(level * weight / nullif(source_size, 0)), 0) END::BIGINT AS whole
         FROM reshare WHERE round = (SELECT max(round) FROM reshare)),
rests AS (SELECT *, greatest(0.0, target - whole * source_size) AS rest FROM aims),
cand AS (SELECT k.*, r.rest, r.source_size, r.target, r.whole FROM k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source),
sums AS (SELECT *, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY size DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room,
                (sum((size * size)::HUGEINT) OVER (PARTITION BY source ORDER BY size))::DOUBLE AS below, min(size) OVER (PARTITION BY source) AS least_size
         FROM cand WHERE rest > 0 AND size > 0),
draws AS (SELECT source, max(size) AS top, max_by(room / below, size) AS c, max_by(room, size) AS room
          FROM sums WHERE room / below * size <= 1 OR size = least_size GROUP BY source),
odds AS (SELECT doc_id, d.source, size, u, room, least(1.0, c * size) AS p FROM cand JOIN draws d ON cand.source IS NOT DISTINCT FROM d.source
         WHERE size > 0 AND size <= top),
ranked AS (SELECT *, least(4503599627370495, floor(u * (1 - p) / (u * (1 - p) + p * (1 - u)) * 4503599627370496.0))::BIGINT AS rank FROM odds),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM ranked),
rest_of AS (SELECT *, max(CASE WHEN upto <= room THEN upto ELSE 0 END) OVER (PARTITION BY source) AS within FROM run),
filled AS (SELECT *, row_number() OVER (PARTITION BY source, upto <= room ORDER BY abs(room - within - size), rank, doc_id) AS place FROM rest_of),
drawn AS (SELECT doc_id, source, size, count(*) FILTER (WHERE upto <= room OR (place = 1 AND abs(room - within - size) < room - within)) AS more
          FROM filled GROUP BY doc_id, source, size),
numbered AS (SELECT c.*, d.top, row_number() OVER (PARTITION BY doc_id, c.source, size) AS copy
             FROM cand c LEFT JOIN draws d ON c.source IS NOT DISTINCT FROM d.source)
SELECT n.doc_id, n.size, source_size, target,
       (n.size * (whole + CASE WHEN n.size > top OR copy <= more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM numbered n LEFT JOIN drawn ON n.doc_id IS NOT DISTINCT FROM drawn.doc_id AND n.source IS NOT DISTINCT FROM drawn.source AND n.size = drawn.size
"""

_OP3 = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 10
"""

_OP8 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 2], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op2_source_mix": _OP2, "op3_exact_top_k": _OP3, "op8_near_duplicates": _OP8} | corpus_queries.oracle_sql()
