"""The queries of the operators that describe a whole corpus (language model, divergence audit, prefix trie), and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import fold
from waymark.llm.divergence import audit
from waymark.llm.kneser_ney import fit_bigrams, score_texts
from waymark.llm.prefix_trie import trie, turns_of, with_shared_heads


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of those outside its held-out fold. Null texts are empty; empty ones are an end alone;
    long texts are read whole; repeated rows and null ids are scored each by its text; an empty table gives an empty table."""
    docs, held_out = spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(F.col("doc_id"), 7) == 2
    scored = score_texts(docs, fit_bigrams(docs.where(~held_out)))
    six = lambda c: F.round(c, 6).alias(c)  # noqa: E731  sums of doubles, told alike by every engine
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", six("base_score"), six("score"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others, and its outstanding terms. Null lang, source and text are empty; every
    row is a document, repeated or not; groups without terms have pairs alone; ties go to the smaller item; an empty table
    gives an empty table."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations. Null roles and texts are empty; turns that tie are ordered by a digest of
    role and text; rows with a null conversation take no part; an empty table gives an empty table."""
    turns = turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie(*with_shared_heads(turns)).drop("digest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op11_language_model, op12_divergence, op13_prefix_trie)}


#: crc32 of a decimal, as SQL: the table of the 256 byte values, then one step for each character.
CRC32 = """
bits AS (SELECT list(list_reduce([b] || range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS tab FROM range(256) r(b)),
"""
_CRC32_OF = "xor(list_reduce([4294967295] || [ord(x) FOR x IN string_split({}, '')], lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)"

_OP11 = (
    "WITH "
    + CRC32.strip()
    + """
d AS (SELECT row_number() OVER () AS r, doc_id, """
    + _CRC32_OF.format("coalesce(doc_id::VARCHAR, 'null')")
    + """ % 7 = 2 AS held_out,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents, bits),
t AS (SELECT r, doc_id, held_out, unnest(ws || [' end']) AS w, unnest([' start'] || ws) AS v FROM d),
b AS (SELECT v, w, count(*) AS n FROM t WHERE NOT held_out GROUP BY v, w),
u AS (SELECT w, sum(n) AS c, count(*) AS a FROM b GROUP BY w),
f AS (SELECT v, sum(n) AS c, count(*) FILTER (WHERE n = 1) AS n1, count(*) FILTER (WHERE n = 2) AS n2, count(*) FILTER (WHERE n > 2) AS n3 FROM b GROUP BY v),
k AS (SELECT coalesce(sum(c), 0)::DOUBLE AS tokens, count(*) AS types, sum(a) AS before, count(*) FILTER (WHERE a = 1) AS m1, count(*) FILTER (WHERE a = 2) AS m2, count(*) FILTER (WHERE a > 2) AS m3,
             count(*) FILTER (WHERE a = 3) AS t3, count(*) FILTER (WHERE a = 4) AS t4 FROM u),
h AS (SELECT count(*) FILTER (WHERE n = 1) AS s1, count(*) FILTER (WHERE n = 2) AS s2, count(*) FILTER (WHERE n = 3) AS s3, count(*) FILTER (WHERE n = 4) AS s4 FROM b),
d2 AS (SELECT CASE WHEN s1 * s2 * s3 * s4 = 0 THEN [0.0, 0.5, 1, 1.5] ELSE [0.0, greatest(0, least(1, 1 - 2 * y * s2 / s1)), greatest(0, least(2, 2 - 3 * y * s3 / s2)), greatest(0, least(3, 3 - 4 * y * s4 / s3))] END AS big
       FROM (SELECT *, s1 / nullif(s1 + 2 * s2, 0)::DOUBLE AS y FROM h)),
d1 AS (SELECT CASE WHEN m1 * m2 * t3 * t4 = 0 THEN [0.0, 0.5, 1, 1.5] ELSE [0.0, greatest(0, least(1, 1 - 2 * y * m2 / m1)), greatest(0, least(2, 2 - 3 * y * t3 / m2)), greatest(0, least(3, 3 - 4 * y * t4 / t3))] END AS few
       FROM (SELECT *, m1 / nullif(m1 + 2 * m2, 0)::DOUBLE AS y FROM k)),
p AS (SELECT r, doc_id, held_out, coalesce(u.c, 0) AS c, tokens, types,
             CASE WHEN before IS NULL THEN 1 / (types + 1)
                  ELSE (greatest(coalesce(u.a, 0) - few[least(coalesce(u.a, 0), 3) + 1], 0) + (few[2] * m1 + few[3] * m2 + few[4] * m3) / (types + 1)) / before END AS lower,
             f.c AS total, big[2] * n1 + big[3] * n2 + big[4] * n3 AS g, greatest(coalesce(b.n, 0) - big[least(coalesce(b.n, 0), 3) + 1], 0) AS high
      FROM t, k, d1, d2 LEFT JOIN u ON u.w = t.w LEFT JOIN f ON f.v = t.v LEFT JOIN b ON b.v = t.v AND b.w = t.w)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE c > 0)::BIGINT AS n_known, any_value(tokens)::BIGINT AS train_tokens,
       round(sum(log10((c + 1) / (tokens + types + 1))), 6) AS base_score, round(sum(log10(CASE WHEN total > 0 THEN (high + g * lower) / total ELSE lower END)), 6) AS score
FROM p GROUP BY r, doc_id, held_out
"""
)

_OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
full_c AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, n_lang FROM g JOIN kept k ON g.lang = k.lang
           LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
v AS (SELECT lang, count(*) AS v, sum(n_lang) AS n FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS n FROM full_c GROUP BY ALL),
p AS (SELECT f.lang, f.source, term, f.n, 1 + (1000000000 * (f.n + 1)) // (s.n + v.v) AS p, 1 + (1000000000 * (n_lang + 1)::HUGEINT) // (v.n + v.v) AS q
      FROM full_c f JOIN s ON s.lang = f.lang AND s.source = f.source JOIN v ON v.lang = f.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT g.lang, g.source, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
           FROM (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

_OP13 = (
    "WITH "
    + CRC32.strip()
    + """
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
             """
    + _CRC32_OF.format("conv_id::VARCHAR")
    + """ % 6 AS h
      FROM (SELECT DISTINCT conv_id FROM t), bits),
own AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h
        UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos < h),
q AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS s FROM own GROUP BY conv_id),
seqs AS (SELECT c.conv_id, coalesce(s, []) AS s FROM c LEFT JOIN q ON q.conv_id = c.conv_id),
p AS (SELECT conv_id, d, s[1:d] AS k, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
n AS (SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids FROM p GROUP BY k),
ch AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(length(k[depth].text), 0) AS saved FROM n LEFT JOIN ch USING (k)),
b AS (SELECT k[1:j] AS k, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM (SELECT k, saved, n_children, unnest(range(0, depth + 1)) AS j FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, sha256(m.ids) AS ends_sha256
FROM m JOIN b USING (k) LEFT JOIN m up ON m.depth > 0 AND up.k = m.k[1:m.depth - 1]
"""
)


def oracle_sql() -> dict[str, str]:
    return {"op11_language_model": _OP11, "op12_divergence": _OP12, "op13_prefix_trie": _OP13}
