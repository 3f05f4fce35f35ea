"""The operators that describe a whole corpus, against their SQL and brute force on small tables with all kinds of odd rows."""

import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.llm import corpus_queries as C
from waymark.llm import divergence as D
from waymark.llm import kneser_ney as K
from waymark.llm import prefix_trie as P

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def told(rows, columns):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)]) for r in rows)


def agree(got, sql, **tables):
    """A DataFrame against SQL over the same rows."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"_{name}", df.toArrow())
        con.execute(f"CREATE VIEW {name} AS FROM _{name}")
    cur = con.execute(sql)
    columns = sorted(d[0] for d in cur.description)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(got.columns) == columns
    found = got.collect()
    assert told(found, columns) == told(want, columns)
    return found


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "The", "über", "ŒUVRE", "x1y", "漢字", "the,end", "don't", "É"]) + rng.choice(["", "", "b", "C", "z"] + ["q" * 60])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "é", None]), 0) for i in range(120)]
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, " \t\x0b\n 1 2 --", "fr", "only", 0), (503, "alone in its language", "it", "only", 0), (504, " ".join(word() for _ in range(9000)), "en", "b", 0)]
    rows += rows[:12] + [(None, "no id the the", "en", "a", 0), (None, None, None, None, None), (-7, "negative a a a", "de", "a", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("x")).withColumn("p", F.lit(1)).withColumn("value", F.lit(0)).withColumn("score", F.lit("x"))


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(4)
    say = lambda: rng.choice(["hi", "Hi", "", None, "über 漢", "ok"])
    rows = []
    for c in [*range(0, 60), *range(100, 130), 250, 251, 299, -5, -100, -101]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, None, 0]), rng.choice(["user", "bot", None]), say()))
    rows += rows[:15] + [(None, 1, "user", "hi"), (None, None, None, None), (7000, 0, "user", "hi"), (7001, None, None, None)]
    rows += [(8000 + k, t, "user", "same") for k in range(6, 30) for t in range(8)]  # copies
    rows += [(9001, t, "bot", f"long {t}") for t in range(3000)]
    return spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("pos", F.lit(0))


# Language model


def scored(docs):
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 7 == 2
    six = lambda c: F.round(c, 6).alias(c)
    return held_out, six


@pytest.mark.parametrize("block,shard_bytes", [(K.BLOCK, K.SHARD_BYTES), (50, 400)])
def test_language_model(docs, tmp_path, block, shard_bytes):
    """One shard and one block, and many of each (first words that fill a shard are dealt over all): the same scores."""
    held_out, six = scored(docs)
    model = K.fit_bigrams(docs.where(~held_out), folder=str(tmp_path), block=block, shard_bytes=shard_bytes)
    assert (model.shards > 1) == (block == 50) == bool(model.hot)
    got = K.score_texts(docs, model, block=block)
    assert got.where("n_tokens > 5 and abs(perplexity / pow(10, -score / n_tokens) - 1) > 1e-9").count() == 0
    agree(got.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", six("base_score"), six("score")), C._OP11, documents=docs)


def test_language_model_sums_to_one(spark, docs, tmp_path):
    """After every word, and after one never seen: the probabilities of all words, the end, and one unknown word."""
    model = K.fit_bigrams(docs, folder=str(tmp_path))
    words = sorted({w for r in docs.collect() for w in (r["text"] or "").encode().lower().split()})
    known = K._Words()
    for before in (words[0], words[-1], words[len(words) // 2], b"unseen"):
        total = 0.0
        for after in [*words, b"neither"]:
            b = K.Block()
            b.add(0, (before + b" " + after).decode(), known)
            v, w, _ = b.stream()
            total += pair(model, v[1], w[1])
        total += pair(model, known[before], K.END)
        assert math.isclose(total, 1, rel_tol=1e-9)


def pair(model, v, w):
    """p(w | v) from the model's own tables."""
    keys = np.unique(np.array([v, w, K.END], np.uint64))
    c, a, g = model.words(keys)
    at = lambda x: int(np.searchsorted(keys, np.uint64(x)))
    few = sum(d * m for d, m in zip(model.word, model.few, strict=True)) / (model.types + 1)
    d = [0.0, *model.word][min(3, a[at(w)])]
    lower = (max(a[at(w)] - d, 0) + few) / model.predecessors
    n = int(model.bigrams(np.array([v], np.uint64), np.array([w], np.uint64))[0])
    return lower if not c[at(v)] else (max(n - [0.0, *model.bigram][min(3, n)], 0) + g[at(v)] * lower) / c[at(v)]


def test_counts_above_a_byte(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b " * 1000, None, None, 0), (2, "a c", None, None, 0)], DOCS)
    model = K.fit_bigrams(docs, folder=str(tmp_path))
    known = K._Words()
    v, w = (np.array([known[x] for x in pair], np.uint64) for pair in ((b"a", b"b", b"a", b"c"), (b"b", b"a", b"c", b"a")))
    assert model.bigrams(v, w).tolist() == [1000, 999, 1, 0]


def test_language_model_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    model = K.fit_bigrams(none, folder=str(tmp_path))
    assert K.score_texts(none, model).count() == 0
    one = spark.createDataFrame([(1, "some words", None, None, 0)], DOCS)
    assert K.score_texts(one, model).select("n_tokens", "n_known", "score").first() == (3, 0, 0.0)
    with pytest.raises(ValueError, match="mounted"):
        K.fit_bigrams(none, folder="hdfs://somewhere/model")


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    got = C.op11_language_model(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# Divergence audit


@pytest.mark.parametrize("small", [False, True])
def test_audit(docs, monkeypatch, small):
    """Whole, and with small buffers: counts passed on early, no table of pairs, few pairs at once."""
    if small:
        for name, value in (("HELD", 10), ("AT_ONCE", 20), ("DENSE", 0)):
            monkeypatch.setattr(D, name, value)
    found = agree(D.audit(docs), C._OP12, documents=docs)
    assert {(r["lang"], r["source"]) for r in found if r["part"] == "pair"} >= {("", ""), ("en", "b")}


def test_audit_of_nothing(spark, docs):
    assert D.audit(spark.createDataFrame([], DOCS)).count() == 0
    agree(D.audit(docs.where("doc_id >= 500")), C._OP12, documents=docs.where("doc_id >= 500"))


@pytest.mark.parametrize("settled", [0, 3, 1024])
def test_radix_top(spark, monkeypatch, settled):
    """Values that differ in any digit, ties beyond the kth place that differ late in their names or in their length."""
    monkeypatch.setattr(D, "SETTLED", settled)
    rng = random.Random(9)
    rows = [(g, f"n{i}", v) for g in range(3) for i, v in enumerate([rng.choice([rng.randrange(10), rng.randrange(1 << 20), rng.randrange(1 << 60), 77]) for _ in range(80)])]
    rows += [(5, "same prefix " + "é" * n, 12) for n in range(40)] + [(5, "z", 13), (6, "one", 0), (6, "", 0)]
    rows += [(7, chr(0xFFFF - i) if i % 2 else chr(0x1F300 + i), 1 << 59) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, item string, value long")
    for k in (1, 7, 30):
        want = []
        for g in {r[0] for r in rows}:
            best = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
            want += [(*r, i + 1) for i, r in enumerate(best)]
        assert sorted(map(tuple, D.radix_top(df, ["g"], k).collect())) == sorted(want)


def test_frequency_is_exact_beyond_a_long(spark):
    n = 9 * 10**18 - 5
    got = spark.range(1).select(D.frequency(F.lit(n), F.lit(n), F.lit(4).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (n + 1) // (n + 4)


# Prefix trie


def test_trie(turns):
    rebuilt = P.trie(*P.with_shared_heads(P.turns_of(turns))).drop("digest")
    short = turns.where("conv_id is null or conv_id <> 9001")
    agree(P.trie(*P.with_shared_heads(P.turns_of(short))).drop("digest"), C._OP13, conversations=short)
    deep = rebuilt.where("conv_id = 9001").agg(F.max("depth"), F.max("n_leaves"), F.sum("n_convs")).first()
    h = zlib.crc32(b"9001") % 6  # conversation 9000 is absent
    assert deep[0] == 3000 - h and deep[1] == 1 and deep[2] == 3000 - h


@pytest.mark.parametrize("hot", [1, 3])
def test_trie_with_hot_parents(turns, monkeypatch, hot):
    monkeypatch.setattr(P, "HOT", hot)
    short = turns.where("conv_id is null or conv_id <> 9001")
    agree(P.trie(*P.with_shared_heads(P.turns_of(short))).drop("digest"), C._OP13, conversations=short)


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "hello"), (1, 1, "b", "yes"), (2, 0, "u", "hello"), (2, 1, "b", "no"), (3, 0, "u", "hello"), (4, 0, None, None)]
    got = {(r["conv_id"], r["depth"]): r for r in P.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()}
    assert got[1, 0]["n_convs"] == 4 and got[1, 0]["n_leaves"] == 3 and got[1, 0]["saved_tokens"] == 10
    assert got[1, 1]["n_children"] == 2 and got[2, 2]["parent_conv_id"] == 1 and got[4, 1]["n_convs"] == 1 and len(got) == 5


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert P.prefix_trie(none).count() == 0
    assert P.trie(*P.with_shared_heads(P.turns_of(none))).count() == 0


@pytest.mark.parametrize("name", sorted(C.oracle_sql()))
def test_queries_agree_with_sql(spark, sf, name):
    tables = {t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "conversations")}
    agree(C.queries()[name](spark, sf), C.oracle_sql()[name], **tables)
