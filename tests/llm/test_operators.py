"""The training-data operators against brute force, on small tables with all kinds of odd rows."""

import random
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import corpus_queries
from waymark.llm import queries as Q
from waymark.llm.ball_tree import BallTree, products, quantise, top_k
from waymark.llm.hilbert import hilbert_keys
from waymark.llm.hilbert_ann import Curves, nearest, window_plan
from waymark.llm.language_id import LanguageModel, classify, fit_languages, identify_languages
from waymark.llm.mixing import mix, mixed_documents
from waymark.llm.packing import pack, pack_shard
from waymark.llm.quality_cnn import fit_network, fit_quality, passages, score_quality
from waymark.llm.setsketch import M, _across, banding, estimate, near_duplicates, shingles, sketch
from waymark.llm.token_count import count_huge, count_tokens, tokenizer
from waymark.llm.token_store import PieceEncoder, PieceTable, Reader, Writer, decode_block, encode_block, encoder, split_pieces, store_and_read
from waymark.llm.url_filter import Rule, ShiftAnd, filter_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, of=400):
    return " ".join(f"w{rng.randint(0, of)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Ids, texts, sources: ties, repeats, nulls, empty and long texts."""
    rng = random.Random(5)
    out = [(i, words(rng, rng.randint(1, 200)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "é", None]), 0) for i in range(200)]
    out += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n", "en", "b", 0), (203, words(rng, 9000), "en", "a", 0), (204, "one", "de", "b", 0)]
    out += [(i + 300, t, lang, s, n) for i, t, lang, s, n in out[:40]] + out[:10] + [(None, "no id at all", "en", "a", 0), (None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("score", F.lit(1)).withColumn("size", F.lit("x")).withColumn("taken", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# URL filters


def glob(pattern, text):
    """Whether a glob fits, by recursion."""
    if not pattern:
        return not text
    if pattern.startswith("**"):
        return any(glob(pattern[2:], text[i:]) for i in range(len(text) + 1))
    if pattern[0] == "*":
        return any(glob(pattern[1:], text[i:]) for i in range(len(text) + 1) if "/" not in text[:i])
    return bool(text) and (pattern[0] == text[0] or (pattern[0] == "?" and text[0] != "/")) and glob(pattern[1:], text[1:])


def test_shift_and():
    rng = random.Random(1)
    patterns = ["".join(rng.choice(["a", "b", "/", "*", "**", "?"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    patterns = [p.replace("***", "**") for p in patterns if "****" not in p] + ["a" * 70 + "*", "**" + "b" * 65]
    texts = ["".join(rng.choice("ab/") for _ in range(rng.randint(0, 12))) for _ in range(200)] + ["a" * 90, "a" + "b" * 65, "x" * 5000]
    got = ShiftAnd(patterns).match(texts)
    assert got.tolist() == [[glob(p, t) for p in patterns] for t in texts[:200]] + ShiftAnd(patterns).match(texts[200:]).tolist()
    assert got[200][-2] and got[201][-1] and ShiftAnd(patterns).match([]).shape == (0, len(patterns))


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://Example.COM/en/7x", "https://a.example.com/en/1?q=/en/7", "http://com/en/", "http://xcom/en/", "ftp://example.net/de/8#x", "x://y://org/es/", "http://shop.org/es/a", "http://foo.org/x.com/en/", "://", "http://com?/en/", "http://" + "a" * 20000 + ".org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[3])] * 2, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [(r["host"][:20], r["path"], r["rule"], r["verdict"]) for r in filter_urls(df, Q.RULES).collect()]
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("example.com", "/en/7x", "example.com/en/7", "allow") == got[-1] == got[-2]
    assert got[4] == ("a.example.com", "/en/1", "com/en/", "block")
    assert [g[3] for g in got[5:13]] == ["block", "allow", "block", "allow", "block", "allow", "allow", "allow"]
    assert got[13][2:] == ("org/es/", "block")
    assert filter_urls(df.limit(0), Q.RULES).count() == 0
    assert filter_urls(df, [Rule("block", "com", "")]).where("verdict = 'block'").count() == 6


# Mixing


def test_mix(docs, rows, empty):
    got = [r.asDict() for r in mix(docs).collect()]
    assert len(got) == len(rows)
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want, left, total = {}, set(names), sum(size.values())
    while left:  # reshare the excess until none is above
        share = {s: (total - sum(want.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        full = {s for s in left if share[s] >= 3 * size[s]}
        want |= {s: 3 * size[s] for s in full} or {}
        if not full:
            want |= share
            break
        left -= full
    by = {(g["source_size"]): g["target"] for g in got}
    assert all(abs(by[size[s]] - want[s]) < 1e-6 for s in names)
    for s in names:
        own = [g for g in got if g["source_size"] == size[s]]
        largest = max(g["size"] for g in own)
        assert abs(sum(g["taken"] for g in own) - want[s]) <= max(2, largest / 2)
    assert all(g["taken"] <= 3 * g["size"] and (g["size"] == 0) <= (g["taken"] == 0) for g in got)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    again = sorted((r.asDict() for r in mix(docs.repartition(7)).collect()), key=key)
    assert again == sorted(got, key=key)
    assert mix(empty).count() == 0


def odds_sample(items, rest):
    """items (size, u as an integer) -> the sizes that Pareto sampling takes: certain ones, then by odds ratio, then one that fits."""
    certain, open_ = [], sorted(items, key=lambda t: -t[0])
    while True:
        c = (rest - sum(certain)) / sum(s * s for s, _ in open_)
        if c * open_[0][0] <= 1 or open_[0][0] == open_[-1][0]:
            break
        top = open_[0][0]
        certain += [s for s, _ in open_ if s == top]
        open_ = [t for t in open_ if t[0] != top]

    def ratio(t):
        u, p = (t[1] + 0.5) / 2**52, min(1.0, c * t[0])
        return (u / (1 - u)) * (1 - p) / p

    room, left = rest - sum(certain), sorted(open_, key=ratio)
    while left and left[0][0] <= room:
        certain.append(left[0][0])
        room -= left.pop(0)[0]
    best = min(left, key=lambda t: abs(room - t[0]), default=(0, 0))
    return certain + ([best[0]] if abs(room - best[0]) < room else [])


def test_pareto_sample(spark):
    """Against the definition: few large documents, many small ones, one size only, repeated rows."""
    rng = random.Random(11)
    sizes = {"a": [1000, 1000], "b": [rng.randint(1, 40) for _ in range(300)] + [3000, 2500, 700], "c": [7] * 100, "d": [500]}
    rows, i = [], 0
    for s, ns in sizes.items():
        for n in ns:
            rows.append((i, " ".join(["w"] * n), s))
            i += 1
    rows += [(9999, "x y z", "e")] * 60 + [(10_000 + j, "x", "e") for j in range(20)]
    sizes["e"] = [3] * 60 + [1] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix(df).collect()
    import hashlib

    u = lambda i, n: int(hashlib.md5(f"mix:{i}:{n}".encode()).hexdigest()[:13], 16)
    for s, ns in sizes.items():
        own = [g for g in got if g["source_size"] == sum(ns)]
        target = own[0]["target"]
        repeats = int(target // sum(ns))
        more = sorted(g["size"] for g in own for _ in range(g["taken"] // g["size"] - repeats))
        rest = target - repeats * sum(ns)
        items = [(len(t.split()), u(i, len(t.split()))) for i, t, x in rows if x == s]
        want = sorted(odds_sample(items, rest)) if rest > 0 else []
        assert more == want, s
        assert abs(sum(g["taken"] for g in own) - target) <= max(ns) / 2
    # large documents are likelier, in proportion
    few = mix(spark.createDataFrame([(i, "w " * (1 + 39 * (i % 2)), "z" if i < 4000 else "a") for i in range(4400)], "doc_id long, text string, source string")).where("source_size > 20000").groupBy("size").agg(F.avg((F.col("taken") > 0).cast("int"))).collect()
    rate = {r[0]: r[1] for r in few}
    assert rate[40] > 5 * rate[1]


def test_mixed_documents(spark, docs, empty):
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    taken = mix(docs).agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == pytest.approx(taken, abs=20)
    same = spark.createDataFrame([(1, "a b c", "s", k) for k in range(50)] + [(2, "a", "t", 0)], "doc_id long, text string, source string, k int")
    assert mixed_documents(same).count() == mix(same).agg(F.sum(F.col("taken") / F.col("size"))).first()[0]
    assert mixed_documents(empty).count() == 0


# Exact top-k


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype("f4")
    x[n // 2 : n // 2 + n // 3] = x[0]  # many equal ones
    return x


@pytest.fixture(scope="module")
def embeddings(spark):
    x = vectors(400, 8, 2)
    odd = [(900, None), (901, []), (902, [None] * 8), (1000, [float("nan")] * 8), (1100, [float("inf")] * 8), (1200, [0.0] * 8), (None, [1.0] * 8), (200, [float(v) for v in x[200]]), (1300, [1.0, 2.0])]
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))


def lists(found, *names):
    """The lists of each query_id, each as sorted rows; repeated query rows have as many lists."""
    out = {}
    for r in found:
        out.setdefault(r["query_id"], []).append(tuple(r[n] for n in names))
    return {q: sorted(rows) for q, rows in out.items()}


def test_top_k(embeddings):
    """All rows count: those that repeat an id, with the same vector or another."""
    more = embeddings.sparkSession.createDataFrame([(100, [9.0] * 8), (7, [8.0] * 8), (7, [8.0] * 8), (5, [-1.0] * 8)], "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    table = embeddings.union(more)
    rows = [(r["vec_id"], np.array(r["embedding"])) for r in table.where("(vec_id < 400 and vec_id >= 0) or vec_id in (1200, 1300)").collect()]
    want = {}
    for i, (q, x) in enumerate(rows):
        if q % 100 == 0:
            s = sorted((-int(quantise(x, 1024) @ quantise(v, 1024)), j) for n, (j, v) in enumerate(rows) if n != i and len(v) == len(x))[:10]
            want.setdefault(q, []).extend((k + 1, j, -v) for k, (v, j) in enumerate(s))
    for options in ({}, {"shard_rows": 20}):
        assert lists(top_k(table, **options).collect(), "rank", "vec_id", "score") == {q: sorted(r) for q, r in want.items() if r}
    assert top_k(embeddings.limit(0)).count() == 0
    assert top_k(embeddings.where("vec_id in (100, 101)")).count() == 1
    with pytest.raises(Exception, match="beyond"):
        top_k(embeddings.sparkSession.createDataFrame([(100, [1e30, 1.0]), (2, [1e30, 2.0])], "vec_id long, embedding array<float>")).collect()


def test_exact_products():
    big = np.array([[2**40, 3]])
    assert products(big, np.array([[2**20, 1]])).tolist() == [[2**60 + 3]]
    with pytest.raises(OverflowError):
        products(np.array([[2**40]]), np.array([[2**40]]))
    with pytest.raises(OverflowError):
        quantise(np.array([1e300]), 1024)


def test_ball_tree_prunes_nothing_it_needs():
    x = quantise(vectors(3000, 6, 3), 1024)
    ids = np.random.default_rng(1).permutation(3000)
    q = x[:40]
    s, n = BallTree.build(x, 64).search(ids, ids, q, ids[:40], 5, np.full(40, -(2**63)))
    p = q @ x.T
    p[np.arange(40), np.arange(40)] = -(2**62)
    for i in range(40):
        order = np.lexsort((ids, -p[i]))[:5]
        assert n[i].tolist() == ids[order].tolist() and s[i].tolist() == p[i][order].tolist()


# Quality


@pytest.fixture(scope="module")
def marked():
    rng = random.Random(8)
    good = ["".join(rng.choice(["the ", "of ", "and ", "thing ", "word ", "is "]) for _ in range(rng.randint(10, 300))) for _ in range(150)]
    bad = [" ".join("".join(rng.choice("#$%&!*") for _ in range(4)) for _ in range(rng.randint(10, 200))) for _ in range(60)]
    return [(t, 1) for t in good] + [(t, 0) for t in bad]


def convolved(net, text):
    """The score of one text, window by window."""
    raw = (text or "").encode()
    found = []
    for s in net.starts(len(raw)) if raw else []:
        ids, maxima, at = list(raw[s : s + net.chunk]), [], 0
        while True:
            window = [*ids[at : at + net.width], *[256] * (net.width - len(ids[at : at + net.width]))]
            maxima.append(np.concatenate([net.embed[i] for i in window]) @ net.filters)
            at += net.stride
            if at - net.stride + net.width >= len(ids):
                break
        pooled = np.maximum(np.max(maxima, 0) + net.bias, 0)
        z = np.maximum(np.concatenate([pooled, [np.log2(len(ids) + 1) / 5 - 1, 1]]) @ net.dense, 0) @ net.head + net.out
        found.append(1 / (1 + np.exp(-z)))
    return np.mean(found) if found else 0.0


def test_network(marked):
    train, held = marked[::2], marked[1::2]
    net = fit_network(*zip(*train, strict=True), prior=0.7)
    scores = net.scores([t for t, _ in held])
    assert np.mean((scores >= 0.7) == [y for _, y in held]) > 0.97
    assert net.scores([None, ""]).tolist() == [0, 0]
    long = held[0][0] * 400
    assert net.scores([long])[0] == pytest.approx(net.scores([None, long, "x"])[1])
    junk = "#$%& " * 3000
    assert net.scores([held[0][0] * 20 + junk])[0] < 0.7  # the end of a text counts as much as its beginning
    texts = [t for t, _ in held] + ["", None, "x", "é" * 1025, "#$" * 700, "abc", held[0][0][:9], held[0][0][:8]]
    together, order = net.scores(texts), np.random.default_rng(1).permutation(len(texts))
    assert np.abs(net.scores([texts[i] for i in order]) - together[order]).max() < 1e-6  # the rows beside a text don't matter
    assert max(abs(net.scores([t])[0] - s) for t, s in zip(texts, together, strict=True)) < 1e-6
    assert max(abs(convolved(net, t) - s) for t, s in zip(texts, together, strict=True)) < 1e-5
    assert fit_network([], []).scores(["x"])[0] == pytest.approx(0.5) and fit_network(["x"], [1]).scores(["y"])[0] > 0.9


def test_quality_on_tables(spark, docs, marked, empty):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(marked)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, (_, y) in enumerate(marked)] + [(0, None, 0), (None, 1, 0), (0, 1, 0), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    net = fit_quality(d, labels)
    out = score_quality(docs, net).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    assert score_quality(empty, net).count() == 0 and fit_quality(empty, labels.limit(0)).scores(["x"])[0] == pytest.approx(0.5)


def test_quality_of_held_out_documents(spark):
    """op4's query: accuracy and AUC on the fold that it doesn't learn from."""
    got = {r["doc_id"]: r for r in Q.op4_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = [(r["quality"], got[r["doc_id"]]) for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r["doc_id"] in got and r["quality"] is not None]
    held = [(y, r["score"]) for y, r in labels if r["held_out"]]
    assert len(got) == 1000 and len(held) > 50
    good, bad = ([s for y, s in held if y == v] for v in (1, 0))
    assert np.mean([(s > t) + (s == t) / 2 for s in good for t in bad]) > 0.97
    assert np.mean([(s >= 0.7) == y for y, s in held]) > 0.93


def test_quality_learns_from_whole_texts_and_one_row_of_an_id(spark):
    d = spark.createDataFrame([(i, "w" * 40_000 + ("good " if i % 2 else "#$%& ") * 4000) for i in range(40)] + [(1, "#$%& " * 100)] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    net = fit_quality(d, labels, epochs=30)
    assert net.scores(["good " * 100])[0] > net.scores(["#$%& " * 100])[0] + 0.2
    text = "".join(chr(97 + i % 26) for i in range(3000))
    parts = spark.createDataFrame([(text,), ("short",), ("x" * 64,)], "text string").select(passages(F.col("text"), 4, 16)).collect()
    assert parts[1][0] == ["short"] and parts[2][0] == ["x" * 16] * 4 and parts[0][0][0] == text[:16] and parts[0][0][-1] == text[-16:]


# Tokens


@pytest.fixture(scope="module")
def byte_bpe():
    return tokenizer(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(n):
    rng = random.Random(3)
    parts = list("abAB .,'s\n\té　\u00a0\x1c!?12İΣσ́ß") + ["<|endoftext|>", "'s ", "don't ", "\r\n", "   ", "ﬁ", "中文", "\U0001f600"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def test_resynchronised_counts(byte_bpe):
    for t in [*odd_texts(600), "x" * 3000, "1 " * 900, " " * 500 + "a"]:
        whole = len(byte_bpe.encode(t, add_special_tokens=False).ids)
        assert count_huge(t, byte_bpe, 30, 8) == whole


def test_token_counts(spark, docs, rows, byte_bpe, empty):
    got = count_tokens(docs, chunk=200, overlap=40).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), len(byte_bpe.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got) and count_tokens(empty).count() == 0
    odd = odd_texts(300)
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df).collect()} == {i: len(byte_bpe.encode(t, add_special_tokens=False).ids) for i, t in enumerate(odd)}


def test_planes():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(10, "u4"), rng.integers(0, 2**32, 999, dtype="u4"), rng.integers(0, 50_000, 5000).astype("u4"), np.arange(70_000, dtype="u4"), np.zeros(0, "u4")):
        kind, planes = encode_block(ids)
        assert decode_block(kind, planes, len(ids)).tolist() == ids.tolist()


def test_token_file(tmp_path):
    import pyarrow as pa
    import pyarrow.fs

    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 49_000, n).astype("<u4") for n in (0, 1, 300, 5, 0, 1000, 2)]
    with pa.fs.LocalFileSystem().open_output_stream(str(tmp_path / "f")) as sink:
        w = Writer(sink, block=64)
        for i, t in enumerate(texts):
            w.add(i, t)
        w.close(pa.int64())
    with pa.fs.LocalFileSystem().open_input_file(str(tmp_path / "f")) as source:
        r = Reader(source)
        assert [d.tolist() for d in r.documents()] == [t.tolist() for t in texts] and r.names.to_pylist() == list(range(7))
        assert np.concatenate([r.block(k) for k in range(len(r.index))]).tolist() == np.concatenate(texts).tolist()
    (tmp_path / "g").write_bytes(b"x" * 100)
    with pa.fs.LocalFileSystem().open_input_file(str(tmp_path / "g")) as source, pytest.raises(ValueError):
        Reader(source)


def test_piece_encoder():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, texts = tokenizer(path), odd_texts(600)
    got = encoder(path, 2)(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_piece_table(monkeypatch):
    """Pieces that are known need no step of Python each; a table that is full forgets, and gives the same ids again."""
    import pyarrow as pa

    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizer(path)
    texts = [*odd_texts(200), None, "", " \t\n ", "a\x0bb\x0cc d", "The THE the, \x85Ä\xa0ä", *(f"w{i} v{i % 7}" for i in range(300))]
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
    encode = encoder.__wrapped__(path, 2)
    plain = [np.frombuffer(b, "<u4").tolist() for b in encode(texts)]
    monkeypatch.setattr(PieceEncoder, "learn", lambda *_: pytest.fail("these pieces were known"))
    again = [np.frombuffer(b, "<u4").tolist() for b in encode(pa.array(texts))]
    assert plain == again == want and encode([]) == []
    monkeypatch.undo()
    table = PieceTable(path, 2, most=40)
    for _ in range(2):
        for x, ids in zip(texts, want, strict=True):
            rows = table.rows(split_pieces(pa.array([x or ""], pa.large_string()))[1])
            assert table.ids_of(np.append(rows, 0)).tolist() == ids
            table.age()
            assert len(table.names) <= 40


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello big  world", " lead", "tail ", "a\n\nB <|endoftext|> c", "", None, "ÜBER \u00a0 x" * 50]
    t = tokenizer(path)
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids + [7], "<u4").tobytes() for x in texts]
    assert encoder(path, 7)(texts) == want and encoder(path, 7)(pa.array(texts)) == want


def test_special_tokens_in_mixed_case(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizer(path)
    texts = ["a <|ENDOFTEXT|> b", "A<|EndOfText|>B <|endoftext|>C", "<|StartOfText|>", "X<|startoftext|>É", "One <| TWO |> <|ENDOFTEXT|>\x1c<|endoftext|> Ä", "中 <|ENDOFTEXT|> B", "PLAIN Text."]
    want = [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder(path, 2)(texts)] == want
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in store_and_read(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: (sum(map(len, want[:i])), len(x), zlib.crc32(struct.pack(f"<{len(x)}I", *x))) for i, x in enumerate(want)}


def test_token_store(docs, rows, empty):
    t = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in store_and_read(docs).collect()), key=lambda r: r[0])
    ids = {}
    for i, text, *_ in rows:
        ids.setdefault(i, []).append([*t.encode(text or "", add_special_tokens=False).ids, 2])
    start = 0
    for s, i, n, crc in got:
        assert s == start
        start += n
        own = next(x for x in ids[i] if len(x) == n and zlib.crc32(struct.pack(f"<{n}I", *x)) == crc)
        ids[i].remove(own)
    assert not any(ids.values())
    order = [i for _, i, _, _ in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and store_and_read(empty).count() == 0


# Language


def test_languages(spark, docs, empty):
    import pathlib

    sf = pathlib.Path("/root/testdata/sf0.01")
    d = spark.read.parquet(str(sf / "documents.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_languages(d.where(~held))
    got = identify_languages(d.where(held), model, keep=("lang",)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.95
    odd = {r["doc_id"]: r for r in identify_languages(docs, model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (200, 201, 202))
    assert identify_languages(empty, model).count() == 0
    nothing = fit_languages(empty)
    assert {r["lang_pred"] for r in identify_languages(docs, nothing).collect()} == {"und"}


def test_every_language_is_learned(spark):
    rows = [(i, f"text number {i} of its own language {chr(0x4E00 + i)} " * 3, f"l{i:03}", "a", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    assert len(fit_languages(docs).dictionaries) == 300
    with pytest.raises(ValueError, match="more than 2 languages"):
        fit_languages(docs, model_bytes=100_000)


@pytest.mark.parametrize("length", [255, 511, 512, 513, 4095, 4096, 4097, 9000])
def test_one_rule_for_texts_of_any_length(length):
    """Blocks are sized one by one and added up, below and above what used to be a border."""
    rng = random.Random(length)
    model = LanguageModel({g: " ".join(rng.choice(w) for _ in range(900)).encode() for g, w in (("a", ["the", "and", "then", "of"]), ("b", ["der", "und", "dann", "von"]))})
    names, encoders = model.encoders()
    text = (" ".join(rng.choice(["the", "und", "then", "von", "x"]) for _ in range(length)))[:length]
    parts = [text[i : i + model.block].encode() for i in range(0, length, model.block)]
    sizes = [sum(len(e.compress(model.dictionaries[n][-model.lead :] + b)) for b in parts) for n, e in zip(names, encoders, strict=True)]
    lang, _, margin = classify(text, names, encoders, model)
    low, high = sorted(sizes)
    assert lang == names[sizes.index(low)] and margin == (high - low) / high


def test_classify():
    m = LanguageModel({"a": b"the cat sat on the mat and the dog " * 30, "b": b"le chat est sur le tapis et le chien " * 30})
    names, encoders = m.encoders()
    for text, want in (("The cat and the DOG", "a"), ("le chat et le chien", "b"), ("le chat est sur le tapis " * 500, "b"), ("123 !!", "und"), (None, "und")):
        assert classify(text, names, encoders, m)[0] == want


def test_languages_by_definition(spark):
    """Every prediction and score against sizes from fresh compressors, one dictionary and one block at a time."""
    import math

    import zstandard

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = fit_languages(d)
    texts = {r["doc_id"]: r["text"] for r in d.collect()} | {-1: "123 !", -2: None, -3: "A", -4: "Straße ÄÖ " * 900}
    got = identify_languages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    form = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY, min_match=4, search_log=4, hash_log=16, chain_log=16, window_log=17, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(lang, block):
        told = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        told.precompute_compress(compression_params=form)
        return len(zstandard.ZstdCompressor(dict_data=told, compression_params=form).compress(block))

    for r in got:
        text = texts[r["doc_id"]]
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        raw = text.lower().encode()
        blocks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
        sizes = {g: sum(size(g, model.dictionaries[g][-256:] + b) for b in blocks) for g in model.dictionaries}
        best = min(sizes, key=lambda g: (sizes[g], g))
        assert r["lang_pred"] == best
        assert r["score"] == pytest.approx(1 / sum(math.exp(-min(700, (s - sizes[best]) / 4)) for s in sizes.values()))
        second = sorted(sizes.values())[1]
        assert r["rejected"] == ((second - sizes[best]) / second < model.min_margin)


def test_languages_learn_from_few_rows(spark):
    rows = [(7, "the very same text", "en")] * 500 + [(8, f"le chat {i}", "fr") for i in range(30)] + [(i, "x y z", f"l{i}") for i in range(100, 140)] + [(1, None, "en"), (2, "t", None), (None, "no id", "en")]
    model = fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.dictionaries) == ["en", "fr", *[f"l{i}" for i in range(100, 140)]]
    assert model.dictionaries["en"].count(b"same text") == 1  # repeated rows count as one


# Near-duplicates


def components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, rows, k, percent, empty):
    rng = random.Random(9)
    base = words(rng, 120, 10**6).split()
    near = []
    for i in range(150):  # copies with up to 14 changes: most pairs of them aren't links
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 10**6)}"
        near.append((2000 + i, " ".join(w)))
    table = [(i, t) for i, t, *_ in rows] + near + [(5000 + i, "The same old text with a few words") for i in range(300)] + [(6000 + i, f"w1 w2 w3 w4 w5 w6 w7 w8{' w9' * i}") for i in range(4)]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("set", F.lit(1))
    got = near_duplicates(df, shingle_words=k, percent=percent).collect()
    want = components([r for r in table if r[0] is not None], k, percent)
    assert len(got) == len(table)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    assert near_duplicates(empty).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(6)
    for j in (0.3, 0.6, 0.85, 0.95):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * j * 2 / (1 + j))
        pairs = [(np.unique(a), np.unique(np.concatenate((a[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64))))) for _ in range(30)]
        x, y = (sketch([p[i] for p in pairs]) for i in (0, 1))
        size = np.array([[len(u), len(v)] for u, v in pairs], float)
        assert abs(estimate(x, y, size[:, 0], size[:, 1]).mean() - j) < 0.03
        union = sketch([np.union1d(u, v) for u, v in pairs])
        assert (union == np.maximum(x, y)).all()  # sketches merge
    assert len(shingles("a b", 3, {b"a": 1, b"b": 2})) == 1 and len(shingles("", 3, {})) == 0


def test_pairs_at_the_threshold_share_a_band():
    for percent in range(12, 100):
        rows, bands = banding(percent)
        assert rows * bands <= M and (1 - (percent / 100) ** rows) ** bands < 1e-6
    rng = np.random.default_rng(7)
    rows, bands = banding(80)
    for _ in range(20):  # 100,000 pairs that share 8 of 10 elements; of 24 bands of 5 registers some 6 of them shared none
        x = rng.integers(0, 2**64, (5000, 10), np.uint64)
        a, b = (sketch([s for s in np.sort(x[:, c], axis=1)])[:, : rows * bands].reshape(5000, bands, rows) for c in (list(range(9)), [*range(8), 9]))
        assert (a == b).all(2).any(1).all()


def test_blocks_compare_whole_hashes(spark):
    rng = np.random.default_rng(8)
    e = np.unique(rng.integers(0, 2**64, 40, np.uint64))
    twin = lambda h: h ^ np.uint64(1)  # noqa: E731 - the same upper 32 bits
    # 1 and 2: 8 of 10, two of the shared ones alike in 32 bits; 3 and 4: 7 of 9, the own ones alike in 32 bits
    sets = {1: [*e[:7], twin(e[0]), e[7]], 2: [*e[:7], twin(e[0]), e[8]], 3: [*e[20:27], e[27]], 4: [*e[20:27], twin(e[27])]}
    sets = {i: np.sort(np.array(s, np.uint64)) for i, s in sets.items()}
    regs = dict(zip(sets, sketch(list(sets.values())), strict=True))
    rows = [(1, True, 0, i, len(s), i, regs[i].tobytes(), s.tobytes()) for i, s in sets.items()]
    members = spark.createDataFrame(rows, "task long, same boolean, side int, id long, n long, label long, regs binary, set binary")
    assert {tuple(r) for r in _across(members, 80).collect()} == {(1, 2)}


# Packing


def test_best_fit():
    rng = random.Random(2)
    sizes = [rng.randint(1, 250) for _ in range(400)]
    sources = [rng.choice("aaab") for _ in sizes]
    clusters = [rng.choice([None, 1, 2, 3, 1000 + i, 1000 + i, 1000 + i]) for i in range(len(sizes))]
    got = pack_shard(sizes, sources, clusters, 100, 2)
    # brute force: largest first into the tightest bin without conflict, the earliest of equally tight ones by when it got its room
    bins, want = [], []
    full = 0
    for d, s in enumerate(sizes):
        for p in range(s // 100):
            want.append((d, p, p * 100, 100, full, 0))
            full += 1
    clock = 0
    for d in sorted(range(len(sizes)), key=lambda d: (-(sizes[d] % 100), d)):
        left = sizes[d] % 100
        if not left:
            continue
        fits = [b for b in bins if b["room"] >= left and b["sources"].count(sources[d]) < 2 and (clusters[d] is None or clusters[d] not in b["clusters"])]
        clock += 1
        if fits:
            b = min(fits, key=lambda b: (b["room"], b["since"]))
        else:
            b = {"room": 100, "sources": [], "clusters": [], "no": full + len(bins)}
            bins.append(b)
        want.append((d, sizes[d] // 100, sizes[d] // 100 * 100, left, b["no"], 100 - b["room"]))
        b["room"] -= left
        b["since"] = clock
        b["sources"].append(sources[d])
        b["clusters"].append(clusters[d])
    assert sorted(got) == sorted(want)


def test_pack(docs, rows, empty):
    got = pack(docs, capacity=128, shard_docs=64).toPandas()
    count = {}
    for i, t, *_ in rows:
        count.setdefault(i, []).append(len((t or "").split()))
    sums = got.assign(doc_id=got["doc_id"].fillna(-1)).groupby("doc_id")["n_words"].sum()
    assert all(sums[-1 if i is None else i] == sum(n) for i, n in count.items())
    bins = got.dropna(subset=["bin"]).sort_values(["bin", "bin_offset"])
    assert bins.groupby("bin")["n_words"].sum().max() <= 128
    assert (bins.groupby("bin")["n_words"].cumsum() - bins["n_words"] == bins["bin_offset"]).all()
    assert got[got["n_words"] == 0]["bin"].isna().all()
    # one of a cluster of equal texts and two of a source in a bin, at most; full pieces are alone
    text, source = {}, {}
    for i, t, _, s, _ in rows:
        text[i], source[i] = t, s
    shared = bins[bins["n_words"] < 128].assign(doc_id=bins["doc_id"].fillna(-1))
    own = [None if i == -1 else int(i) for i in shared["doc_id"]]
    shared = shared.assign(text=[text[i] for i in own], source=[str(source[i]) for i in own])
    shared = shared[shared["doc_id"] != -1]  # two rows share the null id here
    assert shared.groupby(["bin", "text"]).size().max() == 1 and shared.groupby(["bin", "source"]).size().max() <= 2
    again = pack(docs.repartition(5), capacity=128, shard_docs=64).toPandas()
    key = list(got.columns)
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), again.sort_values(key).reset_index(drop=True))
    assert pack(empty).count() == 0


def test_pack_deals_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", "s")] * 600 + [(2, "d e", None)] * 30 + [(i, f"w{i} " * 5, "t") for i in range(10, 40)], "doc_id long, text string, source string").repartition(7)
    got = pack(df, capacity=16, shard_docs=64).toPandas()
    assert len(got) == 660 and got["n_words"].sum() == 600 * 3 + 30 * 2 + 30 * 5
    shards = (got["bin"].astype("int64") // 2**32).value_counts()
    assert len(shards) == 11 and shards.max() < 150  # the copies of one row are in all shards
    assert got.groupby("bin")["n_words"].sum().max() <= 16
    assert got.groupby(["bin", "doc_id"]).size().max() == 1  # copies never meet
    # the clusters that a caller names
    near = df.withColumn("k", F.when(F.col("doc_id") < 30, 7))
    packed = pack(near, cluster_col="k", capacity=16, shard_docs=10**6).toPandas()
    assert packed[packed["doc_id"] < 30].groupby("bin").size().max() == 1 < packed.groupby("bin").size().max()


# Nearest neighbours


def test_hilbert():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        walk = cells[np.argsort(keys)]
        assert sorted(keys.tolist()) == list(range(len(cells))) and set(np.abs(np.diff(walk, axis=0)).sum(1).tolist()) == {1}


def test_nearest(embeddings):
    more = embeddings.sparkSession.createDataFrame([(100, [9.0] * 8), (7, [0.5] * 8), (7, [0.5] * 8), (1400, [1.0, 2.5]), (1500, [4.0, 2.5])], "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    table = embeddings.union(more)
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.where("(vec_id < 400 and vec_id >= 0) or vec_id between 1300 and 1500").collect()]
    for options in ({}, {"task_rows": 16, "task_queries": 1}):  # ranges that are dealt further, by rows and by queries
        got = lists(nearest(table, **options).collect(), "rank", "score", "vec_id")
        assert set(got) == {0, 100, 200, 300, 1300, 1400, 1500}
        hit = all_ = 0
        for i, (q, x) in enumerate(rows):
            if q % 100 == 0:
                best = sorted((np.sqrt(((v - x) ** 2).sum()), j) for n, (j, v) in enumerate(rows) if n != i and len(v) == len(x))[:10]
                found = [(s, j) for _, s, j in got[q]]
                hit += len({(round(s, 9), j) for s, j in best} & {(round(s, 9), j) for s, j in found})
                all_ += len(best)
        assert hit >= 0.9 * all_
        assert [r[2] for r in got[1300]] == [1400, 1500] and [r[2] for r in got[1400]] == [1300, 1500]
        assert len(got[200]) == 20 and {r[1] for r in got[200][:2]} == {0.0}  # a repeated row: two lists, each with the other first
    assert nearest(embeddings.limit(0)).count() == 0
    assert nearest(embeddings.where("vec_id in (100, 101)")).count() == 1


def recall_of(spark, x, **options):
    """Recall against brute force of 1 in 100 rows."""
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.astype("f4").ravel(), x.shape[1]).cast(pa.list_(pa.float32()))}))
    got = nearest(df, **options).toPandas().groupby("query_id")["vec_id"].apply(set)
    x, hits = x.astype("f4").astype(float), 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.lexsort((np.arange(len(x)), d))[:10].tolist()))
    return hits / (10 * len(range(0, len(x), 100)))


def test_recall_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas().sort_values("vec_id")
    assert recall_of(spark, np.stack(df["embedding"])) >= 0.9


def test_recall_and_work_on_many_rows(spark):
    """50,000 rows without structure, and 50,000 in clusters, whose windows must be a small share of the table."""
    rng = np.random.default_rng(12)
    flat = rng.normal(size=(50_000, 32))
    assert recall_of(spark, flat / np.sqrt((flat**2).sum(1))[:, None]) >= 0.9
    clusters = rng.normal(size=(500, 32))[rng.integers(0, 500, 50_000)] + rng.normal(size=(50_000, 32)) * 0.05
    assert recall_of(spark, clusters) >= 0.9
    sample = clusters[:5000]
    curves = Curves.fit(sample, 12, 4, 10, 64)
    used, reach, _ = window_plan(curves, sample, 64, 10, 0.95)
    assert used >= 2 and used * (2 * reach + 1) / 64 < 0.5


# SQL, and the pipeline


@pytest.mark.parametrize("name", sorted(set(Q.oracle_sql()) - set(corpus_queries.oracle_sql())))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = Q.queries()[name](spark, sf).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    order = sorted(got.columns)
    text = lambda df: sorted(str([None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else v for v in row]) for row in df[order].itertuples(index=False))
    assert text(got) == text(want)


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == P.COLUMNS
        kept[name] = docs.select("doc_id").toPandas()["doc_id"].tolist()
    assert set(kept["language_id"]) >= set(kept["quality"]) >= set(kept["near_dedup"]) >= set(kept["source_mix"])
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    label = components([(i, texts[i]) for i in kept["quality"]], 5, 80)
    assert sorted(kept["near_dedup"]) == sorted(i for i in kept["quality"] if label[i] == i)
    assert max(pd.Series(kept["source_mix"]).value_counts()) <= 3
    packed = P.STAGES[-1][1](spark, docs, sf).toPandas()
    assert packed["n_words"].sum() == sum(len(texts[i].split()) for i in kept["source_mix"])
    clash = packed[packed["n_words"] > 0].groupby(["bin", "doc_id"])["piece"].apply(lambda p: p.value_counts().max())
    assert clash.max() == 1


def test_pipeline_run(spark, tmp_path):
    """run() on documents with nulls, repeats, an empty text and clashing columns, and on an empty table, against the
    stages one after another by brute force where they have a form for it."""
    import corpus_pipeline as P

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    first = base.orderBy("doc_id").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (90001, None, "en", "a", 0), (90002, "", "en", "a", 0), (None, first.collect()[3]["text"], "en", None, 1)], base.schema)
    table = base.union(first).union(odd).withColumn("score", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("_row", F.lit(2))
    table.write.parquet(str(tmp_path / "a/documents.parquet"))
    labels.unionByName(spark.createDataFrame([(None, 1, 0), (777777, None, None)], labels.schema)).write.parquet(str(tmp_path / "a/labels.parquet"))
    got = P.run(spark, str(tmp_path / "a")).toPandas()
    again = P.run(spark, str(tmp_path / "a")).toPandas()
    key = list(got.columns)
    assert len(got) and got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    texts = {r["doc_id"]: r["text"] for r in base.select("doc_id", "text").collect()}
    whole = got[got["doc_id"].notna()].groupby("doc_id")["n_words"].sum()
    assert all(w % len(texts[int(i)].split()) == 0 and 1 <= w // len(texts[int(i)].split()) <= 3 for i, w in whole.items())  # each kept document whole, three times at most
    assert not {90001, 90002} & set(whole.index)
    docs = spark.read.parquet(str(tmp_path / "a/documents.parquet"))
    kept = P.near_dedup(spark, docs, "").toPandas()
    label = components([(i, t) for i, t in texts.items()] + [(90001, None), (90002, "")], 5, 80)
    assert sorted(kept["doc_id"].dropna().astype(int)) == sorted(i for i in label if label[i] == i) and kept["doc_id"].isna().sum() == 2
    table.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "b/labels.parquet"))
    nothing = P.run(spark, str(tmp_path / "b"))
    assert nothing.count() == 0 and nothing.columns == key
    docs = spark.read.parquet(str(tmp_path / "b/documents.parquet"))
    for _, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path / "b")).count() == 0
