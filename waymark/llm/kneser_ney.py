"""An interpolated modified Kneser-Ney bigram model of words, counted in Spark and memory-mapped by its readers.

Counting. Workers hash the words of a block of texts, count its distinct bigrams and send them, grouped by first word, to
shards. A shard adds its blocks up, writes its bigrams as one array of sorted 64-bit hashes with a byte for each count (larger
ones apart), and passes on what it knows of words: occurrences and distinct predecessors of second words, and how many
successors of first words occur once, twice, more often. These are added up by word in ranges of hashes and written as sorted
arrays too. Nothing is pruned. The number of shards follows the bytes of text; a first word that fills more than its share (found
on a sample, which decides the route of its bigrams and no count) is dealt over all shards by the second word.

    p(w | v) = (max(c(vw) - D, 0) + g(v) p(w)) / c(v),  g(v) = D1 n1(v) + D2 n2(v) + D3 n3(v)
    p(w)     = (max(a(w) - d, 0) + (d1 m1 + d2 m2 + d3 m3) / (V + 1)) / sum of a

c counts bigrams, a(w) the distinct predecessors of w, n1 to n3 the successors of v that are seen once, twice, more often, and
m1 to m3 the words with one, two, more predecessors. The discounts D and d come from the numbers of bigrams (words) seen
once to four times; where one of these is 0 they are 0.5, 1 and 1.5. p(w | v) is p(w) after a word never seen, and a word never
seen has a = 0.

Scoring. Workers take blocks of texts, look every distinct word and bigram of the block up, and add the logarithms up by
document. Look-ups are sorted, and one shard after another is mapped and let go, so a worker holds a block and pages of one
shard, whatever the size of the model. What a block reads is at most the model, and at most a page or two for each bigram;
larger blocks read less in all.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import batched, like, shared_dir, words_of, written

#: Words (bytes without white space) can't be these.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))
#: Tokens of a block, bytes of text for each shard, documents of the sample that finds frequent first words.
BLOCK, SHARD_BYTES, SAMPLE = 2_000_000, 16 << 20, 4_000


class _Words(dict):
    """Word -> 64-bit hash, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The hash of a bigram."""
    h = (v ^ (v >> np.uint64(33))) * np.uint64(0x9E3779B97F4A7C15) + w
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def split(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n ranges of 64-bit hashes each key lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def route(v: np.ndarray, w: np.ndarray, n: int, hot: np.ndarray) -> np.ndarray:
    """The shard of each bigram: by its first word, or by both where the first is one of hot (sorted)."""
    own = split(v, n)
    if len(hot):
        spread = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v
        own[spread] = split(mix(v[spread], w[spread]), n)
    return own


def distinct(keys: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and each of sums added up by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return (keys[edge], *(np.add.reduceat(s[order], edge) if len(edge) else s for s in sums))


@dataclass
class Block:
    """Texts as one stream of tokens: the words of each and an end, and the token before each (or the start)."""

    ids: list = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)
    tokens: int = 0

    def add(self, key: object, text: str | None, known: _Words) -> None:
        words = words_of(text)
        h = np.empty(len(words) + 1, np.uint64)
        h[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        h[-1] = END
        self.ids.append(key)
        self.parts.append(h)
        self.tokens += len(h)

    def stream(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, the tokens before them, and where texts begin."""
        w = np.concatenate(self.parts)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in self.parts])[:-1]))
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[starts] = START
        return v, w, starts


def blocks(batches: Iterator[pa.RecordBatch], key: str | None, most: int) -> Iterator[Block]:
    known, block = _Words(), Block()
    for batch in batches:
        keys = batch.column(key).to_pylist() if key else [None] * batch.num_rows
        for k, text in zip(keys, batch.column("text").to_pylist(), strict=True):
            block.add(k, text, known)
            if block.tokens >= most:
                yield block
                block = Block()
    if block.ids:
        yield block


def counted(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct bigrams of a block and how often it holds them, sorted by first word."""
    v, w, _ = block.stream()
    key = mix(v, w)
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    first, n = order[edge], np.diff(np.append(edge, len(key)))
    by = np.argsort(v[first], kind="stable")
    return v[first][by], w[first][by], n[by]


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """Of things seen once, twice and more often, from how many are seen once to four times."""
    if not all(seen):
        return 0.5, 1.0, 1.5
    y = seen[0] / (seen[0] + 2 * seen[1])
    return tuple(min(max(k - (k + 1) * y * seen[k] / seen[k - 1], 0.0), float(k)) for k in (1, 2, 3))


def discounted(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3).astype(np.int64)]


@dataclass(frozen=True)
class BigramModel:
    """A model on disk: folder with shards of bigrams and ranges of words, and its totals."""

    folder: str
    shards: int
    ranges: int
    hot: tuple[int, ...]
    bigram: tuple[float, float, float]
    word: tuple[float, float, float]
    #: m1, m2 and m3, the sum of a, all tokens, distinct tokens
    few: tuple[int, int, int]
    predecessors: int
    tokens: int
    types: int

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c, a and g of sorted keys; 0 where a word isn't known."""
        c, a, g = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys))
        edges = np.searchsorted(split(keys, self.ranges), np.arange(self.ranges + 1))
        for s in np.flatnonzero(np.diff(edges)):
            part = slice(edges[s], edges[s + 1])
            table = mapped(self.folder, f"words-{s}")
            if table is not None:
                at = np.minimum(np.searchsorted(table["key"], keys[part]), len(table) - 1)
                hit = table["key"][at] == keys[part]
                for out, name in ((c, "c"), (a, "a"), (g, "g")):
                    out[part] = np.where(hit, table[name][at], 0)
        return c, a, g

    def bigrams(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """c of distinct bigrams; 0 where one isn't known."""
        out, key, shard = np.zeros(len(v), np.int64), mix(v, w), route(v, w, self.shards, np.array(self.hot, np.uint64))
        order = np.argsort(shard, kind="stable")
        edges = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            part = order[edges[s] : edges[s + 1]]
            part = part[np.argsort(key[part])]
            table, n = mapped(self.folder, f"bigrams-{s}"), mapped(self.folder, f"counts-{s}")
            if table is not None:
                at = np.minimum(np.searchsorted(table, key[part]), len(table) - 1)
                found = np.where(table[at] == key[part], n[at].astype(np.int64), 0)
                if (often := found == 255).any():
                    many = mapped(self.folder, f"many-{s}")
                    found[often] = many[1][np.searchsorted(many[0], key[part][often])]
                out[part] = found
        return out

    def score(self, block: Block) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, the base score and the score."""
        v, w, starts = block.stream()
        known, at = np.unique(np.append(w, START), return_inverse=True)
        c, a, g = self.words(known)
        base = np.log10((c + 1) / (self.tokens + self.types + 1))
        lower = np.full(len(known), 1 / (self.types + 1))
        if self.predecessors:
            rest = sum(d * m for d, m in zip(self.word, self.few, strict=True)) / (self.types + 1)
            lower = (np.maximum(a - discounted(a, self.word), 0) + rest) / self.predecessors
        to, start = at[:-1].astype(np.int64), int(at[-1])
        of = np.empty_like(to)
        of[1:] = to[:-1]
        of[starts] = start
        pair, back = np.unique(of * len(known) + to, return_inverse=True)
        of, to_ = pair // len(known), pair % len(known)
        n = self.bigrams(known[of], known[to_])
        total = c[of]
        total[of == start] = c[np.searchsorted(known, END)]  # as many starts as ends
        p = lower[to_].copy()
        seen = total > 0
        p[seen] = (np.maximum(n - discounted(n, self.bigram), 0)[seen] + g[of][seen] * p[seen]) / total[seen]
        sizes = np.diff(np.append(starts, len(w)))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        add = lambda x: np.bincount(doc, weights=x, minlength=len(sizes))
        return sizes, np.bincount(doc, weights=c[to] > 0, minlength=len(sizes)).astype(np.int64), add(base[to]), add(np.log10(p)[back])


def mapped(folder: str, name: str) -> np.ndarray | None:
    """An array of the model, mapped; None where the shard is empty."""
    try:
        return np.load(f"{folder}/{name}.npy", mmap_mode="r")
    except FileNotFoundError:
        return None


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all: a task that is run again writes the same file over."""
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        np.save(f, array)
    os.replace(draft, f"{folder}/{name}.npy")


def mounted(spark: SparkSession, folder: str | None) -> str:
    """A new folder for a model, as a path: files are mapped, so it must be mounted alike on all machines."""
    at = urlparse(folder or f"{shared_dir(spark)}/language-model-{uuid.uuid4().hex}")
    if at.scheme not in ("", "file"):
        raise ValueError(f"a model is memory-mapped: give a folder that is mounted on all machines, not {at.scheme}://")
    os.makedirs(at.path, exist_ok=True)
    return at.path


_NEEDLES = "shard int, v binary, width binary, w binary, n binary"
_WORDS = "range int, key binary, c binary, a binary, n1 binary, n2 binary, n3 binary, seen array<long>"
WORD_ROW = np.dtype([("key", "u8"), ("c", "i8"), ("a", "i8"), ("g", "f8")])


def _frame(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "long": pa.int64()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _frequent(text: DataFrame, shards: int, block: int) -> tuple[int, ...]:
    """Hashes of words that, in a sample of about SAMPLE texts, begin more than a quarter of a shard's share of bigrams; at
    most 4 * shards."""
    share = max(1, -(-text.count() // SAMPLE))
    sample = text.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, None, block):
            v, n = distinct(b.stream()[0], np.ones(b.tokens, np.int64))
            often = n * 8 * shards > b.tokens
            yield _frame([(x, y) for x, y in zip(v[often].view(np.int64).tolist(), n[often].tolist(), strict=True)] + [(0, b.tokens)], "v long, n long")

    found = sample.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    least = found.where("v = 0").select((F.col("n") / (4 * shards)).alias("least"))
    rows = found.where("v <> 0").join(F.broadcast(least), F.col("n") > F.col("least")).select("v").collect()
    return tuple(sorted(r["v"] % 2**64 for r in rows))


def fit_bigrams(docs: DataFrame, text_col: str = "text", folder: str | None = None, block: int = BLOCK, shard_bytes: int = SHARD_BYTES) -> BigramModel:
    """The model of all texts of docs. Null texts are empty (an end and nothing else); repeated rows count each; words are runs of
    anything but ASCII white space, A-Z lower-cased. Without a row every token is as likely as any other."""
    spark = docs.sparkSession
    batched(spark)
    folder = mounted(spark, folder)
    text = docs.select(F.col(text_col).alias("text"))
    size = text.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // shard_bytes))
    ranges = max(1, shards // 4)
    hot = _frequent(text, shards, block) if shards > 1 else ()

    def needles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_ = np.array(hot, np.uint64)
        for b in blocks(batches, None, block):
            v, w, n = counted(b)
            shard = route(v, w, shards, hot_)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for s in np.flatnonzero(np.diff(edges)):
                part = order[edges[s] : edges[s + 1]]
                first, width = distinct(v[part], np.ones(len(part), np.int64))
                rows.append((int(s), first.tobytes(), width.astype(np.uint32).tobytes(), w[part].tobytes(), n[part].astype(np.uint32).tobytes()))
            yield _frame(rows, _NEEDLES)

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                number = row["shard"]
                width = np.frombuffer(row["width"], np.uint32)
                parts.append((np.repeat(np.frombuffer(row["v"], np.uint64), width), np.frombuffer(row["w"], np.uint64), np.frombuffer(row["n"], np.uint32).astype(np.int64)))
        if number is None:
            return
        v, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        key = mix(v, w)
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        first, n = order[edge], np.add.reduceat(n[order], edge)
        key, v, w = key[first], v[first], w[first]
        save(folder, f"bigrams-{number}", key)
        save(folder, f"counts-{number}", np.minimum(n, 255).astype(np.uint8))
        if (often := n >= 255).any():
            save(folder, f"many-{number}", np.stack([key[often], n[often].astype(np.uint64)]))
        seen = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        # what is known of words: as second words, as first words
        second = distinct(w, n, np.ones(len(w), np.int64))
        before = distinct(v, *((n == k).astype(np.int64) for k in (1, 2)), (n > 2).astype(np.int64))
        rows = []
        for r in range(ranges):
            of, to = split(second[0], ranges) == r, split(before[0], ranges) == r
            keys = np.concatenate((second[0][of], before[0][to]))
            if len(keys):
                none = np.zeros(to.sum(), np.int64), np.zeros(of.sum(), np.int64)
                columns = [np.concatenate((second[k][of], none[0])) for k in (1, 2)] + [np.concatenate((none[1], before[k][to])) for k in (1, 2, 3)]
                keys, *columns = distinct(keys, *columns)
                rows.append((r, keys.tobytes(), *(x.astype(np.uint32 if x.max() < 2**32 else np.uint64).tobytes() for x in columns), seen if not rows else [0] * 4))
        yield _frame(rows, _WORDS)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                number = row["range"]
                keys = np.frombuffer(row["key"], np.uint64)
                parts.append([keys] + [np.frombuffer(row[x], f"u{len(row[x]) // len(keys)}").astype(np.int64) for x in ("c", "a", "n1", "n2", "n3")])
        if number is None:
            return
        keys, c, a, *n = distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        table = np.empty(len(keys), WORD_ROW)
        table["key"], table["c"], table["a"], table["g"] = keys, c, a, sum(d * x for d, x in zip(bigram, n, strict=True))
        save(folder, f"words-{number}", table)
        yield _frame([(int(c.sum()), int((c > 0).sum()), int(a.sum()), [int((a == k).sum()) for k in (1, 2, 3, 4)] + [int((a > 2).sum())])], "c long, types long, a long, seen array<long>")

    # one task for each shard, which writes it and says what it holds
    dealt = text.mapInArrow(needles, _NEEDLES).repartitionById(shards, "shard").mapInArrow(shard_of, _WORDS)
    known = written(dealt, "language-model-words")
    seen = known.agg(*(F.sum(F.col("seen")[k]).alias(str(k)) for k in range(4))).first()
    bigram = discounts([x or 0 for x in seen])
    totals = known.drop("seen").repartitionById(ranges, "range").mapInArrow(words, "c long, types long, a long, seen array<long>")
    t = totals.agg(F.sum("c").alias("c"), F.sum("types").alias("types"), F.sum("a").alias("a"), *(F.sum(F.col("seen")[k]).alias(str(k)) for k in range(5))).first()
    m = [t[str(k)] or 0 for k in range(5)]
    return BigramModel(folder, shards, ranges, hot, bigram, discounts(m[:4]), (m[0], m[1], m[4]), t["a"] or 0, t["c"] or 0, t["types"] or 0)


def score_texts(docs: DataFrame, model: BigramModel, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score, perplexity of each row: whole texts, an end included. Null texts are
    empty; repeated rows and null ids are scored each by its text; other columns are left behind."""
    batched(docs.sparkSession)
    schema = T.StructType([like(docs, id_col)] + [T.StructField(n, k) for n, k in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("perplexity", T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def watched() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("id").type
                yield batch

        for b in blocks(watched(), "id", block):
            n, known, base, score = model.score(b)
            yield pa.RecordBatch.from_arrays([pa.array(b.ids, kind), pa.array(n, pa.int64()), pa.array(known), pa.array([model.tokens] * len(n), pa.int64()), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(-score / n, 300.0))], [f.name for f in schema])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
