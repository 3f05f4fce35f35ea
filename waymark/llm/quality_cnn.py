"""A quality classifier: a convolutional network over bytes, in numpy.

A document is covered by overlapping chunks (the last one ends with the document). Bytes are embedded, learned filters
slide over them, each filter keeps its maximum in the chunk, and a small dense layer makes a logit of the maxima and the
chunk's length (the maxima of few windows are lower). The probabilities of all chunks, averaged, give the document's, so
that no chunk outweighs the others by being very sure. The gradient passes only through the windows that hold the maxima.

A chunk's windows are those that begin in it, every `stride` bytes, until one reaches its end; that one may hold padding,
others don't. What stands beside a chunk in a block, and so how far the block is padded, has no part in its score.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import batched, like

PAD = 256


@dataclass
class ByteCNN:
    """embed: 257 x e (row 256: padding), filters: (width * e) x f, bias: f, dense: (f + 2) x h for the maxima, the length
    and 1, head: h, out: the last bias."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    head: np.ndarray
    out: float
    width: int = 8
    chunk: int = 1024
    overlap: int = 64
    stride: int = 2

    @classmethod
    def fresh(cls, seed: int = 7, e: int = 8, f: int = 16, h: int = 12, **shape) -> ByteCNN:
        rng, width = np.random.default_rng(seed), shape.get("width", 8)
        return cls(rng.normal(0, 0.5, (257, e)).astype("f4"), rng.normal(0, (width * e) ** -0.5, (width * e, f)).astype("f4"), np.zeros(f, "f4"), rng.normal(0, f**-0.5, (f + 2, h)).astype("f4"), rng.normal(0, h**-0.5, h).astype("f4"), 0.0, **shape)

    def starts(self, n: int) -> list[int]:
        """Where the chunks of n bytes begin."""
        if n <= self.chunk:
            return [0]
        return [*range(0, n - self.chunk, self.chunk - self.overlap), n - self.chunk]

    def window_counts(self, lengths: np.ndarray) -> np.ndarray:
        """How many windows chunks of these lengths have."""
        return 1 + -(-np.maximum(lengths - self.width, 0) // self.stride)

    def block(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        """chunks x bytes as ids, padded to the last window of the longest."""
        lengths = np.array([len(r) for r in rows], np.int64)
        x = np.full((len(rows), self.width + self.stride * (int(self.window_counts(lengths).max(initial=1)) - 1)), PAD, np.int16)
        for k, row in enumerate(rows):
            x[k, : len(row)] = row
        return x

    def _windows(self, x: np.ndarray) -> np.ndarray:
        e = self.embed[x]
        w = np.lib.stride_tricks.sliding_window_view(e, self.width, 1)[:, :: self.stride]
        return np.ascontiguousarray(w.transpose(0, 1, 3, 2)).reshape(*w.shape[:2], -1)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """chunks x windows x filters; minus infinity where a chunk has no window."""
        a = self._windows(x) @ self.filters
        counts = self.window_counts((x != PAD).sum(1))
        if counts.min(initial=a.shape[1]) < a.shape[1]:
            a[np.arange(a.shape[1]) >= counts[:, None]] = -np.inf
        return a

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(maxima of the filters over each chunk, where they stand)."""
        a = self.responses(x)
        at = a.argmax(1)
        return np.maximum(np.take_along_axis(a, at[:, None], 1)[:, 0] + self.bias, 0), at

    @staticmethod
    def features(pooled: np.ndarray, x: np.ndarray) -> np.ndarray:
        length = np.log2((x != PAD).sum(1) + 1).astype("f4") / 5 - 1
        return np.column_stack([pooled, length, np.ones(len(x), "f4")])

    def logits(self, x: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(x).max(1) + self.bias, 0)
        return np.maximum(self.features(pooled, x) @ self.dense, 0) @ self.head + self.out

    def scores(self, texts: Sequence[str | None], block: int = 32) -> np.ndarray:
        """Per text the probability of label 1; 0 for null and empty texts. block: chunks in memory at once."""
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        total, count = np.zeros(len(raws)), np.zeros(len(raws))
        # chunks of like lengths together: short documents aren't padded to the longest
        spans = sorted(((min(len(r) - s, self.chunk), k, s) for k, r in enumerate(raws) if r for s in self.starts(len(r))), key=lambda t: t[0])
        for i in range(0, len(spans), block):
            part = spans[i : i + block]
            x = self.block([np.frombuffer(raws[k], np.uint8, n, s) for n, k, s in part])
            owner = [k for _, k, _ in part]
            with np.errstate(over="ignore"):
                np.add.at(total, owner, 1 / (1 + np.exp(-self.logits(x).astype(np.float64))))
            np.add.at(count, owner, 1)
        return total / np.maximum(count, 1)


def fit_network(texts: Sequence[str | Sequence[str]], labels: Sequence[int], prior: float = 0.5, epochs: int = 10, rate: float = 0.01, chunks_per_text: int = 2, batch: int = 64, seed: int = 7, **shape) -> ByteCNN:
    """Adam on the cross-entropy of single chunks, drawn anew from each text (or from the passages that stand for one) in
    each epoch, half of them cut to a random length; each carries its text's label. The classes weigh as prior (of label 1)
    says, however many texts there are. Without texts, or with one class only, the network answers one half, or that class."""
    net, rng = ByteCNN.fresh(seed, **shape), np.random.default_rng(seed)
    y = np.asarray(labels, "f4")
    if not len(y) or y.min() == y.max():
        net.head[:] = 0
        net.out = 0.0 if not len(y) else 4.0 * (2 * float(y[0]) - 1)
        return net
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())).astype("f4")
    raws = [[p.encode("utf-8", "surrogatepass") for p in ([t] if isinstance(t, str) else t)] for t in texts]
    names = ("embed", "filters", "bias", "dense", "head")
    m = {n: np.zeros_like(getattr(net, n)) for n in names} | {"out": 0.0}
    v = {n: np.zeros_like(getattr(net, n)) for n in names} | {"out": 0.0}
    step = 0
    for _ in range(epochs):
        picks = []
        for k, passages in enumerate(raws):
            spots = [(k, p, i) for p, raw in enumerate(passages) for i in net.starts(len(raw))]
            picks += [spots[i] for i in rng.choice(len(spots), min(chunks_per_text, len(spots)), replace=False)]
        picks = [picks[i] for i in rng.permutation(len(picks))]
        for first in range(0, len(picks), batch):
            part = picks[first : first + batch]
            rows = []
            for k, p, s in part:
                b = np.frombuffer(raws[k][p], np.uint8)[s : s + net.chunk]
                if rng.random() < 0.5 and len(b) > 16:
                    n = int(16 * (len(b) / 16) ** rng.random())
                    b = b[(i := int(rng.integers(0, len(b) - n + 1))) : i + n]
                rows.append(b)
            x = net.block(rows)
            pooled, at = net.pooled(x)
            f = net.features(pooled, x)
            h = np.maximum(f @ net.dense, 0)
            z = h @ net.head + net.out
            own = [k for k, _, _ in part]
            d = (1 / (1 + np.exp(-z)) - y[own]) * weight[own] / len(part)
            g = {"head": h.T @ d + 1e-4 * net.head, "out": float(d.sum())}
            dh = (d[:, None] * net.head) * (h > 0)
            g["dense"] = f.T @ dh + 1e-4 * net.dense
            da = (dh @ net.dense[:-2].T) * (pooled > 0)  # chunk x filter
            g["bias"] = da.sum(0)
            where = (at * net.stride)[:, :, None] + np.arange(net.width)  # chunk x filter x width
            ids = np.take_along_axis(x[:, None, :], where.reshape(len(part), 1, -1), 2).reshape(where.shape)
            seen = net.embed[ids].reshape(*at.shape, -1)
            g["filters"] = np.einsum("nf,nfw->wf", da, seen)
            de = np.einsum("nf,wf->nfw", da, net.filters).reshape(*where.shape, -1)
            g["embed"] = np.zeros_like(net.embed)
            np.add.at(g["embed"], ids.ravel(), de.reshape(-1, de.shape[-1]))
            step += 1
            for n in (*names, "out"):
                m[n] = 0.9 * m[n] + 0.1 * g[n]
                v[n] = 0.999 * v[n] + 0.001 * g[n] ** 2
                setattr(net, n, getattr(net, n) - rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8))
    return net


def passages(text: Column, count: int, chars: int) -> Column:
    """The whole text in passages of `chars` characters where `count` of them hold it, else count passages evenly spread
    over it, the first at its beginning and the last at its end."""
    n = F.char_length(text)
    whole = F.transform(F.sequence(F.lit(0), F.ceil(n / chars).cast("int") - 1), lambda i: F.substring(text, i * chars + 1, F.lit(chars)))
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substring(text, F.floor(i.cast("long") * (n - chars) / (count - 1)).cast("int") + 1, F.lit(chars)))
    return F.when(n <= count * chars, whole).otherwise(spread)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 800, text_passages: int = 16, passage_chars: int = 1024, **options) -> ByteCNN:
    """A network from a bounded sample: about per_class labelled documents of either class (those with the smallest
    hashes of their id). A text of more than text_passages * passage_chars characters is sampled by as many passages spread
    over the whole of it. Null labels, ids and texts are passed over, empty texts too; of repeated ids the smallest label
    and one of the texts count (that of the smallest hash), which is settled before anything is collected. The ids of the
    sample, a bounded number, are broadcast to the texts."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y"))
    known = known.withColumn("h", F.xxhash64(F.col("_id").cast("string")))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    limit = F.lit(None).cast("long")
    for y, n in counts.items():
        limit = F.when(F.col("y") == y, F.lit(min(2**63 - 1, int(-(2**63) + min(1.0, (per_class + 64) / n) * 2**64)))).otherwise(limit)
    ids = known.where(F.col("h") <= limit)
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where("text is not null and text != ''").join(F.broadcast(ids), "_id")
    found = found.select("_id", "h", "y", F.struct(F.xxhash64("text").alias("th"), passages(F.col("text"), text_passages, passage_chars).alias("passages")).alias("t"))
    rows = found.groupBy("_id", "h", "y").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: (r["h"], r["_id"]))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_network([r["t"]["passages"] for r in rows], [r["y"] for r in rows], prior, **options)


def score_quality(df: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.7) -> DataFrame:
    """One row per row of df: id, the columns of `keep`, score (0 to 1, higher: label 1 likelier), predicted (1 from
    threshold on, else 0). Every byte of a text lies in a chunk that is scored. A row's score depends on its
    text only, not on the rows beside it. Null and empty texts score 0. Repeated rows and null ids are answered row by
    row; other columns are ignored; an empty table gives an empty table. No shuffle."""
    batched(df.sparkSession)
    told = df.sparkSession.sparkContext.broadcast(net)
    names = [id_col, *keep, "score", "predicted"]
    schema = T.StructType([like(df, id_col), *(like(df, c) for c in keep), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = told.value.scores(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype("i4"))], names)

    return df.select(F.col(text_col).alias("_text"), F.col(id_col), *(F.col(c) for c in keep)).mapInArrow(run, schema)
