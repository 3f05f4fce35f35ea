"""Approximate nearest neighbours by several shifted Hilbert orderings.

Each ordering projects the vectors to `dims` random directions, shifts them by a random offset and takes their place on a
Hilbert curve. Every ordering is range-partitioned into `blocks` ranges of keys (quantiles of a bounded sample). A query
meets all vectors of its own range and of `reach` ranges on either side, in every ordering; what the windows find is merged
and ranked by the exact distance on the original vectors.

Windows are shares of the table, not numbers of rows, because that is what recall depends on. How many orderings and how
wide a window a table needs is measured on the sample: of all pairs (at least two orderings) under which the sample's own
windows hold `recall` of its true neighbours, the one that meets the fewest vectors is taken. Clustered vectors need a few
narrow windows; vectors without structure, which no low-dimensional order separates, need windows that together are about
the table.

A key that recurs takes one range, not several empty ones beside it, and no range is planned for fewer than 4 * k rows.
Ranges with more than `task_rows` rows, and those that more than `task_queries` queries meet, are dealt further by hash, so
no task grows with the table, with the number of queries, or with a vector that recurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.ball_tree import usable
from waymark.llm.common import batched, cut, runs, small, written
from waymark.llm.hilbert import hilbert_keys


@dataclass
class Curves:
    """origin, spread: of the projections; directions: curves x dimensions of the vectors x dims; shifts; splits of the keys."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray
    shifts: np.ndarray
    splits: list[np.ndarray]
    bits: int

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int, dims: int, bits: int, blocks: int, seed: int = 3) -> Curves:
        rng, d = np.random.default_rng(seed), sample.shape[1]
        dims = min(dims, d)
        directions = np.stack([np.linalg.qr(rng.normal(size=(d, d)))[0][:, :dims] for _ in range(curves)])
        p = np.einsum("nd,cdk->cnk", sample, directions)
        out = cls(directions, p.min(1), p.max(1), rng.random((curves, dims)), [], bits)
        keys = np.sort(out.keys(sample), 1)
        out.splits = [np.unique(k[[len(sample) * b // blocks for b in range(1, blocks)]]) for k in keys]
        return out

    def keys(self, x: np.ndarray) -> np.ndarray:
        """curves x points."""
        out = np.empty((len(self.directions), len(x)), np.uint64)
        for c, way in enumerate(self.directions):
            span = np.where(self.high[c] > self.low[c], self.high[c] - self.low[c], 1)
            u = np.clip((x @ way - self.low[c]) / span, 0, 1) / 2 + self.shifts[c] / 2
            out[c] = hilbert_keys(np.minimum((u * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1), self.bits)
        return out

    def blocks(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(s, k, side="right") for s, k in zip(self.splits, self.keys(x), strict=True)])

    def first(self, curves: int) -> Curves:
        return Curves(self.directions[:curves], self.low[:curves], self.high[:curves], self.shifts[:curves], self.splits[:curves], self.bits)


def window_plan(curves: Curves, sample: np.ndarray, blocks: int, k: int, recall: float, queries: int = 400) -> tuple[int, int, float]:
    """(orderings, reach, recall on the sample) at the least share of the table that windows meet. The last reach is the
    whole table, so there is always one."""
    asked = np.unique(np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int))
    at = curves.blocks(sample)
    squares, steps = (sample**2).sum(1), []
    for i in asked:
        away = squares - 2 * (sample @ sample[i])
        away[i] = np.inf
        near = np.argpartition(away, min(k, len(sample) - 1) - 1)[:k] if len(sample) > 1 else np.array([i])
        steps.append(np.abs(at[:, near] - at[:, [i]]).T)
    steps = np.minimum.accumulate(np.concatenate(steps), axis=1)  # of each neighbour, the least step in the first c orderings
    b, best = np.arange(blocks), None
    for reach in range(blocks):
        share = (np.minimum(blocks - 1, b + reach) - np.maximum(0, b - reach) + 1).mean() / blocks
        held = (steps <= reach).mean(0)
        for c in range(min(2, len(at)), len(at) + 1):
            if held[c - 1] >= recall and (best is None or c * share < best[0]):
                best = (c * share, c, reach, float(held[c - 1]))
    return best[1:]


def closest(x: np.ndarray, squares: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, own: int, products: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in x, distances) of the k nearest to q, ties to the smaller id, the row `own` left out. products: x . q.
    Expanded squares find who can be among them, differences their distances."""
    about = squares - 2 * products
    margin = 1e-9 * (float(np.abs(squares).max()) + float(q @ q))
    most = k + 1  # the query itself may be one
    near = np.arange(len(x)) if len(x) <= most else np.flatnonzero(about <= np.partition(about, most - 1)[most - 1] + margin)
    near = near[rows[near] != own]
    away = np.sqrt(((x[near] - q) ** 2).sum(1))
    best = np.lexsort((ids[near], away))[:k]
    return near[best], away[best]


def nearest(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", curves: int = 12, dims: int = 4, bits: int = 10, blocks: int = 64, recall: float = 0.95, sample_rows: int = 20_000, task_rows: int = 8192, task_queries: int = 65_536, seed: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row whose id is divisible by `every` the k nearest rows found by
    Euclidean distance in double precision, nearest first, ties to the smaller id, the row itself left out.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows with a null id.
    Every other row is a candidate, also one that repeats an id, the query's own or another's; and every row with a
    divisible id is a query, so rows that repeat such an id give as many lists. Vectors are near only to those of the same
    length; orderings are fitted for the sample's most frequent length, vectors of other lengths meet all of theirs.
    Other columns are ignored; an empty table gives an empty table. The orderings (at most `curves`), their ranges and the
    windows are fitted on at most 2 * sample_rows vectors; every row is indexed.
    """
    spark, v = df.sparkSession, F.col(vector_col)
    batched(spark, 4096, 32 << 20)
    nonzero = F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.where(F.col(id_col).isNotNull() & usable(v) & nonzero).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "vectors")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = max(1, min(blocks, n // (4 * k)))
    share = F.xxhash64("id", "v") <= F.lit(min(2**63 - 1, int(-(2**63) + min(1.0, sample_rows / n) * 2**64)))
    picked = rows.where(share).orderBy("id", "row").limit(2 * sample_rows).select("v", "dim").toArrow()
    picked = picked if picked.num_rows else rows.orderBy("id", "row").limit(1).select("v", "dim").toArrow()
    lengths = picked["dim"].to_numpy()
    d = int(np.bincount(lengths).argmax())
    sample = np.stack(picked["v"].filter(pa.array(lengths == d)).to_numpy())
    fitted = Curves.fit(sample, curves, dims, bits, blocks, seed)
    used, reach, _ = window_plan(fitted, sample, blocks, k, recall)
    told = spark.sparkContext.broadcast(fitted.first(used))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fit = np.flatnonzero(batch.column(2).to_numpy() == d)
                at: list = [[0]] * batch.num_rows
                if len(fit):
                    x = np.stack(batch.column(1).take(pa.array(fit)).to_numpy(zero_copy_only=False))
                    for i, places in zip(fit, told.value.blocks(x).T.tolist(), strict=True):
                        at[i] = places
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.list_(pa.int32()))], ["id", "v", "dim", "row", "at"])

    indexed = written(rows.mapInArrow(index, "id long, v array<double>, dim int, row long, at array<int>"), "curves")
    placed = indexed.select("id", "v", "dim", "row", F.posexplode("at").alias("curve", "block"))
    own = F.when(F.col("dim") == d, F.sequence(F.greatest(F.lit(0), F.col("block") - reach), F.least(F.lit(blocks - 1), F.col("block") + reach))).otherwise(F.array(F.lit(0)))
    asked = placed.where(F.col("id") % every == 0).withColumn("block", F.explode(own))
    key = ["dim", "curve", "block"]
    shape = placed.groupBy(*key).agg(F.ceil(F.count("*") / task_rows).cast("int").alias("parts"))
    busy = asked.groupBy(*key).agg(F.ceil(F.count("*") / task_queries).cast("int").alias("turns"))
    shape = cut(shape.join(busy, key))
    shape = small(shape)
    deal = lambda n_, s: F.pmod(F.xxhash64("row", F.lit(s)), F.col(n_)).cast("int")
    each = lambda n_: F.explode(F.sequence(F.lit(0), F.col(n_) - 1))
    points = placed.join(shape, key).withColumn("part", deal("parts", 1)).withColumn("turn", each("turns")).withColumn("kind", F.lit(0))
    asked = asked.join(shape, key).withColumn("turn", deal("turns", 2)).withColumn("part", each("parts")).withColumn("kind", F.lit(1))
    task = [*key, "part", "turn"]
    dealt = points.unionByName(asked).select(*task, "kind", "id", "row", "v").repartition(*task).sortWithinPartitions(*task, "kind", "id", "row")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by task, the points of a task (a bounded number) before its queries."""
        at, held, ready = None, [], None
        for name, part in runs(batches, *task, "kind"):
            if not name[-1]:
                if name[:-1] != at:
                    at, held = name[:-1], []
                held.append(part)
                ready = None
            elif name[:-1] == at:
                if ready is None:
                    x = np.concatenate([np.stack(p.column("v").to_numpy(zero_copy_only=False)) for p in held])
                    ready = x, (x**2).sum(1), *(np.concatenate([p.column(c).to_numpy() for p in held]) for c in ("id", "row"))
                x, squares, ids, members = ready
                found: list[list[np.ndarray]] = [[], [], [], [], []]
                q, names, own_rows = np.stack(part.column("v").to_numpy(zero_copy_only=False)), part.column("id").to_numpy(), part.column("row").to_numpy()
                for i in range(0, len(q), 256):
                    products = q[i : i + 256] @ x.T
                    for j in range(len(products)):
                        near, away = closest(x, squares, ids, members, q[i + j], own_rows[i + j], products[j], k)
                        for column, value in zip(found, (np.full(len(near), own_rows[i + j]), np.full(len(near), names[i + j]), members[near], ids[near], away), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], ["q", "query_id", "row", "vec_id", "score"])

    met = dealt.mapInArrow(meet, "q long, query_id long, row long, vec_id long, score double")
    merged = met.groupBy("q", "query_id", "row", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
