"""Exact top-k by inner product: ball-tree branch and bound per shard.

Candidates are dealt by hash into shards of bounded size, and for each shard a ball tree is built, once, and written to the
shared folder. A node bounds the inner product of q with anything in its ball by q . centre + |q| * radius. Nodes are
opened in order of this bound, and a query skips those that can't reach its kth score.

The kth score is shared: queries go through the shards in waves (of 1, 3, 12, 48, ... shards, each query beginning with
another one), and the kth best score that a query has after a wave bounds its search in all shards of the next. In a wave a
task reads a shard's tree and then the queries that come to it, a batch at a time, so it holds a shard and a batch.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import batched, cut, runs, written

LOWEST = -(2**63)


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, all components there and finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, good), F.lit(False))


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in double precision, as integers. Those beyond 2^62 are an error."""
    q = np.floor(scale * x.astype(np.float64))
    if np.abs(q).max(initial=0.0) >= 2.0**62:
        raise OverflowError("a component times the scale is beyond 2^62")
    return q.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows. Those beyond a long are an error."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2.0**62:
        return a @ b.T
    whole = a.astype(object) @ b.astype(object).T
    if whole.size and max(whole.max(), -whole.min()) >= 2**63 - 1:
        raise OverflowError("an inner product is beyond a long")
    return whole.astype(np.int64)


@dataclass
class BallTree:
    """Nodes in arrays; node 0 is the root. rows first[i]:last[i] (of the permuted points) lie in node i."""

    points: np.ndarray
    order: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    last: np.ndarray
    children: list[tuple[int, int] | None]

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = 128) -> BallTree:
        x = points.astype(np.float64)
        order = np.arange(len(x))
        spans, children, centres, radii = [(0, len(x))], [None], [], []
        k = 0
        while k < len(spans):
            i, j = spans[k]
            own = x[order[i:j]]
            centre = own.mean(0)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(away.max(initial=0.0))
            if j - i > leaf and radii[-1] > 0:
                a = own[away.argmax()]
                b = own[((own - a) ** 2).sum(1).argmax()]
                along = own @ (b - a)
                m = (j - i) // 2
                order[i:j] = order[i:j][np.argpartition(along, m)]
                children[k] = (len(spans), len(spans) + 1)
                spans += [(i, i + m), (i + m, j)]
                children += [None, None]
            k += 1
        first, last = np.array(spans).T
        return cls(points[order], order, np.array(centres), np.array(radii), first, last, children)

    def search(self, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), queries x k, best first, ties to the smaller id; LOWEST where there are fewer than k. ids, rows:
        of the points, before permutation; own: the row of each query, which doesn't find itself; floor: scores below it
        needn't be found."""
        ids, rows = ids[self.order], rows[self.order]
        q = queries.astype(np.float64)
        scores = np.full((len(q), k), LOWEST, np.int64)
        names = np.full((len(q), k), 2**63 - 1, np.int64)
        length = np.sqrt((q**2).sum(1))
        bound = q @ self.centres.T + length[:, None] * self.radii
        bound += 1e-9 * (np.abs(bound) + length[:, None] * (np.sqrt((self.centres**2).sum(1)) + self.radii)) + 1e-9  # rounding
        kth = np.maximum(floor, scores[:, -1]).astype(np.float64)
        queue = [(-bound[:, 0].max(), 0)] if len(q) else []
        while queue:
            _, node = heapq.heappop(queue)
            active = np.flatnonzero(bound[:, node] >= kth)
            if not len(active):
                continue
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-bound[active, child].max(), child))
                continue
            i, j = self.first[node], self.last[node]
            found = products(queries[active], self.points[i:j])
            found[own[active][:, None] == rows[None, i:j]] = LOWEST
            better = (found >= np.maximum(floor[active], scores[active, -1])[:, None]).any(1)
            active, found = active[better], found[better]
            s = np.concatenate((scores[active], found), 1)
            n = np.concatenate((names[active], np.broadcast_to(ids[i:j], found.shape)), 1)
            n = np.where(s == LOWEST, 2**63 - 1, n)
            best = np.lexsort((n, ~s), axis=1)[:, :k]  # ~s falls as s grows, without overflow
            scores[active] = np.take_along_axis(s, best, 1)
            names[active] = np.take_along_axis(n, best, 1)
            kth[active] = np.maximum(floor[active], scores[active, -1])
        return scores, names


def shard_trees(rows: DataFrame, shards: int, scale: float) -> DataFrame:
    """rows: dim, row, id, v -> dim, shard, tree: of each shard the ids, rows and ball tree of its points."""

    def build(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["id", "row"])
        tree = BallTree.build(quantise(np.stack(points["v"].to_numpy()), scale))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps((points["id"].to_numpy(), points["row"].to_numpy(), tree), 5)]})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"), "trees")


def top_k(df: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, shard_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for every row whose id is divisible by `every` the k rows with the highest
    inner product of floor(scale * component), ties to the smaller id, the row itself left out; all, if fewer.

    Rows with a null id and vectors that are null, empty or hold null or non-finite components take no part. Every other
    row is a candidate, also one that repeats an id, the query's own or another's; and every row with a divisible id is a
    query, so rows that repeat such an id give as many lists. Vectors of another length than the query's aren't candidates.
    Components and products beyond a long are an error. Other columns are ignored; an empty table gives an empty table.
    A task holds shard_rows vectors and a batch of queries; the number of (query, shard) pairs grows with both tables, as
    the stated search does.
    """
    batched(df.sparkSession, 4096, 32 << 20)
    rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "vectors")
    shards = max(1, -(-rows.count() // shard_rows))
    trees = shard_trees(rows, shards, scale).select("dim", "shard", F.lit(0).alias("kind"), "tree", *(F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("row", "long"), ("floor", "long"))), F.lit(None).cast(rows.schema["v"].dataType).alias("v"))
    asked = rows.where(F.col("id") % every == 0)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by shard, a shard's tree before its queries."""
        at, held = None, None
        for key, part in runs(batches, "dim", "shard", "kind"):
            if not key[2]:
                at, held = key[:2], pickle.loads(part.column("tree")[0].as_py())
            elif key[:2] == at:
                ids, points, tree = held
                q = quantise(np.stack(part.column("v").to_numpy(zero_copy_only=False)), scale)
                own, names = part.column("row").to_numpy(), part.column("id").to_numpy()
                s, n = tree.search(ids, points, q, own, k, part.column("floor").to_numpy())
                there = s != LOWEST
                of = lambda x: np.broadcast_to(x[:, None], s.shape)[there]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of(own), of(names), n[there], s[there])], ["row", "query_id", "vec_id", "score"])

    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    found, begin = None, 0
    while begin < shards:
        end = min(shards, max(1, 4 * begin))
        bound = F.lit(LOWEST).cast("long")
        wave = asked.withColumn("floor", bound)
        if found is not None:
            kth = found.where(F.col("rank") == k).select(F.col("row").alias("r"), F.col("score").alias("kth"))
            wave = asked.join(kth, asked["row"] == kth["r"], "left").withColumn("floor", F.coalesce("kth", bound))
        offsets = F.sequence(F.lit(begin), F.lit(end - 1))
        shard = F.explode(F.transform(offsets, lambda o: F.pmod(F.xxhash64("row", F.lit(2)) + o, F.lit(shards)).cast("int")))
        wave = wave.select("dim", shard.alias("shard"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("tree"), "id", "row", "floor", "v")
        dealt = trees.unionByName(wave).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "id")
        hits = dealt.mapInArrow(search, "row long, query_id long, vec_id long, score long")
        if found is not None:
            hits = hits.union(found.drop("rank"))
        found = cut(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        begin = end
    return found.select("query_id", "rank", "vec_id", "score")
