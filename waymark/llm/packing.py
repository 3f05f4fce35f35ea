"""Best-fit packing under conflicts.

Documents are cut to pieces of at most `capacity` words; full pieces fill a bin each. The others are placed largest
first, each into the open bin with the least room that still fits it and that has no conflict: a bin holds at most
`per_source` pieces of a source and at most one of a cluster of duplicates. Bins stand by residual, and a bitmap of the
residuals that occur gives the successor of any size in one step; each bin carries a bitmap per source layer (present
once, twice, ...) and one of clusters. Bins of a residual stand by the bitmap of sources that they have no place left for,
so that one look passes over all bins that a source has filled. The search goes on from residual to residual until a bin
is compatible.

The table is dealt by hash into shards of about `shard_docs` documents, which are packed on their own: a bin never spans
shards, so at most one open bin in some hundred is less full than a packing of all would leave it, and no task grows
with the table. Rows that repeat are numbered, by sums over partitions, and dealt by their numbers too; documents of a hot
source are dealt over all shards.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import cut, like, n_words


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        #: room -> sources without a place left (a bitmap) -> bins, each with the time at which it got this room
        self.by_room: dict[int, dict[int, dict[int, int]]] = {}
        self.occurs = 0  # bit r: some bin has room r
        self.layers: list[list[int]] = []  # of each bin: layer l has the sources that it holds more than l times
        self.clusters: list[int] = []
        self.clock = 0

    def _enter(self, b: int, room: int) -> None:
        self.clock += 1
        if room:
            self.by_room.setdefault(room, {}).setdefault(self.layers[b][-1], {})[b] = self.clock
            self.occurs |= 1 << room

    def _leave(self, b: int, room: int) -> None:
        groups = self.by_room[room]
        group = groups[self.layers[b][-1]]
        del group[b]
        if not group:
            del groups[self.layers[b][-1]]
            if not groups:
                del self.by_room[room]
                self.occurs &= ~(1 << room)

    def _earliest(self, room: int, source: int, cluster: int) -> int | None:
        """Of the compatible bins with this room the one that has had it longest."""
        best = None
        for filled, group in self.by_room[room].items():
            if not filled & source:
                b = next((b for b in group if not self.clusters[b] & cluster), None)
                if b is not None and (best is None or group[b] < best[0]):
                    best = group[b], b
        return best and best[1]

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset in it). source and cluster are bits (cluster 0: no duplicates)."""
        left = self.occurs >> size << size
        while left:
            room = (left & -left).bit_length() - 1
            b = self._earliest(room, source, cluster)
            if b is not None:
                self._leave(b, room)
                for k, layer in enumerate(self.layers[b]):
                    if not layer & source:
                        self.layers[b][k] |= source
                        break
                self.clusters[b] |= cluster
                self._enter(b, room - size)
                return b, self.capacity - room
            left &= left - 1
        b = len(self.layers)
        self.layers.append([source] + [0] * (self.per_source - 1))
        self.clusters.append(cluster)
        self._enter(b, self.capacity - size)
        return b, 0


def pack_shard(sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int, per_source: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, piece, first word, words, bin, offset) of every piece; the documents come in a fixed order."""
    out, rest, bins = [], [], 0
    for d, size in enumerate(sizes):
        full, left = divmod(int(size), capacity)
        for p in range(full):
            out.append((d, p, p * capacity, capacity, bins, 0))
            bins += 1
        if left:
            rest.append((left, d, full))
    open_ = Bins(capacity, per_source)
    source_bit: dict = {}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    cluster_bit: dict = {}
    for left, d, full in sorted(rest, key=lambda t: (-t[0], t[1])):
        s = source_bit.setdefault(sources[d], 1 << len(source_bit))
        c = clusters[d]
        bit = 0 if c is None or seen[c] == 1 else cluster_bit.setdefault(c, 1 << len(cluster_bit))
        b, at = open_.place(left, s, bit)
        out.append((d, full, full * capacity, left, bins + b, at))
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with `copy`: equal rows are numbered 0, 1, ..., whatever partitions they are in. Equal rows are counted
    within each partition and the counts summed over partitions, so no task sees all copies."""
    columns = rows.columns
    counted = rows.withColumn("_p", F.spark_partition_id()).groupBy("_p", *columns).agg(F.count("*").alias("_m"))
    before = Window.partitionBy(*columns).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_s", F.coalesce(F.sum("_m").over(before), F.lit(0)))
    return counted.select(*columns, F.explode(F.sequence(F.col("_s"), F.col("_s") + F.col("_m") - 1)).alias("copy"))


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = 2048, per_source: int = 2, shard_docs: int = 8192) -> DataFrame:
    """One row per piece: id, piece, first_word, n_words, bin, bin_offset (words before it in its bin).

    cluster_col names duplicates that must not meet in a bin; without it, equal texts are a cluster. A null source is a
    source, a null cluster none; a null text is empty. A document without words is one row with piece 0, no words and a
    null bin. Each repeated row is packed as a document of its own. A text of more than capacity words is several pieces,
    of which only the last, shorter one shares a bin. Shards depend on the number of rows, the order in them on id, text,
    source and the number of a copy, so reruns and partitionings agree. Other columns are ignored; an empty table gives an
    empty table."""
    text = F.col(text_col)
    cluster = F.xxhash64(text) if cluster_col is None else F.when(F.col(cluster_col).isNotNull(), F.xxhash64(cluster_col))
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.xxhash64(text).alias("h"), n_words(text).alias("size")))
    shards = max(1, -(-rows.count() // shard_docs))
    shard = F.pmod(F.xxhash64(F.col("id").cast("string"), "h", "copy"), F.lit(shards)).cast("int")
    names = [id_col, "piece", "first_word", "n_words", "bin", "bin_offset"]
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.LongType()]
    schema = T.StructType([like(df, id_col), *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True))])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "h", "source", "size", "copy"], kind="stable", na_position="last").reset_index(drop=True)
        clusters = [None if pd.isna(c) else int(c) for c in pdf["cluster"]]
        found = np.array(pack_shard(pdf["size"].tolist(), pdf["source"].tolist(), clusters, capacity, per_source), np.int64).reshape(-1, 6)
        out = pd.DataFrame({id_col: pdf["id"].iloc[found[:, 0]].to_numpy(), "piece": found[:, 1].astype("i4"), "first_word": found[:, 2], "n_words": found[:, 3], "bin": found[:, 4] + (int(key[0]) << 32), "bin_offset": found[:, 5]})
        return out.sort_values(["bin", "bin_offset"], kind="stable")

    filled = numbered(rows.where("size > 0")).select("id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("order"), F.coalesce("source", F.lit("\0")).alias("source"), F.col("cluster").cast("decimal(20,0)").cast("string").alias("cluster"), "h", "size", "copy", shard.alias("shard"))
    packed = filled.groupBy("shard").applyInPandas(run, schema)
    empty = rows.where("size = 0").select(F.col("id").alias(id_col), *(F.lit(v).cast(k).alias(n) for n, k, v in zip(names[1:], kinds, (0, 0, 0, None, None), strict=True)))
    return packed.unionByName(empty)
