"""The trie of conversation prefixes by chained digests.

Every turn is reduced to a SHA-256 of its role and text before anything is shuffled. A conversation's prefixes are named by
chained digests, each that of the one before and of the next turn, so that prefixes of a depth are equal where their
digests are. Every prefix is a row; rows of the same (depth, digest) are one node.

A node is also named by its smallest member and its depth: whoever is the smallest member of a prefix is so of all longer
ones of its own. For sums over subtrees each conversation therefore holds what its own nodes add and explodes, for each of its
prefixes, one sum of its nodes at or below it (a running sum from its end), so rows stay as many as prefixes and are added per
node, with sums on the map side. Members that end at a node are hashed in order: ids are sorted by range, joined to chunks in
parallel, and the chunks of a node pass through one hash, in constant memory.

A conversation's chain is a stream in one task, as each digest needs the one before; the task holds one row of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import small, written

#: Parents with so many children are looked up by broadcast (their number is counted), others by shuffle.
HOT = 10_000
NODE = ["depth", "digest"]
ROOT = hashlib.sha256(b"").digest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 (binary) of a turn: the bytes of the role's length, a colon, the role and the text. Null: empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def turns_of(df: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of conversations as conv_id, pos (from 0, by order_col, null first, ties by digest), digest, chars. Rows with a
    null conversation take no part; repeated rows are turns of their own."""
    kept = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(order_col).alias("o"), turn_digest(F.col(role_col), F.col(text_col)).alias("digest"),
        F.coalesce(F.char_length(F.col(text_col)), F.lit(0)).cast("long").alias("chars"),
    )
    pos = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("o").asc_nulls_first(), "digest")) - 1
    return kept.select("conv_id", pos.alias("pos"), "digest", "chars")


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which conversation c begins with the first h turns of conversation c - c % group, where h is
    the unsigned crc32 of c in decimal, modulo most, and goes on with its own after its first h."""
    turns = written(turns, "turns")
    h = F.crc32(F.col("conv_id").cast("string")) % most
    convs = written(turns.groupBy("conv_id").count().select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h")), "convs")
    heads = turns.where((F.col("pos") < most - 1) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "base")
    first = convs.where("h > 0").join(heads, "base").where("pos < h").select("conv_id", "pos", "digest", "chars")
    return turns.where(F.col("pos") >= h).unionByName(first), convs.select("conv_id")


_PREFIXES = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("parent", T.BinaryType()), T.StructField("chars", T.LongType()), T.StructField("last", T.BooleanType())])
_PREFIXES_ARROW = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("chars", pa.int64()), ("last", pa.bool_())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations that come sorted by (conv_id, pos), the first row of each being the root (digest null)."""
    conv, depth, state, held = None, 0, ROOT, None
    for batch in batches:
        out = []
        for c, turn, chars in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "digest", "chars")), strict=True):
            if held is not None:
                out.append((*held, c != conv))
            if c != conv:
                conv, depth, state, held = c, 0, ROOT, (c, 0, ROOT, None, 0)
            else:
                above, state, depth = state, hashlib.sha256(state + turn).digest(), depth + 1
                held = (c, depth, state, above, chars)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _PREFIXES_ARROW, strict=True)], schema=_PREFIXES_ARROW)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*held, True), _PREFIXES_ARROW, strict=True)], schema=_PREFIXES_ARROW)


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All prefixes of all conversations (those without turns have their root)."""
    root = convs.select("conv_id", F.lit(-1).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    rows = root.unionByName(turns.select("conv_id", "pos", "digest", "chars")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return rows.mapInArrow(_chain, _PREFIXES)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the same node in each batch, their ids joined by commas."""
    for batch in batches:
        rows = list(zip(*(batch.column(n).to_pylist() for n in ("depth", "digest", "conv_id")), strict=True))
        out, i = [], 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][:2] == rows[i][:2]:
                j += 1
            out.append((*rows[i], ",".join(str(r[2]) for r in rows[i:j])))
            i = j
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.string()), strict=True)], ["depth", "digest", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each node over its chunks, which come in order."""
    node, sha = None, None
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.string()), strict=True)], ["depth", "digest", "ends_sha256"])
    for batch in batches:
        out = []
        for depth, digest, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "digest", "ids")), strict=True):
            if (depth, digest) == node:
                sha.update(b"," + ids.encode())
            else:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = (depth, digest), hashlib.sha256(ids.encode())
        if out:
            yield pack(out)
    if node:
        yield pack([(*node, sha.hexdigest())])


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of all prefixes of the conversations convs (conv_id) with turns (conv_id, pos, digest, chars), as conv_id (the
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and digest.

    Conversations without turns belong to the root and end there; without conversations there is no node."""
    rows = written(prefixes(turns, convs), "prefixes")
    node = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent").alias("parent"), F.max("chars").alias("chars"))
    none = lambda t: F.lit(None).cast(t)
    child = node.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest"), none("long").alias("conv_id"), none("long").alias("n_convs"), none("binary").alias("parent"), none("long").alias("chars"), F.lit(1).alias("child"))
    nodes = node.withColumn("child", F.lit(0)).unionByName(child).groupBy(*NODE).agg(
        F.max("conv_id").alias("conv_id"), F.max("n_convs").alias("n_convs"), F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.sum("child").alias("n_children"))
    nodes = written(nodes, "nodes")
    adds = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select("conv_id", *NODE).join(adds, ["conv_id", "depth"], "left").select(*NODE, F.sum("leaf").over(below).alias("n_leaves"), F.sum("saved").over(below).alias("saved_tokens"))
    sums = sums.where("n_leaves > 0 or saved_tokens > 0").select(*NODE, none("long").alias("conv_id"), none("long").alias("n_convs"), none("binary").alias("parent"), none("long").alias("n_children"), "n_leaves", "saved_tokens", none("string").alias("ends_sha256"))
    ends = rows.where("last").select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    chunks = ends.mapInArrow(_joined, "depth long, digest binary, first long, ids string").repartition(*NODE).sortWithinPartitions(*NODE, "first")
    hashes = chunks.mapInArrow(_hashed, "depth long, digest binary, ends_sha256 string")
    hashes = hashes.select(*NODE, none("long").alias("conv_id"), none("long").alias("n_convs"), none("binary").alias("parent"), none("long").alias("n_children"), none("long").alias("n_leaves"), none("long").alias("saved_tokens"), "ends_sha256")
    own = nodes.select(*NODE, "conv_id", "n_convs", "parent", "n_children", none("long").alias("n_leaves"), none("long").alias("saved_tokens"), none("string").alias("ends_sha256"))
    whole = own.unionByName(sums).unionByName(hashes).groupBy(*NODE).agg(
        *(F.max(c).alias(c) for c in ("conv_id", "n_convs", "parent", "n_children")), F.sum("n_leaves").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    whole = written(whole, "trie")
    above = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = small(above.where(F.col("n_children") >= HOT).drop("n_children"))
    few = whole.join(hot, ["depth", "parent"], "left_anti").join(above.where(F.col("n_children") < HOT).drop("n_children"), ["depth", "parent"], "left")
    found = whole.join(hot, ["depth", "parent"]).unionByName(few)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "digest")


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations as they stand in df. Null roles and texts are empty; rows with a null conversation take no
    part; an empty table gives an empty table; other columns of df are left behind."""
    turns = written(turns_of(df, conv_col, order_col, role_col, text_col), "turns")
    return trie(turns, turns.groupBy("conv_id").count().select("conv_id"))
