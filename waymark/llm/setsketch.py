"""Near-duplicates by SetSketch registers.

A document's set of word shingles is sketched by M registers. Register i is the largest, over the shingles, of
floor(1 - log_B of an exponential variate that is a hash of shingle and i), kept within [0, LIMIT + 1]: truncated
minima on an exponential scale. Sketches of unions are the maxima of sketches, and two registers are equal about as
often as the sets are alike.

1. Documents with the same set are one class, by a 128-bit hash; its smallest id stands for it from here on.
2. Bands of registers are hashed to keys, as many and as long as banding() says for the threshold: a pair at it shares
   none with probability below MISS.
3. In each bucket every member is paired with the bucket's smallest id (a star, linear in the bucket).
4. A pair goes on if its sizes allow the threshold and the similarity estimated jointly from the registers by maximum
   likelihood is within MARGIN standard errors of it.
5. What is left is confirmed on the full sets, and links are joined to components.
6. Buckets that then still hold members of several components are compared in full between those components, in tasks
   of two blocks of BLOCK members: sizes, registers, then sets, as above, inside the task, which gives back only the links
   that join components. No pair that the bands bring together is left out, and no task or table holds all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import batched, cut, small, words_of, written
from waymark.operators.graph import connected_components

M, MISS = 120, 1e-6
#: Base of the exponential scale, its rate, and the largest exponent.
B, RATE, LIMIT = 1.02, 20.0, 4094
MARGIN = 5.0
BLOCK = 2048
_MULTIPLIERS = np.random.default_rng(20).integers(0, 2**63, M, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Word -> 64-bit hash, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, k: int, known: dict) -> np.ndarray:
    """The distinct k-word shingles as sorted 64-bit hashes; all words as one where there are fewer; none without words."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    width = min(k, len(h))
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (documents x M, uint16) of non-empty sets."""
    out = np.zeros((len(sets), M), np.uint16)
    i = 0
    while i < len(sets):  # as many sets at once as a core's cache holds
        j, total = i, 0
        while j < len(sets) and (j == i or total + len(sets[j]) <= 32_768):
            total += len(sets[j])
            j += 1
        x = np.concatenate(sets[i:j])
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[i : j - 1]]))).astype(np.int64)
        low = np.empty((j - i, M), np.uint64)
        buffer = np.empty_like(x)
        for r in range(M):
            np.multiply(x, _MULTIPLIERS[r], out=buffer)
            low[:, r] = np.minimum.reduceat(buffer, starts)
        # the smallest hash is the smallest exponential variate
        variate = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / RATE
        out[i:j] = np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(B)), 0, LIMIT + 1).astype(np.uint16)
        i = j
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of pairs of sketches (rows of a and b) of sets of na and nb elements: the
    counts of registers that are larger in a, larger in b and equal have probabilities p(u - v J), p(v - u J) and the
    rest, where p(x) = -log_B(1 - x (B - 1) / B), u = na / (na + nb) and v = nb / (na + nb)."""
    up, down = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    u = na / (na + nb)
    v = 1 - u
    scale = (B - 1) / B

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.maximum(x, 0) * scale) / np.log(B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        pu, pd = p(u - v * j), p(v - u * j)
        return up * np.log(pu + 1e-12) + down * np.log(pd + 1e-12) + (a.shape[1] - up - down) * np.log(np.maximum(1 - pu - pd, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):  # the likelihood is concave in j
        third = (hi - lo) / 3
        left = likelihood(lo + third) < likelihood(hi - third)
        lo, hi = np.where(left, lo + third, lo), np.where(left, hi, hi - third)
    return (lo + hi) / 2


def floor_of(percent: int) -> float:
    """Estimates below this can't be links: MARGIN standard errors under the threshold."""
    j = percent / 100
    return j - MARGIN * (j * (1 - j) / M) ** 0.5


def smallest_linked(percent: int) -> int:
    """Sets smaller than this link with equal sets only: with n shingles and one more, n / (n + 1) is too little."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def banding(percent: int) -> tuple[int, int]:
    """Rows of a band and bands: the longest bands of which M registers hold enough. Two registers are equal at least with
    the similarity as probability. Below 11 % M registers don't suffice for MISS; then each is a band."""
    for rows in range(M, 1, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows)))
        if rows * bands <= M:
            return rows, bands
    return 1, M


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """id, n, set (128-bit hash of the set, null if empty), regs and bands (null where only equal sets can link)."""
    least, (rows, count) = smallest_linked(percent), banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sets = [shingles(t, k, known) for t in batch.column(1).to_pylist()]
            large = [i for i, s in enumerate(sets) if len(s) >= least]
            regs = sketch([sets[i] for i in large])
            raw: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            for i, row in zip(large, regs, strict=True):
                raw[i] = row.tobytes()
                bands[i] = [xxhash.xxh3_64_intdigest(row[b * rows : (b + 1) * rows].tobytes(), seed=b + 1) - 2**63 for b in range(count)]
            hashes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(hashes, pa.binary()), pa.array(raw, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "set", "regs", "bands"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, set binary, regs binary, bands array<long>")


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b, na, nb, ra, rb those that the registers allow: a, b."""
    floor = floor_of(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in (4, 5))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in (2, 3))
            ok = estimate(ra, rb, na, nb) >= floor
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(c).to_numpy()[ok]) for c in (0, 1)], ["a", "b"])

    fit = pairs.where((100 * F.least("na", "nb")) >= (percent * F.greatest("na", "nb")))
    return fit.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(run, "a long, b long")


def _sets(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, set (64-bit hashes, sorted) of the documents whose ids are wanted (column _w, distinct)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = texts.join(small(wanted), F.col("id") == F.col("_w"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            sets = [shingles(t, k, known).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    return written(texts.mapInArrow(run, "id long, set binary"), "sets")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """The pairs a, b whose full sets reach the threshold."""
    pairs = cut(pairs)
    wanted = cut(pairs.select(F.col("a").alias("_w")).union(pairs.select(F.col("b").alias("_w"))).distinct())
    sets = _sets(wanted, docs, id_col, text_col, k)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ok = pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in (0, 1)], ["a", "b"])

    left = pairs.join(sets.withColumnsRenamed({"id": "a", "set": "sa"}), "a")
    both = left.join(sets.withColumnsRenamed({"id": "b", "set": "sb"}), "b").select("a", "b", "sa", "sb")
    return cut(both.mapInArrow(check, "a long, b long").distinct())


def _block_links(ids: np.ndarray, n: np.ndarray, label: np.ndarray, side: np.ndarray, same: bool, regs: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links a < b that join the labels of one task's members as far as links do. same: all against all, else side 0
    against side 1."""
    floor, parent, out = floor_of(percent), {}, []

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    def settle(pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, j = (np.concatenate(c) for c in zip(*pairs, strict=True))
        likely = estimate(regs[i], regs[j], n[i].astype(float), n[j].astype(float)) >= floor
        for x, y in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
            a, b = root(int(label[x])), root(int(label[y]))
            if a != b and linked(sets[x], sets[y], percent):
                parent[max(a, b)] = min(a, b)
                out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))

    right = np.arange(len(ids)) if same else np.flatnonzero(side == 1)
    held, count = [], 0
    for i in np.arange(len(ids)) if same else np.flatnonzero(side == 0):
        j = right[right > i] if same else right
        j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
        # the estimate is close to the share of equal registers
        j = j[(regs[j] == regs[i]).sum(1) >= M * (floor - 0.06)] if len(j) else j
        if len(j):
            held.append((np.full(len(j), i), j))
            count += len(j)
        if count >= 4096:
            settle(held)
            held, count = [], 0
    if held:
        settle(held)
    return out


def _across(members: DataFrame, percent: int) -> DataFrame:
    """members: task, same, side, id, n, label, regs, set -> a, b: the links between labels that each task finds."""

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if rows.num_rows > 1:
            ids, n, label, side = (rows.column(c).to_numpy() for c in ("id", "n", "label", "side"))
            regs = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(-1, M)
            sets = [np.frombuffer(b, np.uint64) for b in rows.column("set").to_pylist()]
            if found := _block_links(ids, n, label, side, rows.column("same")[0].as_py(), regs, sets, percent):
                yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by task; one task is held at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            task = batch.column("task").to_numpy()
            at = [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist(), len(task)]
            for i, j in zip(at, at[1:], strict=False):
                if held and held[-1].column("task")[0].as_py() != task[i]:
                    yield from links(held)
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield from links(held)

    columns = ["task", "same", "side", "id", "n", "label", "regs", "set"]
    return members.select(*columns).repartition("task").sortWithinPartitions("task", "id").mapInArrow(run, "a long, b long").distinct()


def _tasks(marked: DataFrame) -> DataFrame:
    """marked: bucket, id, label -> with task, same and side, for buckets of several labels. The members of a bucket's most
    frequent label are its main part, to be compared with the others only; others are compared with all. Both are dealt by
    hash into blocks of about BLOCK, and a task holds two blocks, so the tasks of a bucket number as its size times the
    number of others."""
    by_label = marked.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    shape = by_label.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    shape = shape.select("bucket", F.col("top.label").alias("main"), blocks(F.col("top.n")).alias("mains"), blocks(F.col("all") - F.col("top.n")).alias("others"))
    rows = marked.join(shape, "bucket").withColumn("is_main", F.col("label") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    each = lambda n, main: F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.struct(b.alias("other"), F.lit(main).alias("to_main")))
    partner = F.when(F.col("is_main"), each(F.col("others"), False)).otherwise(F.concat(each(F.col("others"), False), each(F.col("mains"), True)))
    rows = rows.withColumn("p", F.explode(partner)).select("*", "p.other", "p.to_main")
    mixed = F.col("is_main") | F.col("to_main")
    lo = F.when(F.col("is_main"), F.col("other")).when(F.col("to_main"), F.col("block")).otherwise(F.least("block", "other"))
    hi = F.when(F.col("is_main"), F.col("block")).when(F.col("to_main"), F.col("other")).otherwise(F.greatest("block", "other"))
    rows = rows.withColumn("task", F.xxhash64("bucket", mixed, lo, hi)).withColumn("same", ~mixed & (lo == hi))
    return rows.withColumn("side", F.when(F.col("is_main") | (~mixed & (F.col("block") != lo)), 1).otherwise(0)).select("task", "same", "side", "id", "label")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs without ASCII white space. Documents are linked if 100 * intersection >= percent *
    union of their shingle sets; component_id is the smallest id that links reach, kept says that it is the row's own.
    Null and empty texts and texts without words have an empty set and link with nothing. Rows with a null id take no
    part: component_id null, kept true. Rows that repeat an id count as one document, linked by any of them. Ids are
    integers; other columns are ignored; an empty table gives an empty table. Copies never make pairs: they share a class.
    """
    batched(df.sparkSession)
    sig = written(signatures(df, id_col, text_col, shingle_words, percent), "signatures")
    named = sig.where("id is not null and set is not null")
    classes = cut(named.groupBy("set").agg(F.min("id").alias("rep")))
    reps = named.where("regs is not null").join(classes.withColumnRenamed("set", "s"), (F.col("set") == F.col("s")) & (F.col("id") == F.col("rep")), "left_semi")
    reps = written(reps.dropDuplicates(["id", "set"]).select("id", "n", "regs", "bands"), "classes")
    regs = reps.select("id", "n", "regs")

    def beside(pairs: DataFrame) -> DataFrame:
        out = pairs.join(regs.withColumnsRenamed({"id": "a", "n": "na", "regs": "ra"}), "a")
        return out.join(regs.withColumnsRenamed({"id": "b", "n": "nb", "regs": "rb"}), "b")

    members = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = cut(members.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size"))
    members = cut(members.join(buckets, "bucket"))
    stars = members.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(_likely(beside(stars), percent), df, id_col, text_col, shingle_words, percent)
    edges = lambda e: e.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = connected_components(edges(links))
    # buckets that hold several components
    marked = cut(members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label")))
    tasks = cut(_tasks(marked))
    sets = _sets(cut(tasks.select(F.col("id").alias("_w")).distinct()), df, id_col, text_col, shingle_words)
    more = _across(tasks.join(regs, "id").join(sets, "id"), percent)
    more = _confirmed(more, df, id_col, text_col, shingle_words, percent)
    labels = connected_components(edges(links.union(more)))
    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set", F.coalesce("component", "rep").alias("component"))
    out = sig.select("id", "n", "set").join(of_class.where("set is not null"), "set", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
