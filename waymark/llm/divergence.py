"""How sources of a language differ in their terms: smoothed frequencies, divergences of sources, and their outstanding terms.

Terms are counted in one pass over the texts, added up in the worker before they are shuffled by (language, term); the document
frequency of a term in its language comes from the same rows.

Pairs of sources: a term that neither source holds adds the same value, f of the two baselines. So a pair's value is the
vocabulary's size times that, plus, for the terms that only one side holds, corrections from a histogram of each source's
frequencies, and for the terms that both hold, corrections computed from the term's own short list of sources. Terms are dealt
over tasks, and each task adds its pairs up before they leave it.

Ranking: no list is sorted as a whole. Histograms over the 16 highest bits of the values find in which bucket each group's kth
value lies, the next 16 bits are counted in that bucket alone, and so on; ties at the kth value go on by pairs of UTF-8 bytes.
A group is settled as soon as its bucket is small; only rows at or above the bounds are ranked.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import batched, cut, small, written

#: A term in UTF-8: ASCII letters and whatever isn't ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
LANG = ["lang", "source"]
#: Terms that a worker holds before it passes their counts on; pairs of a task computed at once; sources up to which a task
#: adds pairs up in a table; the size of a bucket that needs no further digit.
HELD, AT_ONCE, DENSE, SETTLED = 400_000, 1 << 20, 2_000, 1_024
SCALE = 1_000_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), of in counts.items():
            terms = list(of)
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                seen = docs[lang, source]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()),
                     pa.array([of[t] for t in part], pa.int64()), pa.array([seen[t] for t in part], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()
        docs.clear()

    held = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            own = Counter(TERM.findall(text.lower()))  # bytes.lower knows ASCII only
            of, seen = counts.setdefault((lang, source), Counter()), docs.setdefault((lang, source), Counter())
            held -= len(of)
            of.update(own)
            seen.update(own.keys())
            held += len(of)
            if held > HELD:
                yield from flushed()
                held = 0
    yield from flushed()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, in parts that are still to be added up. Nulls are empty."""
    batched(docs.sparkSession)
    text = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return text.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")


def divergence(p: Column, q: Column) -> Column:
    """(p - q)^2 / q, rounded down; p and q up to 10^9 + 1, so that all fits in a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def frequency(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), in decimals, since 10^9 n may not fit in a long."""
    return F.lit(1).cast("long") + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of the terms that both of two sources hold, for rows sorted by (lang, term)."""
    codes: dict[tuple[str, str], int] = {}
    table = np.zeros((0, 0), np.int64)

    def rows_of(keys: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, n = list(codes), len(codes)
        for i in range(0, len(keys), 50_000):
            a, b = [names[k] for k in keys[i : i + 50_000] // n], [names[k] for k in keys[i : i + 50_000] % n]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in a], pa.string()), pa.array([x[1] for x in a], pa.string()), pa.array([x[1] for x in b], pa.string()), pa.array(sums[i : i + 50_000])], ["lang", "source", "item", "value"])

    def settle(lang: list[str], source: list[str], p: np.ndarray, base: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole terms: row i's term reaches from starts[k] to starts[k + 1]."""
        nonlocal table
        g = np.fromiter((codes.setdefault(x, len(codes)) for x in zip(lang, source, strict=True)), np.int64, len(lang))
        if len(codes) > len(table) and len(codes) <= DENSE:
            grown = np.zeros((2 * len(codes),) * 2, np.int64)
            grown[: len(table), : len(table)] = table
            table = grown
        widths = np.diff(starts)
        first, width = np.repeat(starts[:-1], widths), np.repeat(widths, widths)
        upto = np.cumsum(width)
        i = 0
        while i < len(g):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + AT_ONCE)))
            w = width[i:j]
            a = np.repeat(np.arange(i, j), w)
            b = np.arange(len(a)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[i:j], w)
            a, b = a[a != b], b[a != b]
            value = _f(p[a], p[b]) - _f(p[a], base[b]) - _f(base[a], p[b]) + _f(base[a], base[b])
            if len(codes) <= DENSE:
                np.add.at(table, (g[a], g[b]), value)
            elif len(a):
                key = g[a] * len(codes) + g[b]
                order = np.argsort(key, kind="stable")
                edge = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
                yield from rows_of(key[order][edge], np.add.reduceat(value[order], edge))
            i = j

    tail: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if tail is None else pa.concat_tables([tail, rows])
        lang, term = rows.column("lang").to_pylist(), rows.column("term").to_pylist()
        starts = np.array([0] + [i for i in range(1, len(term)) if term[i] != term[i - 1] or lang[i] != lang[i - 1]])
        tail = rows.slice(int(starts[-1])).combine_chunks()
        if len(starts) > 1:
            n = int(starts[-1])
            yield from settle(lang[:n], rows.column("source").to_pylist()[:n], rows.column("p").to_numpy()[:n], rows.column("base").to_numpy()[:n], starts)
    if tail is not None:
        yield from settle(*(tail.column(n).to_pylist() for n in ("lang", "source")), *(tail.column(n).to_numpy() for n in ("p", "base")), np.array([0, tail.num_rows]))
    n = len(codes)
    if n and len(table):
        a, b = np.nonzero(table[:n, :n])
        yield from rows_of(a * n + b, table[a, b])


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language. terms: lang, source, term, p of what a source
    holds, and base, its p of a term that it lacks; groups: lang, source, base, n_terms (of the language)."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("base_o"), "n_terms")
    other = small(other)
    a, o, p = F.col("base"), F.col("base_o"), F.col("p")
    apart = F.col("source") != F.col("item")
    absent = groups.select("lang", "source", "base").join(other, "lang").where(apart).select("lang", "source", "item", F.when(F.col("n_terms") > 0, F.col("n_terms") * divergence(a, o)).otherwise(F.lit(0)).alias("value"))
    several = terms.groupBy("lang", "source", "base", "p").agg(F.count("*").alias("m")).join(other, "lang").where(apart)
    mine = several.select("lang", "source", "item", (F.col("m") * (divergence(p, o) - divergence(a, o))).alias("value"))
    theirs = several.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("m") * (divergence(o, p) - divergence(o, a))).alias("value"))
    met = terms.select("lang", "term", "source", "p", "base").repartition("lang", "term").sortWithinPartitions("lang", "term")
    both = met.mapInArrow(_pairs, "lang string, source string, item string, value long")
    return absent.unionByName(mine).unionByName(theirs).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def radix_top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of each group with the largest value (a non-negative long), ties to the smaller item by UTF-8 bytes, with their
    rank. rows is read once for each digit, so it should be a table; its columns are by, item and value; items of a group
    are distinct."""
    rows = rows.select(*by, "item", "value")
    state, bits = None, 64
    while bits:
        bits -= 16
        here = rows if state is None else rows.join(small(state.where("not settled")), by).where(F.shiftright("value", bits + 16) == F.col("above"))
        had = [F.lit(0).cast("long").alias("above"), F.lit(k).cast("long").alias("left")] if state is None else ["above", "left"]
        hist = here.select(*by, *had, F.shiftright("value", bits).bitwiseAND(F.lit(65_535)).alias("digit")).groupBy(*by, "above", "left", "digit").agg(F.count("*").alias("n"))
        state = _narrowed(hist, by, F.desc("digit"), state, bits)
        if state.where("not settled").isEmpty():
            break
    depth = 0
    while not state.where("not settled").isEmpty():  # ties at the kth value
        at = F.encode("item", "UTF-8")
        here = rows.join(small(state.where("not settled")), by).where((F.col("value") == F.col("low")) & (F.substring(at, 1, depth) == F.col("bytes") if depth else F.lit(True)))
        hist = here.select(*by, "above", "left", "low", "bytes", F.substring(at, depth + 1, 2).alias("digit")).groupBy(*by, "above", "left", "low", "bytes", "digit").agg(F.count("*").alias("n"))
        state = _narrowed_by_bytes(hist, by, state)
        depth += 2
    near = rows.join(small(state.select(*by, "low", "bytes")), by)
    at = F.encode("item", "UTF-8")
    near = near.where((F.col("value") > F.col("low")) | ((F.col("value") == F.col("low")) & (F.col("bytes").isNull() | (F.expr("substring(encode(item, 'UTF-8'), 1, length(bytes))") <= F.col("bytes")))))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), at))).where(F.col("rank") <= k).select(*by, "item", "value", "rank")


def _bucket(hist: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The bucket in which each group's place `left` lies (the last one where there are fewer rows), and what is left in it."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = hist.withColumn("upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    goal = F.least("left", "all")
    return upto.where((F.col("upto") >= goal) & (F.col("upto") - F.col("n") < goal)).withColumn("left", F.col("left") - F.col("upto") + F.col("n"))


def _narrowed(hist: DataFrame, by: list[str], order: Column, state: DataFrame | None, bits: int) -> DataFrame:
    above = F.shiftleft("above", 16).bitwiseOR(F.col("digit"))
    none = F.lit(None).cast("binary").alias("bytes")
    new = _bucket(hist, by, order).select(*by, above.alias("above"), "left", F.shiftleft(above, bits).alias("low"), none, ((F.col("n") <= SETTLED) | (F.col("n") <= F.col("left"))).alias("settled"))
    return cut(new if state is None else state.where("settled").unionByName(new))


def _narrowed_by_bytes(hist: DataFrame, by: list[str], state: DataFrame) -> DataFrame:
    found = _bucket(hist, by, F.asc("digit"))
    new = found.select(*by, "above", "left", "low", F.concat(F.coalesce("bytes", F.lit(b"")), "digit").alias("bytes"), ((F.col("n") <= SETTLED) | (F.col("n") <= F.col("left"))).alias("settled"))
    return cut(state.where("settled").unionByName(new))


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: every other source of the language, by divergence summed over the
    language's terms (those in at least least_docs of its documents). Part `term`: the terms that a source holds more of than
    its language, by divergence, the top of them.

    Null lang, source and text are empty, and so is a source of its own; every row is a document, repeated or not; a group
    without terms has pairs only; a language without kept terms has pairs of value 0; ties go to the smaller item by UTF-8; an
    empty table gives an empty table; other columns of docs are left behind."""
    each = Window.partitionBy("lang", "term")
    kept = (
        term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("in_docs", F.sum("docs").over(each)).withColumn("n_lang", F.sum("n").over(each)).withColumn("first", (F.col("source") == F.min("source").over(each)).cast("long"))
        .where(F.col("in_docs") >= least_docs).select("lang", "source", "term", "n", "n_lang", "first")
    )
    kept = written(kept, "terms")
    sums = kept.groupBy(*LANG).agg(F.sum("n").alias("total"), F.sum("first").alias("firsts"))
    there = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in LANG)).groupBy(*LANG).count().drop("count")
    groups = there.join(sums, LANG, "left").select(*LANG, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("firsts", F.lit(0)).alias("firsts"))
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"), F.sum("firsts").alias("n_terms"))
    groups = groups.join(of_lang, "lang").select(*LANG, "total", "total_lang", "n_terms", F.when(F.col("n_terms") > 0, frequency(F.lit(0).cast("long"), F.col("total"), F.col("n_terms"))).alias("base"))
    groups = cut(groups)
    known = kept.join(small(groups), LANG)
    known = known.select(*LANG, "term", frequency(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"), frequency(F.col("n_lang"), F.col("total_lang"), F.col("n_terms")).alias("q"), "base")
    known = written(known, "frequencies")
    pairs = pair_values(known, groups).withColumn("rank", F.row_number().over(Window.partitionBy(*LANG).orderBy(F.desc("value"), "item")))
    above = known.where("p > q").select(*LANG, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = radix_top(above, LANG, top)
    return pairs.select(*LANG, F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.select(*LANG, F.lit("term").alias("part"), "item", "value", "rank"))
