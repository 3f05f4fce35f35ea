"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source has a target in words. Every document of it is taken floor(target / source_size) times for certain, whole.
What remains of the target, `rest` words, is a sample drawn without replacement with unequal probabilities:

1. Inclusion probabilities go with size, p = c * size, where c makes the expected words of the sample `rest`. Documents for
   which p would be 1 or more are certain too, so c follows from those below: of all places to cut the sizes, from the
   largest down, the first at which c * size <= 1, with c = (rest - words above) / (sum of squares from there down).
2. Documents are ranked by (u / (1 - u)) / (p / (1 - p)), u being a uniform number from a hash of the document. The rank is
   kept as q / (1 + q), a 52-bit integer, which orders as the ratio q does.
3. The sample is the documents in order of rank as long as their words stay within what certain documents leave. The
   place that is left goes to the document that fits it best (by size, then by rank), or stays empty if none comes nearer
   than nothing. The document at the cut is among them, so a target is missed by half of that document at most.

No source is ever brought together in one task: the place where the running sum crosses is found by partial sums over
4096 ranges of the rank, then 4096 in the range that holds it, then the ranks of that one; rows that tie in rank (rows
that repeat an id) are told apart by their place in the table, again by partial sums over its partitions and then in one.
Two windows see more than that: one row per source, and one per source and distinct size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import cut, n_words, small, written

#: Bits of the uniform number (13 hex digits) and of the rank, and of each refinement; bits of a place within its partition.
U_BITS, STEP, ROW_BITS = 52, 12, 33


def uniform_key(id_col: Column, size: Column, text: Column, seed: str) -> Column:
    """52 bits from a hash of the id and size; of the text, where the id is null."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name, F.lit(":"), size.cast("string"))), 1, U_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """source, source_size -> with target and repeats (certain copies) and rest (words still to be sampled).

    The share of a source is level * weight, or max_repeats * source_size where that is less; level is the largest of
    (all words - caps of the sources before) / (weights from this source on) in order of cap / weight, which is where
    repeated resharing of the excess ends. One row per source goes through one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    share = F.max("level").over(every) * F.col("weight")
    t = t.withColumn("share", share).withColumn("full", F.col("cap") <= F.col("share"))
    t = t.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("share")))
    t = t.withColumn("repeats", F.when(F.col("full"), F.lit(max_repeats)).when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return t.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("repeats") * F.col("source_size"))).select("source", "source_size", "target", "repeats", "rest")


def _crossing(docs: DataFrame, part: Column) -> DataFrame:
    """Of docs (source, base, room, size): per source the part in which base + running words exceed room, and the words
    before it. Sources that stay within room have none."""
    sums = docs.groupBy("source", "base", "room", part.alias("part")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.col("base") + F.sum("words").over(run))
    over = sums.where(F.col("upto") > F.col("room"))
    return over.groupBy("source").agg(F.min(F.struct("part", (F.col("upto") - F.col("words")).alias("before"))).alias("at")).select("source", F.col("at.part").alias("part"), F.col("at.before").alias("before"))


def _draws(open_: DataFrame) -> DataFrame:
    """open_: source, rest, size (above 0) -> per source: top (larger documents are certain), c, and room (words that
    the certain ones leave). The window holds a row per distinct size."""
    sizes = open_.groupBy("source", "rest", "size").agg(F.count("*").alias("n"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    words, squares = F.col("size") * F.col("n"), (F.col("size") * F.col("size")).cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    sizes = sizes.withColumn("room", F.col("rest") - F.coalesce(F.sum(words).over(down), F.lit(0))).withColumn("below", F.sum(squares).over(up).cast("double")).withColumn("least", F.row_number().over(up) == 1)
    sizes = sizes.withColumn("c", F.col("room") / F.col("below"))
    fit = sizes.where((F.col("c") * F.col("size") <= 1) | F.col("least"))
    best = fit.groupBy("source").agg(F.max(F.struct("size", "c", "room")).alias("at"))
    return best.select("source", F.col("at.size").alias("top"), F.col("at.c").alias("c"), F.col("at.room").alias("room"))


def odds_rank(u: Column, p: Column) -> Column:
    """q / (1 + q) as an integer of U_BITS bits, where q = (u / (1 - u)) / (p / (1 - p)). u: integer of U_BITS bits."""
    x = (u.cast("double") + 0.5) / float(1 << U_BITS)
    up, down = x * (1 - p), p * (1 - x)
    return F.least(F.lit((1 << U_BITS) - 1), F.floor(up / (up + down) * float(1 << U_BITS))).cast("long")


def _drawn() -> Column:
    """Whether a document (size) takes part in the draw of its source's plan (top, c)."""
    return F.col("top").isNotNull() & (F.col("size") > 0) & (F.col("size") <= F.col("top"))


def _rank() -> Column:
    return odds_rank(F.col("u"), F.least(F.lit(1.0), F.col("c") * F.col("size")))


def mixing_plan(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Per source: source_size, target, repeats; top and c of the draw; cut_rank and cut_place (documents that come before
    are drawn; null: all), fill_place (so is the one at this place). sized: source, size, u, place; read several times, so
    it should be materialised."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(totals, weights, max_repeats))
    n = targets.count()

    def beside(docs: DataFrame, t: DataFrame) -> DataFrame:
        t = t.withColumnRenamed("source", "_source")
        return docs.join(small(t, n), docs["source"].eqNullSafe(t["_source"]), "inner").drop("_source")

    open_ = beside(sized, targets.where("rest > 0").select("source", "rest")).where("size > 0")
    draws = cut(_draws(open_))
    inside = beside(sized, draws).where(_drawn()).select("source", "room", "size", _rank().alias("rank"), "place")
    base = F.lit(0).cast("long")
    steps = [F.shiftrightunsigned("rank", U_BITS - STEP), F.shiftrightunsigned("rank", U_BITS - 2 * STEP), F.col("rank"), F.shiftrightunsigned("place", ROW_BITS), F.col("place")]
    held, cuts = inside.withColumn("base", base), None
    for k, step in enumerate(steps):
        at = cut(_crossing(held, step))
        if k == 2:
            cuts = at.select("source", F.col("part").alias("cut_rank"))
        if k + 1 < len(steps):
            held = beside(held.drop("base"), at).where(step == F.col("part")).withColumn("base", F.col("before")).drop("part", "before")
    places = at.select(F.col("source").alias("s"), F.col("part").alias("cut_place"), "before")
    cuts = cuts.join(places, cuts["source"].eqNullSafe(places["s"]), "inner").drop("s")
    left = beside(inside, cuts).where((F.col("rank") > F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("place") >= F.col("cut_place"))))
    gap = F.col("room") - F.col("before")
    miss = F.abs(gap - F.col("size"))
    fill = left.where(miss < gap).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "rank", "place")).alias("best")).select(F.col("source").alias("f"), F.col("best.place").alias("fill_place"))
    cuts = cuts.join(fill, cuts["source"].eqNullSafe(fill["f"]), "left").drop("f", "before")
    out = targets.drop("rest")
    for more in (draws.drop("room"), cuts):
        more = more.withColumnRenamed("source", "m")
        out = out.join(more, out["source"].eqNullSafe(more["m"]), "left").drop("m")
    return cut(out)


def _copies() -> Column:
    """Times a row (size, u, place) is taken, beside the plan of its source."""
    rank = _rank()
    before = F.col("cut_rank").isNull() | (rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & (F.col("place") < F.col("cut_place")))
    drawn = _drawn() & (before | (F.col("place") == F.coalesce(F.col("fill_place"), F.lit(-1))))
    certain = F.col("top").isNotNull() & (F.col("size") > F.col("top"))
    return F.col("repeats") + F.when(drawn | certain, 1).otherwise(0)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken. Other columns are ignored.

    Sizes are words (null text: 0). Sources in code point order, null last, weigh `weights`, repeating, and share all
    words; no target exceeds max_repeats times its source's size. taken is a multiple of size, at most max_repeats
    times; per source its sum misses the target by at most half of the document at the cut, and mostly by a few words.
    Empty texts take 0. Rows with the same id and size share one hash, so they tie in rank; where the cut falls among
    them, as many of them are taken as fit. A null id is hashed by its text. Which of several like rows is taken doesn't
    show in the result, so it depends on rows and seed only: reruns and partitionings agree. An empty table gives an
    empty table.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.col(text_col).alias("_text"))
    sized = cut(base.select("_id", "source", "size", uniform_key(F.col("_id"), F.col("size"), F.col("_text"), seed).alias("u"), F.monotonically_increasing_id().alias("place")))
    plan = mixing_plan(sized, weights, max_repeats).withColumnRenamed("source", "_source")
    out = sized.join(small(plan), sized["source"].eqNullSafe(plan["_source"]), "inner")
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """docs with every row as often as `mix` takes it (a row of an empty text as often as its source's certain copies).
    Columns and their order are those of docs; nulls, ties and repeated rows as in `mix`. The rows are written once with
    their places in the table, which tell rows of the same id apart; texts aren't shuffled: whether a row is taken follows
    from its own hash and place and the plan of its source."""
    columns = docs.columns
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"))
    row = whole.select("_row", n_words(F.col(f"_row.{text_col}")).alias("size"), F.col(f"_row.{source_col}").cast("string").alias("source"))
    row = row.withColumn("u", uniform_key(F.col(f"_row.{id_col}"), F.col("size"), F.col(f"_row.{text_col}"), seed)).withColumn("place", F.monotonically_increasing_id())
    row = written(row, "mixed")
    plan = mixing_plan(cut(row.select("source", "size", "u", "place")), weights, max_repeats).withColumnRenamed("source", "_source")
    out = row.join(small(plan), row["source"].eqNullSafe(plan["_source"]), "inner").withColumn("_n", _copies().cast("int")).where("_n > 0")
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*[F.col("_row").getField(c).alias(c) for c in columns])
