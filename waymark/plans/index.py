"""The text index: postings, vocabulary, and a table of prepared texts for scoring."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import tags as R
from waymark.functions import text as X
from waymark.operators.graph import cut, small
from waymark.sources.schema import ADMIN, HOUSE, POI, STREET, GeoDataset


def _named_areas(links: DataFrame, areas: DataFrame) -> DataFrame:
    """idx, all (words of the names of all linked areas), deep (of the last three). An area's words are made once; no rule of
    words looks past a space."""
    named = links.join(areas.select(F.col("idx").alias("area_idx"), X.tokens(F.col("name")).alias("words")), "area_idx")
    sets = named.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("ord", "words"))).alias("w"))
    words = lambda c: F.sort_array(F.array_distinct(F.flatten(c)))
    return sets.select("idx", words(F.col("w.words")).alias("all"), words(F.slice("w.words", F.greatest(F.size("w") - 2, F.lit(1)), F.lit(3))).alias("deep"))


def _placed(df: DataFrame, links: DataFrame, areas: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.join(_named_areas(links, areas), "idx", "left").withColumns({"_all": F.coalesce("all", none), "_deep": F.coalesce("deep", none)})


def _and_deep(own: Column) -> Column:
    """Words, and those of the last three areas."""
    return F.sort_array(F.array_union(own, F.col("_deep")))


def explode_tokens(df: DataFrame, toks: Column) -> DataFrame:
    """type, idx (a key of df) and their distinct tokens -> token, type, idx. As a row's tokens are distinct, each posting
    stands once without a shuffle."""
    return df.select(F.explode(toks).alias("token"), F.col("type").cast("byte").alias("type"), "idx")


def posting_counts(postings: DataFrame) -> DataFrame:
    """token, n."""
    return postings.groupBy("token").agg(F.count("*").alias("n"))


def and_match(postings: DataFrame, toks: list[str]) -> DataFrame:
    """type, idx of records that have all of toks. The tokens are pushed to the scan of the postings, which hold each
    (token, type, idx) once."""
    if not toks:
        return postings.select("type", "idx").where("false")
    found = postings.where(F.col("token").isin(toks)).groupBy("type", "idx").agg(F.count("*").alias("n"))
    return found.where(F.col("n") == len(set(toks))).select("type", "idx")


def vocabulary(*postings: DataFrame) -> DataFrame:
    out = postings[0].select("token")
    for p in postings[1:]:
        out = out.union(p.select("token"))
    return out.distinct()


def suffixes(vocab: DataFrame) -> DataFrame:
    """token, offset, suffix of all suffixes of tokens of 3 letters or more; sort by suffix to look up prefixes."""
    s = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct((i - 1).alias("offset"), F.substr(F.col("token"), i).alias("suffix")))
    return vocab.where(F.length("token") >= 3).select("token", F.explode(s).alias("s")).select("token", "s.offset", "s.suffix")


def _contains(token: str) -> tuple[Column, list[Column]]:
    """Which vocabulary tokens contain `token` (3 letters or more), and their order."""
    t = F.lit(token)
    keys = [F.when(F.startswith("token", t), 0).otherwise(1), F.abs(F.length("token") - len(token)), F.length("token")]
    return F.contains("token", t) if len(token) >= 3 else F.lit(False), keys


def _near(token: str) -> tuple[Column, list[Column]]:
    """Which vocabulary tokens are near `token` (4 letters or more) and share a seed with it, and their order."""
    if len(token) < 4:
        return F.lit(False), [F.length("token")] * 3
    most_edits = 1 if len(token) <= 5 else 2
    n = max(3, min(5, len(token) // (most_edits + 1)))
    seeds = sorted({token[i : i + n] for i in range(len(token) - n + 1)})
    d = F.levenshtein(F.col("token"), F.lit(token), most_edits)
    shares = R.any_of([F.contains("token", F.lit(s)) for s in seeds])
    return (F.abs(F.length("token") - len(token)) <= most_edits) & shares & (d >= 0), [d, -X.common_prefix(F.col("token"), F.lit(token)), F.length("token")]


def substring_expansions(vocab: DataFrame, token: str, most: int) -> DataFrame:
    """Up to `most` tokens that contain `token` (3 letters or more), those that start with it first, then the nearest in
    length, then in order."""
    found, keys = _contains(token)
    return vocab.where(found).orderBy(*keys, "token").limit(most)


def fuzzy_expansions(vocab: DataFrame, token: str, most: int) -> DataFrame:
    """Up to `most` tokens within edit distance 1 (2 for more than 5 letters) of `token` (4 letters or more) that share a
    seed with it, by (distance, longer common prefix, length, order)."""
    found, keys = _near(token)
    return vocab.where(found).orderBy(*keys, "token").limit(most).select("token")


def expansions(vocab: DataFrame, spellings: list[str], substrings: int, fuzzy: int) -> DataFrame:
    """spelling, fuzzy, rank (from 1), token: for each spelling what substring_expansions and fuzzy_expansions give, all in
    one pass over the vocabulary. Each partition keeps only its best before they meet."""
    hits = []
    for spelling in spellings:
        for near, (found, keys) in ((False, _contains(spelling)), (True, _near(spelling))):
            hits.append(F.when(found, F.struct(F.lit(spelling).alias("spelling"), F.lit(near).alias("fuzzy"), *[k.cast("int").alias(f"k{i}") for i, k in enumerate(keys)])))
    if not hits:
        return vocab.select(F.lit("").alias("spelling"), F.lit(False).alias("fuzzy"), F.lit(0).alias("rank"), "token").where("false")
    rows = vocab.select("token", F.explode(F.array_compact(F.array(*hits))).alias("h")).select("token", "h.*")
    rank = F.row_number().over(Window.partitionBy("spelling", "fuzzy").orderBy("k0", "k1", "k2", "token"))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= max(substrings, fuzzy))
    return top.where(F.col("rank") <= F.when(F.col("fuzzy"), fuzzy).otherwise(substrings)).select("spelling", "fuzzy", "rank", "token")


def _grams(letters: int = 3) -> Column:
    """The distinct runs of letters of `token`."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("token") - letters + 1, F.lit(1))), lambda i: F.substr(F.col("token"), i, F.lit(letters))))


def substring_join(vocab: DataFrame, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """token (of wanted), found, rank: for every wanted token what substring_expansions gives, all if most is None. A token
    meets the vocabulary at the rarest three of its letters, and is sought only in words that have these."""
    index = cut(vocab.where(F.length("token") >= 3).select(F.col("token").alias("found"), F.explode(_grams()).alias("gram")))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    asked = wanted.select("token").distinct().where(F.length("token") >= 3)
    grams = asked.select("token", F.explode(_grams()).alias("gram")).join(counts, "gram", "left")
    rarest = grams.groupBy("token").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.max(F.col("n").isNull()).alias("gap")).where("not gap")
    pairs = rarest.select("token", "gram").join(index, "gram").where(F.contains("found", "token")).select("token", "found")
    keys = [F.when(F.startswith("found", "token"), 0).otherwise(1), F.abs(F.length("found") - F.length("token")), F.length("found")]
    return _ranked(pairs, most, *keys)


def fuzzy_join(vocab: DataFrame, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """token (of wanted), found, rank: for every wanted token what fuzzy_expansions gives, all if most is None. Tokens meet words
    of a fitting length that have three of their letters, as any that shares a seed does; only those are compared."""
    index = vocab.select(F.col("token").alias("found"), F.length("token").alias("len"), F.explode(_grams()).alias("gram"))
    n = F.length("token")
    edits = F.when(n <= 5, 1).otherwise(2)
    seed = F.greatest(F.lit(3), F.least(F.lit(5), F.floor(n / (edits + 1)).cast("int")))
    asked = wanted.select("token").distinct().where(n >= 4).withColumns({"edits": edits, "seed": seed})
    seeds = F.array_distinct(F.transform(F.sequence(F.lit(1), n - F.col("seed") + 1), lambda i: F.substr(F.col("token"), i, F.col("seed"))))
    asked = asked.withColumn("seeds", seeds)
    starts = F.array_distinct(F.transform("seeds", lambda s: F.left(s, F.lit(3))))
    grams = asked.select("*", F.explode(starts).alias("gram")).select("*", F.explode(F.sequence(n - F.col("edits"), n + F.col("edits"))).alias("len"))
    pairs = grams.join(index, ["gram", "len"]).select("token", "edits", "seeds", "found").distinct()
    near = pairs.where(F.exists("seeds", lambda s: F.contains(F.col("found"), s)))
    d = F.when(F.col("edits") == 1, X.edit_distance(F.col("token"), F.col("found"), 1)).otherwise(X.edit_distance(F.col("token"), F.col("found"), 2))
    near = near.withColumn("d", d).where("d <= edits")
    return _ranked(near, most, F.col("d"), -X.common_prefix(F.col("found"), F.col("token")), F.length("found"))


def _ranked(pairs: DataFrame, most: int | None, *keys: Column) -> DataFrame:
    rows = pairs.select("token", "found", F.row_number().over(Window.partitionBy("token").orderBy(*keys, "found")).alias("rank"))
    return rows if most is None else rows.where(F.col("rank") <= most)


#: Which houses and streets are indexed.
_HOUSE, _STREET = "street != '' or house_number != ''", "name != ''"


def primary_postings(data: GeoDataset) -> DataFrame:
    """token, type, idx of the words of every indexed entity's own fields. They need no areas, hence neither join nor shuffle."""
    own = {
        HOUSE: (data.houses.where(_HOUSE), ("street", "house_number", "postcode")),
        STREET: (data.streets.where(_STREET), ("name",)),
        ADMIN: (data.admin_areas, ("name",)),
        POI: (data.pois, ("name", "brand", "category", "tag_value")),
    }
    parts = [explode_tokens(df.select(F.lit(kind).alias("type"), "idx", *fields), X.tokens(*(F.col(f) for f in fields))) for kind, (df, fields) in own.items()]
    return reduce(DataFrame.unionByName, parts)


def search_docs(data: GeoDataset, kinds: Sequence[int] = (HOUSE, STREET, ADMIN, POI)) -> DataFrame:
    """One row per indexed entity of some kinds with its prepared texts (see BUILT) and its context tokens; unused fields are empty."""
    areas, none, text, n = data.admin_areas, F.array().cast("array<string>"), F.lit(""), F.col("name")
    name = X.tokens(n)

    def row(df: DataFrame, kind: int, **given: Column) -> DataFrame:
        columns = {"name_norm": text, "label_norm": text, "brand_norm": text, "name_tokens": none, "number_tokens": none, "number_norm": text, "street_norm": text, "postcode_tokens": none, "city_tokens": none, "own_tokens": none, "brand_tokens": none, "admin_tokens": F.col("_all"), "context": none}
        return df.select(F.lit(kind).cast("byte").alias("type"), "idx", *[(given.get(c) if c in given else d).alias(c) for c, d in columns.items()])

    def houses() -> DataFrame:
        h = [F.col(c) for c in ("street", "house_number", "postcode", "city", "country")]
        rows = _placed(data.houses, data.house_admin, areas).where(_HOUSE)
        return row(rows, HOUSE, name_tokens=X.tokens(h[0]), number_tokens=X.tokens(h[1]), number_norm=X.normalize(h[1]), street_norm=X.normalize(h[0]), postcode_tokens=X.tokens(h[2]), city_tokens=X.tokens(h[3]), own_tokens=X.tokens(h[0]), context=_and_deep(X.tokens(*h)))

    def streets() -> DataFrame:
        rows = _placed(data.streets, data.street_admin, areas).where(_STREET)
        return row(rows, STREET, name_norm=X.normalize(n), name_tokens=name, own_tokens=name, context=_and_deep(name))

    def admin() -> DataFrame:
        return row(_placed(areas, data.admin_parent, areas), ADMIN, name_norm=X.normalize(n), name_tokens=name, own_tokens=name, context=_and_deep(name))

    def pois() -> DataFrame:
        p = [F.col(c) for c in ("name", "brand", "category", "tag_value")]
        label = X.normalize(R.poi_label(F.col("name"), F.col("brand"), F.col("category")))
        rows = _placed(data.pois, data.poi_admin, areas)
        return row(rows, POI, name_norm=X.normalize(p[0]), label_norm=label, brand_norm=X.normalize(p[1]), name_tokens=X.tokens(p[0], p[1]), own_tokens=X.tokens(*p), brand_tokens=X.tokens(p[1]), context=_and_deep(X.tokens(*p)))

    of = {HOUSE: houses, STREET: streets, ADMIN: admin, POI: pois}
    return reduce(DataFrame.unionByName, [of[k]() for k in kinds])


_DOC = ["type", "idx", "name_norm", "label_norm", "brand_norm", "name_tokens", "number_tokens", "number_norm", "street_norm", "postcode_tokens", "city_tokens", "own_tokens", "brand_tokens", "admin_tokens", "name_is_place", "has_place_token"]


def _flagged(docs: DataFrame, data: GeoDataset, later: bool = False) -> DataFrame:
    """docs, and their context (later: nothing is computed now), with name_is_place: some area's name has all words of the name; has_place_token: some area's name has one of them."""
    pairs = F.create_map(*[F.lit(x) for a, b in X.PLACE_PAIRS for x in (a, b, b, a)])
    areas = data.admin_areas
    names = data.streets.where(_STREET).select("name").distinct().select(X.tokens(F.col("name")).alias("name_tokens")).distinct()
    names = names if later else cut(names)
    area_words = areas.select("idx", F.explode(X.tokens(F.col("name"))).alias("token")).distinct()
    # a single word also counts under its name in the other language
    street_words = names.select("name_tokens", F.explode(F.when(F.size("name_tokens") == 1, F.array_compact(F.array(F.col("name_tokens")[0], pairs[F.col("name_tokens")[0]]))).otherwise(F.col("name_tokens"))).alias("token"))
    together = street_words.join(area_words, "token").groupBy("name_tokens", "idx").agg(F.count_distinct("token").alias("n")).where((F.col("n") == F.size("name_tokens")) | (F.size("name_tokens") == 1)).select("name_tokens").distinct().withColumn("name_is_place", F.lit(True))
    alias = F.arrays_overlap("name_tokens", F.map_keys(pairs))
    words = names.select("name_tokens", F.explode("name_tokens").alias("token"))
    touched = words.join(area_words.select("token").distinct(), "token", "left_semi").select("name_tokens").union(names.where(alias)).distinct().withColumn("has_place_token", F.lit(True))
    flags = names.join(together, "name_tokens", "left").join(touched, "name_tokens", "left").withColumn("type", F.lit(STREET).cast("byte"))
    # a name may be that of a large share of streets, which a shuffle by names would bring to one task
    flagged = docs.join(flags if later else small(cut(flags)), ["type", "name_tokens"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("name_is_place", "has_place_token")})
    return flagged.select(*_DOC, "context")


def prepared_docs(data: GeoDataset, kind: int) -> DataFrame:
    """What add_index gives as search_docs of one kind, without postings and without the other kinds, whose areas aren't sought."""
    docs = search_docs(data, [kind])
    if kind == STREET:
        return _flagged(docs, data).select(*_DOC)
    return docs.withColumns({c: F.lit(False) for c in ("name_is_place", "has_place_token")}).select(*_DOC)


def add_index(data: GeoDataset) -> GeoDataset:
    """data with postings_context, postings_primary, vocabulary and search_docs."""
    # every query meets the links again, so that they are computed here once
    links = {n: cut(data.tables[n]) for n in ("house_admin", "street_admin", "poi_admin", "admin_parent")}
    data = GeoDataset(data.tables | links, data.language)
    docs = cut(_flagged(search_docs(data), data))
    context, primary = cut(explode_tokens(docs, F.col("context"))), cut(primary_postings(data))
    tables = {"postings_context": context, "postings_primary": primary, "vocabulary": cut(vocabulary(context, primary)), "search_docs": docs.select(*_DOC)}
    return GeoDataset(data.tables | tables, data.language)


def add_words(data: GeoDataset) -> GeoDataset:
    """What add_index gives, for those who read words more than prepared texts: primary postings and the vocabulary are
    computed, without areas of entities; postings_context and search_docs, which need these, only when they are read, and at each time
    anew. The words that areas add to a context are those of their names, which primary postings have."""
    primary = cut(primary_postings(data))
    towns = data.houses.where(_HOUSE).select("city", "country").distinct().select(F.explode(X.tokens(F.col("city"), F.col("country"))).alias("token"))
    docs = search_docs(data, [HOUSE, ADMIN, POI]).withColumns({c: F.lit(False) for c in ("name_is_place", "has_place_token")})
    docs = docs.select(*_DOC, "context").unionByName(_flagged(search_docs(data, [STREET]), data, later=True))
    tables = {"postings_context": explode_tokens(docs, F.col("context")), "postings_primary": primary, "vocabulary": cut(vocabulary(primary, towns)), "search_docs": docs.select(*_DOC)}
    return GeoDataset(data.tables | tables, data.language)
