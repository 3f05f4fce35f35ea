"""Text normalization, tokens and token matching, as Columns and, for single queries on the driver, in Python."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are spelled out, street words that count as one, place names in two languages.
SPELLED = {"Ä": "ae", "ä": "ae", "Ö": "oe", "ö": "oe", "Ü": "ue", "ü": "ue", "ß": "ss", "É": "e", "é": "e"}
STREET_WORDS = ("str", "strasse", "strasze")
PLACE_PAIRS = (("vienna", "wien"), ("zurich", "zuerich"), ("munich", "muenchen"), ("cologne", "koeln"), ("nuremberg", "nuernberg"), ("nice", "nizza"))
PLACE_NAMES = tuple(p for pair in PLACE_PAIRS for p in pair)
STREET_TOKENS = ("str", "avenue", "ave", "boulevard", "lane", "drive", "square")
STREET_ENDINGS = ("str", "strasse", "strasze", "street", "road", "weg", "gasse", "allee", "platz", "ring")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalize(text: Column) -> Column:
    """Lower-case ASCII words with single spaces between; umlauts spelled out, combining marks dropped. Null: empty. Only
    texts with a character beyond ASCII (more bytes than characters) go through the replacements."""
    raw = F.coalesce(text, F.lit(""))
    spelled = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), SPELLED.items(), raw)
    plain = F.translate(F.regexp_replace(spelled, r"[\x{0300}-\x{033F}]", ""), UPPER, LOWER)
    lowered = F.when(F.octet_length(raw) == F.char_length(raw), F.lower(raw)).otherwise(plain)
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def ordered_tokens(text: Column) -> Column:
    """Words in order, repeats kept, street words unified."""
    norm = normalize(text)
    unified = F.when(F.contains(norm, F.lit("str")), F.regexp_replace(norm, rf"\b(?:{'|'.join(STREET_WORDS)})\b", "strasse")).otherwise(norm)
    return F.array_remove(F.split(unified, " "), "")


def tokens(*texts: Column) -> Column:
    """The distinct words of all texts, sorted. The texts are normalized as one: no rule looks past a space."""
    return F.sort_array(F.array_distinct(ordered_tokens(texts[0] if len(texts) == 1 else F.concat_ws(" ", *texts))))


def numbers(toks: Column) -> Column:
    """Tokens with a digit that aren't postcodes."""
    return F.filter(toks, lambda t: t.rlike("[0-9]") & ~t.rlike("^[0-9]{5}$"))


def postcodes(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike("^[0-9]{5}$"))


def words(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~t.rlike("[0-9]"))


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether normalized text holds a normalized phrase at word boundaries; an empty phrase never."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return (phrase != "") & F.contains(padded, F.concat(F.lit(" "), phrase, F.lit(" ")))


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance; most + 1 where it is larger."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.left(a, i) == F.left(b, i)))
    return F.size(same)


def match_quality(query: Column, token: Column) -> Column:
    """How well a token answers a query token: 1400 if equal, 0 if not at all."""
    lq, lt, p = F.length(query), F.length(token), common_prefix(query, token)
    penalty = F.least(F.lit(220), 18 * F.abs(lq - lt))
    street = F.endswith(query, F.lit("str")) & F.startswith(token, query) & F.substr(token, lq + 1, F.lit(4)).isin("asse", "asze")
    most = F.when(lq <= 5, 1).otherwise(2)
    d = F.when(lq <= 5, edit_distance(query, token, 1)).otherwise(edit_distance(query, token, 2))
    fuzzy = 620 - 170 * d + 55 * p - penalty - F.when((p < 2) & (lq >= 5), 220).otherwise(0)
    return (
        F.when((lq == 0) | (lt == 0), 0)
        .when(query == token, 1400)
        .when((lq < 3) | (lt < 3), 0)
        .when(street, F.greatest(F.lit(0), 1450 + 30 * p - penalty))
        .when(F.startswith(token, query), F.greatest(F.lit(0), 1150 + 25 * p - penalty))
        .when((lq >= 4) & F.contains(token, query), F.greatest(F.lit(0), 820 + 18 * p - penalty))
        .when((d <= most) & (fuzzy >= 120), fuzzy)
        .otherwise(0)
    )


def best_quality(alternatives: Column, toks: Column) -> Column:
    """The best match_quality between any alternative and any token; 0 without."""
    each = F.flatten(F.transform(alternatives, lambda a: F.transform(toks, lambda t: match_quality(a, t))))
    return F.coalesce(F.array_max(each), F.lit(0))


def matches(query: Column, toks: Column) -> Column:
    """Number of distinct query tokens among toks."""
    return F.size(F.array_intersect(query, toks))


def has_all(toks: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, toks)) == 0


def street_like(token: Column) -> Column:
    ends = reduce(lambda a, b: a | b, [F.endswith(token, F.lit(e)) for e in STREET_ENDINGS])
    return token.isin(*STREET_TOKENS) | ((F.length(token) >= 4) & (ends | F.contains(token, F.lit("strasse")) | F.contains(token, F.lit("strasze"))))


def same_street(query: list[str], toks: Column) -> Column:
    """Sorted name tokens equal the sorted query tokens, one by one, street forms being equal."""
    pairs = [F.element_at(toks, i + 1).isin(sorted(street_forms(q))) for i, q in enumerate(query)]
    return (F.size(toks) == len(query)) & reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in pairs], F.lit(bool(query)))


_FORMS = ("street", *STREET_WORDS)


def same_street_as(query: Column, toks: Column) -> Column:
    """same_street for query words in a column."""
    same = F.zip_with(query, toks, lambda q, t: (q == t) | (q.isin(*_FORMS) & t.isin(*_FORMS)))
    return (F.size(query) > 0) & (F.size(query) == F.size(toks)) & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def other_name(token: Column) -> Column:
    """A place's name in the other language; null for other words."""
    return F.create_map(*[F.lit(x) for a, b in PLACE_PAIRS for x in (a, b, b, a)])[token]


def place_variants_of(toks: Column) -> Column:
    """place_variants of tokens in a column."""
    other = other_name(F.get(toks, F.lit(0)))
    return F.when((F.size(toks) == 1) & other.isNotNull(), F.array(toks, F.array(other))).otherwise(F.array(toks))


def equals_place(text: Column, norm: Column, words: Column) -> Column:
    """Whether a normalized text is a query's own (norm), or what its words are called as a place, in either language."""
    return (text == norm) | F.array_contains(F.transform(place_variants_of(words), lambda v: F.array_join(v, " ")), text)


def word_variants_of(toks: Column) -> Column:
    """The words, and the words with each place name exchanged for its other name."""
    exchanged = F.transform(toks, lambda w, i: F.when(other_name(w).isNotNull(), F.transform(toks, lambda x, j: F.when(i == j, other_name(x)).otherwise(x))))
    return F.concat(F.array(toks), F.array_compact(exchanged))


def inserted_e_of(token: Column) -> Column:
    """inserted_e of a token in a column."""
    n = F.length(token)
    at = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(token, i, F.lit(1)).isin("a", "o", "u") & (F.substr(token, i + 1, F.lit(1)) != "e"))
    spelled = F.transform(F.slice(at, 1, 4), lambda i: F.concat(F.substr(token, F.lit(1), i), F.lit("e"), F.substr(token, i + 1)))
    return F.when(n.between(4, 32), spelled).otherwise(F.array().cast("array<string>"))


def street_forms_of(token: Column) -> Column:
    """street_forms of a token in a column, sorted."""
    return F.when(token.isin(*_FORMS), F.array(*map(F.lit, sorted(_FORMS)))).otherwise(F.array(token))


def alternatives_of(token: Column) -> Column:
    """alternatives of a token in a column."""
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(token, other_name(token))), inserted_e_of(token), street_forms_of(token))))


# The same for one query on the driver.


def normalize_py(text: str) -> str:
    for a, b in SPELLED.items():
        text = text.replace(a, b)
    text = re.sub("[\u0300-\u033f]", "", text.translate(str.maketrans(UPPER, LOWER)))
    return re.sub("[^a-z0-9]+", " ", text).strip(" ")


def ordered_tokens_py(text: str) -> list[str]:
    return ["strasse" if t in STREET_WORDS else t for t in normalize_py(text).split()]


def tokens_py(text: str) -> list[str]:
    return sorted(set(ordered_tokens_py(text)))


def street_forms(token: str) -> set[str]:
    """The token, and the other words for street where it is one."""
    return {token, "street", *STREET_WORDS} if token in (*STREET_WORDS, "street") else {token}


def inserted_e(token: str) -> list[str]:
    """Up to four variants with an e after a, o or u: what a dropped umlaut is spelled as."""
    if not 4 <= len(token) <= 32:
        return []
    at = [i for i, c in enumerate(token) if c in "aou" and token[i + 1 : i + 2] != "e"]
    return [token[: i + 1] + "e" + token[i + 1 :] for i in at[:4]]


def place_variants(toks: list[str]) -> list[list[str]]:
    """The tokens, and for a single one its name in the other language."""
    other = [b for pair in PLACE_PAIRS for a, b in (pair, pair[::-1]) if toks == [a]]
    return [list(toks), *([o] for o in other)]


def is_place_alias(token: str) -> bool:
    return any(token in pair for pair in PLACE_PAIRS)


def street_like_py(token: str) -> bool:
    return token in STREET_TOKENS or (len(token) >= 4 and (token.endswith(STREET_ENDINGS) or "strasse" in token or "strasze" in token))


def alternatives(token: str) -> list[str]:
    """All spellings of a query token: itself, its place name in the other language, inserted e, street forms."""
    return sorted({token, *(v[0] for v in place_variants([token])), *inserted_e(token), *street_forms(token)})
