"""What a natural-language query asks for. Pure functions over one short text."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from waymark.functions import rules as K
from waymark.functions.text import normalize_py, ordered_tokens_py

NAMED, CATEGORY, CONCEPT, UNKNOWN = "named_poi_in_place", "nearest_category_to_address", "nearest_concept_to_address", "unknown"


@dataclass(frozen=True)
class Intent:
    type: str = UNKNOWN
    poi_name: str = ""
    place: str = ""
    category: str = ""
    concept: str = ""
    product_family: str = ""
    address: str = ""
    reference_category: str = ""
    from_model: bool = False
    verified: bool = False
    corrected: str = ""
    summary: str = ""


def _after_in(norm: str) -> str:
    at = norm.find(" in ")
    return norm[at + 4 :].strip() if at >= 0 else ""


def deterministic(query: str) -> Intent:
    """Brand, then "at X", product family, category, fast food, short name, nearest X to Y, "X in Y"."""
    norm, toks = normalize_py(query), ordered_tokens_py(query)
    for phrase, name in K.BRANDS:
        if f" {phrase} " in f" {norm} ":
            return Intent(NAMED, poi_name=name, place=_after_in(norm))
    for i, t in enumerate(toks[:-1]):
        if t in ("at", "bei"):
            name = []
            for w in toks[i + 1 :]:
                if w in ("in", "near", "around", "nahe"):
                    break
                name.append(w)
            if 1 <= len(name) <= 3 and not any(map(K.category, name)):
                return Intent(NAMED, poi_name=" ".join(name), place=_after_in(norm))
    target, family, reference = K.target_phrase(query), K.family_in(query), K.reference_category(query)
    if family:
        return Intent(CONCEPT, product_family=family, concept=K.families()[family][0], reference_category=reference)
    words = ordered_tokens_py(target)
    if category := K.category(target) or ("fast_food" if len(words) == 1 and words[0] in K.FAST_FOOD_WORDS else ""):
        return Intent(CATEGORY, category=category, reference_category=reference)
    if target and len(words) <= 3 and not K.family_in(target):
        return Intent(NAMED, poi_name=target, place=_after_in(norm))
    if norm.split(" ")[0] in K.NEAREST_WORDS and len(toks) >= 2:
        for separator in ("to", "near", "nearby", "bei", "an", "in der naehe von", "in der nahe von"):
            if separator in norm:
                before, _, after = norm.partition(separator)
                left = ordered_tokens_py(before)
                if len(left) >= 2 and after.strip() and (category := K.category(left[-1])):
                    return Intent(CATEGORY, category=category, address=after.strip())
                break
        if category := K.category(toks[-1]):
            return Intent(CATEGORY, category=category)
    if not set(toks) & set(K.ASKING_WORDS) and "in" in toks[1:-1]:
        at = toks.index("in", 1)
        return Intent(NAMED, poi_name=" ".join(toks[:at]), place=" ".join(toks[at + 1 :]))
    return Intent()


def parse_model_json(text: str) -> Intent:
    """The intent that a model's answer holds; unknown if it holds none. Fields go by several names."""
    try:
        start = text.index("{")
        fields = json.JSONDecoder().raw_decode(text[start:])[0]
    except ValueError:
        return Intent()
    get = lambda *names: next((str(fields[n]).strip() for n in names if isinstance(fields.get(n), str) and fields[n].strip()), "")
    reference = next((c for n in ("referenceCategory", "reference_category", "nearCategory", "anchorCategory") if (c := K.category(get(n)))), "")
    kind, out = get("intent", "naturalIntent", "type"), Intent(summary=get("interpretation", "summary"), from_model=True)
    address = normalize_py(get("address"))
    if kind == NAMED:
        out = replace(out, type=NAMED, poi_name=normalize_py(get("poiName", "poi_name", "name", "brand")), place=normalize_py(get("place", "city")))
    elif kind == CATEGORY:
        category, concept = K.category(get("category")), K.concept(get("category"))
        if category:
            out = replace(out, type=CATEGORY, category=category, address=address)
        elif concept:
            out = replace(out, type=CONCEPT, concept=concept, address=address)
    elif kind in (CONCEPT, "nearest_product_to_address", "nearest_service_to_address", "nearest_need_to_address"):
        family = K.family(get("productFamily")) or K.family(get("family"))
        concept = K.concept(get("concept")) or K.concept(get("category")) or (K.families()[family][0] if family else "")
        out = replace(out, type=CONCEPT if concept else UNKNOWN, concept=concept, product_family=family, address=address)
    return replace(out, reference_category=reference or (K.reference_category(out.address) if out.address else ""))


def corrected(intent: Intent, query: str) -> Intent:
    """A model's intent set right by what the query says outright: a product, a service, a target, a reference."""
    family, service, target = K.family_in(query), K.service_in(query), K.target_concept(query)
    if family:
        wanted = replace(intent, type=CONCEPT, product_family=family, concept=K.families()[family][0])
        intent = replace(wanted, corrected="product phrase") if wanted != intent else intent
    for concept, why in ((service, "service phrase"), ("" if family or service else target, "target phrase")):
        if concept and (intent.type, intent.concept, intent.product_family) != (CONCEPT, concept, ""):
            intent = replace(intent, type=CONCEPT, concept=concept, product_family="", category="", corrected=why)
    reference = K.reference_category(query)
    if reference != intent.reference_category:
        intent = replace(intent, reference_category=reference, corrected="reference category" if intent.reference_category else intent.corrected)
    return intent


def from_model(query: str, generate: Callable[[str], str], passes: int = 2) -> Intent:
    """An intent by a model: one answer, `passes` times shown again to be verified, then set right. generate: prompt ->
    text. A verification without a usable answer leaves the last one."""
    shape = 'Answer with one JSON object: {"intent": "named_poi_in_place" | "nearest_category_to_address" | "nearest_concept_to_address", "poiName", "place", "category", "concept", "productFamily", "address", "referenceCategory", "interpretation"}.'
    names = f"Concepts: {', '.join(K.concepts())}. Product families: {', '.join(K.families())}."
    answer = generate(f"{shape}\n{names}\nQuery: {query}")
    intent = parse_model_json(answer)
    for _ in range(passes):
        again = generate(f"{shape}\n{names}\nQuery: {query}\nCheck this answer and correct it where it is wrong: {answer}")
        if (checked := parse_model_json(again)).type != UNKNOWN:
            answer, intent = again, replace(checked, verified=True)
    return corrected(intent, query)


def place_spans(query: str) -> list[list[str]]:
    """What may be the place in a query, best first: up to five words after a preposition, from the last one back."""
    toks, out = ordered_tokens_py(query), []
    for pos in range(len(toks) - 1, -1, -1):
        if toks[pos] not in K.PLACE_WORDS:
            continue
        if toks[pos + 1 : pos + 2] and toks[pos + 1] in ("der", "die", "dem", "the") and toks[pos + 2 : pos + 3] and toks[pos + 2] in ("naehe", "nahe"):
            continue
        for end in range(min(len(toks), pos + 6), pos + 1, -1):
            span = toks[pos + 1 : end]
            while span and span[0] in ("the", "der", "die", "das", "dem", "den"):
                span = span[1:]
            while span and span[-1] in ("near", "nahe", "naehe", "around"):
                span = span[:-1]
            if span:
                out.append(span)
    return out if len(toks) >= 2 else []


def anchor_refusal(query: str, address: str, from_model_: bool, is_place: Callable[[list[str]], bool]) -> str:
    """Why an address can't be an origin; empty if it can. is_place: whether one of some words names an area."""
    toks = ordered_tokens_py(address)
    if not toks:
        return "empty address anchor"
    if from_model_ and not set(toks) <= set(ordered_tokens_py(query)):
        return "address anchor was not present in the user query"
    if set(toks) & set(K.VAGUE_WORDS):
        return "address anchor is a vague phrase, not a concrete place or address"
    if any(c.isdigit() for t in toks for c in t):
        return ""
    meaningful = [t for t in toks if t not in K.GENERIC_WORDS and t not in K.VAGUE_WORDS]
    if not meaningful:
        return "address anchor only contains generic category words"
    return "" if is_place(meaningful) or is_place(toks) else "address anchor has no house number, postcode, or loaded place name"
