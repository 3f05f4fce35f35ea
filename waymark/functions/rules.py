"""Rule tables of concept search, and looking names up in them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.bind import bind
from waymark.functions.text import has_phrase, matches, normalize, normalize_py, ordered_tokens_py, tokens

# Concepts, each with its label and the tags that offer it (key=value:weight).
CONCEPTS = """
personal_care | personal care products | shop=chemist:100 shop=cosmetics:95 amenity=pharmacy:85 shop=supermarket:55
medicine | medicine and pharmacy products | amenity=pharmacy:100
bakery_food | bread and bakery products | shop=bakery:100 shop=supermarket:65 shop=convenience:50
groceries | groceries | shop=supermarket:100 shop=convenience:75 shop=greengrocer:70 shop=deli:60
electronics_accessories | electronics accessories | shop=electronics:100 shop=mobile_phone:95 shop=computer:90 shop=supermarket:45
clothing | clothing | shop=clothes:100 shop=fashion:95 shop=department_store:75 shop=sports:45
shoes | shoes | shop=shoes:100 shop=sports:65 shop=department_store:55
books_stationery | books and stationery | shop=books:100 shop=stationery:95 shop=department_store:45
flowers | flowers | shop=florist:100 shop=garden_centre:80 shop=supermarket:40
bike_service | bike parts and repair | shop=bicycle:100
car_service | car parts and repair | shop=car_repair:100 shop=car_parts:95 shop=tyres:90
fuel | fuel | amenity=fuel:100
restaurant | restaurants | amenity=restaurant:100 amenity=cafe:70 amenity=fast_food:65
fast_food | fast food | amenity=fast_food:100
hotel | hotels | tourism=hotel:100
hospital | hospitals | amenity=hospital:100
school | schools | amenity=school:100 amenity=university:60
park | parks | leisure=park:100 leisure=garden:80 landuse=recreation_ground:70 landuse=village_green:70
banking | banking | amenity=bank:100
parking | parking | amenity=parking:100
sports | sports equipment and facilities | shop=sports:100 leisure=sports_centre:70 leisure=swimming_pool:55
toys_games | toys and games | shop=toys:100 shop=games:95 shop=department_store:50
jewelry | jewelry and watches | shop=jewelry:100 shop=watches:95
hardware | hardware and DIY | shop=hardware:100 shop=doityourself:95 shop=paint:85 shop=garden_centre:60
furniture_home | furniture and home goods | shop=furniture:100 shop=houseware:85 shop=interior_decoration:80
optician | glasses and contact lenses | shop=optician:100
pet_supplies | pet supplies | shop=pet:100
photo_printing | photo and printing services | shop=photo:100 shop=copyshop:95 shop=stationery:50
hair_beauty | hair and beauty services | shop=hairdresser:100 shop=beauty:90 shop=cosmetics:60
hairdresser | hairdressers | shop=hairdresser:100
locksmith | locksmith and key services | shop=locksmith:100 craft=locksmith:100
laundry | laundry and dry cleaning | shop=laundry:100 shop=dry_cleaning:100
parcel_delivery | parcel and postal services | amenity=post_office:100 shop=parcel:95 shop=parcel_locker:90
dentist | dentists | amenity=dentist:100
public_toilet | public toilets | amenity=toilets:100
charging | vehicle charging stations | amenity=charging_station:100
atm | cash machines | amenity=atm:100
cafe | cafes and coffee shops | amenity=cafe:100
"""

# Product families, each with its concept, label and tags.
FAMILIES = """
cosmetics_removal | personal_care | cosmetics removal | shop=chemist:100 shop=cosmetics:95 amenity=pharmacy:70 shop=supermarket:45
hair_body_care | personal_care | hair and body care | shop=chemist:100 shop=cosmetics:90 shop=supermarket:65 amenity=pharmacy:50
dental_care | personal_care | dental care | shop=chemist:100 amenity=pharmacy:90 shop=supermarket:65
baby_hygiene | personal_care | baby hygiene | shop=chemist:100 shop=supermarket:90 amenity=pharmacy:75
cold_medicine | medicine | cold medicine | amenity=pharmacy:100
pain_allergy_medicine | medicine | pain and allergy medicine | amenity=pharmacy:100
first_aid | medicine | first aid | amenity=pharmacy:100 shop=chemist:70
bread_pastry | bakery_food | bread and pastry | shop=bakery:100 shop=supermarket:65 shop=convenience:45
cake_sweets | bakery_food | cakes and sweets | shop=bakery:100 shop=confectionery:95 shop=supermarket:55
daily_groceries | groceries | daily groceries | shop=supermarket:100 shop=convenience:75 shop=deli:55
fruit_vegetables | groceries | fruit and vegetables | shop=greengrocer:100 shop=supermarket:80
pet_food | pet_supplies | pet food | shop=pet:100 shop=supermarket:55
phone_accessories | electronics_accessories | phone accessories | shop=mobile_phone:100 shop=electronics:95 shop=computer:70 shop=supermarket:35
computer_accessories | electronics_accessories | computer accessories | shop=computer:100 shop=electronics:95 shop=supermarket:35
printer_supplies | electronics_accessories | printer supplies | shop=computer:100 shop=electronics:90 shop=stationery:70
outerwear | clothing | outerwear | shop=clothes:100 shop=fashion:95 shop=department_store:80 shop=sports:50
basic_clothing | clothing | basic clothing | shop=clothes:100 shop=fashion:90 shop=department_store:75
running_shoes | shoes | running shoes | shop=shoes:100 shop=sports:95 shop=department_store:50
books | books_stationery | books | shop=books:100 shop=department_store:40
stationery | books_stationery | stationery | shop=stationery:100 shop=books:70 shop=department_store:40
flowers_plants | flowers | flowers and plants | shop=florist:100 shop=garden_centre:85 shop=supermarket:35
garden_supplies | hardware | garden supplies | shop=garden_centre:100 shop=doityourself:90 shop=hardware:70
diy_tools | hardware | DIY tools | shop=hardware:100 shop=doityourself:95
paint_supplies | hardware | paint supplies | shop=paint:100 shop=doityourself:90 shop=hardware:70
bike_parts_repair | bike_service | bike parts and repair | shop=bicycle:100
car_parts | car_service | car parts | shop=car_parts:100 shop=tyres:95 shop=car_repair:85
glasses_lenses | optician | glasses and lenses | shop=optician:100
photo_documents | photo_printing | photo and document services | shop=photo:100 shop=copyshop:95 shop=stationery:45
hair_services | hair_beauty | hair services | shop=hairdresser:100 shop=beauty:50
beauty_products | hair_beauty | beauty products | shop=beauty:100 shop=cosmetics:95 shop=chemist:70
toys | toys_games | toys | shop=toys:100 shop=department_store:50
games | toys_games | games | shop=games:100 shop=toys:80 shop=department_store:45
jewelry_watches | jewelry | jewelry and watches | shop=jewelry:100 shop=watches:90
watch_repair_battery | jewelry | watch repair and batteries | shop=watches:100 shop=jewelry:80
home_furniture | furniture_home | home furniture | shop=furniture:100 shop=interior_decoration:75 shop=houseware:70
home_textiles | furniture_home | home textiles | shop=houseware:100 shop=furniture:80 shop=interior_decoration:80
sports_equipment | sports | sports equipment | shop=sports:100 leisure=sports_centre:40
"""

# Names of categories, concepts and families in queries (target: names).
CATEGORY_NAMES = """
park: park, parks, garden, green space, green area, garten, gruenflaeche, grunflache, gruenanlage, grunanlage
restaurant: restaurant, restaurants
cafe: cafe, cafes, coffee shop, kaffee, kaffeehaus
fast_food: fast food, fastfood, schnellrestaurant, imbiss
shop: shop, shops, store, stores, laden, laeden, ladenen, geschaeft, geschaefte, geschaft, geschafte
supermarket: supermarket, supermarkets, supermarkt, supermaerkte, supermarkte, supermaerkten, supermarkten
fuel: tankstelle, fuel, fuel station, gas station, petrol station
hotel: hotel, hotels, hostel, hostels
hospital: hospital, hospitals, krankenhaus
school: school, schools, schule
museum: museum, museums, museen
university: university, universities, universitaet, universitat
station: railway station, train station, station, bahnhof
pharmacy: pharmacy, pharmacies, apotheke
bakery: bakery, bakeries, baeckerei, backerei
"""
CONCEPT_NAMES = """
personal_care: cosmetics, drugstore, drogerie, koerperpflege, korperpflege, hygiene
medicine: pharmacy, medicine, medication, apotheke, medizin, arznei
bakery_food: bakery, bread, baeckerei, backerei, brot
groceries: food, groceries, supermarket, lebensmittel, supermarkt
electronics_accessories: electronics, phone_accessories, elektronik, handy_zubehoer, handy_zubehor
bike_service: bike, bicycle, fahrrad
car_service: car, auto
books_stationery: books, stationery, buch, buecher, bucher, schreibwaren
flowers: flower, blumen
"""
FAMILY_NAMES = """
cosmetics_removal: nail_polish_remover, makeup_remover, nagellackentferner, abschminke
hair_body_care: shampoo, deodorant, sunscreen, sonnencreme, deo
dental_care: toothpaste, zahnpasta
baby_hygiene: diapers, windeln, baby_diapers, babywindeln
cold_medicine: cough_syrup, hustensaft, nasal_spray, throat_lozenges
pain_allergy_medicine: painkillers, schmerztabletten, allergy_tablets, allergietabletten
first_aid: bandages, verband
bread_pastry: bread, croissants, brot
cake_sweets: cake, birthday_cake, geburtstagstorte
phone_accessories: phone_charger, usb_cable, handyladegeraet, handyladegerat, ladegeraet, ladegerat, ladekabel, ladestecker, handy_ladegeraet, handy_ladegerat, usb_kabel
printer_supplies: printer_ink, druckerpatronen
bike_parts_repair: bike_repair, bicycle_inner_tube, fahrrad_reparatur, fahrradschlauch
"""

# Phrases in queries; the first that occurs decides, so their order counts.
FAMILY_PHRASES = """
cosmetics_removal: nail polish remover, nagellackentferner
hair_body_care: shampoo, deodorant, deo, sunscreen, sonnencreme
dental_care: toothpaste, zahnpasta, dental floss, zahnseide
baby_hygiene: diapers, windeln, babywindeln
cold_medicine: cough syrup, hustensaft, nasenspray, nasal spray
pain_allergy_medicine: painkillers, schmerztabletten, allergy tablets, allergietabletten
first_aid: bandages, verband
bread_pastry: fresh bread, bread, brot, croissants
cake_sweets: birthday cake, cake, geburtstagstorte
daily_groceries: milk, milch, kaffeebohnen, coffee beans
fruit_vegetables: bananas, bananen
pet_food: pet food, tierfutter, cat food, dog food, katzenfutter, hundefutter, hundeleckerlis
phone_accessories: phone charger, usb cable, handyladegeraet, handyladegerat, ladegeraet, ladegerat, ladekabel, ladestecker, handy ladegeraet, handy ladegerat, usb kabel, headphones, kopfhoerer, kopfhorer
computer_accessories: laptop mouse, computermaus
printer_supplies: printer ink, druckerpatronen, druckertinte
outerwear: winter jacket, winterjacke
basic_clothing: socks, socken
running_shoes: running shoes, laufschuhe
books: novel, roman
stationery: notebook, notizbuch, envelopes, briefumschlaege, briefumschlage
flowers_plants: roses, rosen
garden_supplies: potting soil, blumenerde
diy_tools: screwdriver, schraubenzieher
paint_supplies: wall paint, wandfarbe
bike_parts_repair: bike, bicycle, fahrrad, fahrradschlauch
car_parts: wiper blades, scheibenwischer
glasses_lenses: reading glasses, lesebrille, contact lenses, kontaktlinsen
photo_documents: passport photos, passfotos, document copies, print documents, printing documents, documents printed, dokumente, kopieren
hair_services: haircut, haare schneiden
beauty_products: hair dye, haarfarbe
toys: toy car, spielzeugauto
games: board game, brettspiel
jewelry_watches: necklace, halskette
watch_repair_battery: watch battery, uhrenbatterie
home_furniture: sofa
home_textiles: pillow, kissen
sports_equipment: football, fussball
"""
SERVICE_PHRASES = """
public_toilet: public toilet, public restroom, oeffentliche toilette, offentliche toilette
charging: charging station, charging stations, ev charging, ladestation, ladestationen, ladesaeule, ladesaule
laundry: dry cleaning, dry cleaner, waescherei, wascherei, textilreinigung, reinigung
locksmith: locksmith, locked out, key copied, key cutting, schluesseldienst, schlusseldienst, schluessel nachmachen, schlussel nachmachen
hairdresser: hairdresser, barber, friseur, haare schneiden
parcel_delivery: send a parcel, drop a parcel, parcel delivery, parcel service, paket abgeben, paket versenden, paketdienst
dentist: dentist, zahnarzt
atm: atm, cash machine, geldautomat, geldautomaten
cafe: coffee, kaffee
flowers: flowers, flower shop, blumen
parking: parking, car park, parkplatz, parken, can i park, where can i park
"""
TARGET_WORDS = """
restaurant: restaurant, restaurants
medicine: pharmacy, pharmacies, apotheke
bakery_food: bakery, baeckerei, backerei
optician: eyeglasses, glasses, optician, brille, optiker
furniture_home: furniture, moebel, mobel
hairdresser: hairdresser, barber, friseur
locksmith: locksmith, schluesseldienst, schlusseldienst
hospital: hospital, hospitals, krankenhaus, krankenhaeuser, krankenhauser
park: park, parks
shoes: shoe, shoes, schuhgeschaeft, schuhgeschaft, schuhgeschaefte, schuhgeschafte
flowers: flower, flowers, blumen
"""
BRANDS = (("mcdonalds", "McDonald's"), ("mc donalds", "McDonald's"), ("mc donald s", "McDonald's"), ("mercedes benz", "Mercedes-Benz"), ("mueller", "mueller"), ("muller", "mueller"), ("h m", "H&M"), ("h und m", "H&M"), ("c a", "C&A"), ("c und a", "C&A"))

# Words that queries are read by.
LEAD_WORDS = "where can i find buy get repair print use show me please need want drop is are wo finde ich suche bekomme kaufen reparieren drucken kann kannst brauche moechte mochte abgeben gibt es mir".split()
STOP_WORDS = "near around nearby bei nahe close in an".split()
NOISE_WORDS = "the a an eine einen ein der die das for to".split()
NAME_SUFFIXES = "restaurant restaurants store stores shop shops branch branches location locations dealership showroom supermarket petrol fuel station filiale filialen laden markt autohaus tankstelle paketshop".split()
REFERENCE_WORDS = "near around nearby at by close with bei nahe mit naehe nahebei".split()
PLACE_WORDS = "in near around bei nahe".split()
FAST_FOOD_WORDS = "burger burgers hamburger hamburgern pommes fries".split()
ASKING_WORDS = "where find buy get repair wo finde bekomme kaufen reparatur".split()
NEAREST_WORDS = "closest nearest naechster nachster naechste nachste".split()
VAGUE_WORDS = "some any nearby here there local closest nearest next einige irgendwelche irgendein irgendeine irgendwo hier dort nahebei".split()
GENERIC_WORDS = (
    "a an the to of for and und der die das ein eine einen near around in at by me bei nahe naehe mir mich hotel hotels hostel hostels restaurant restaurants cafe cafes "
    "shop shops store stores place places poi pois laden laeden ladenen geschaeft geschaefte geschaft geschafte ort orte punkt punkte"
).split()


def _rows(text: str, mark: str = "|") -> list[list[str]]:
    return [[x.strip() for x in line.split(mark)] for line in text.strip().splitlines()]


@lru_cache
def _pairs(text: str) -> tuple[tuple[str, str], ...]:
    """(name, target) in order."""
    return tuple((n.strip(), target) for target, names in _rows(text, ":") for n in names.split(","))


def _tags(text: str) -> list[tuple[str, str, int]]:
    return [(key, value, int(weight)) for key, _, rest in (t.partition("=") for t in text.split()) for value, _, weight in [rest.partition(":")]]


@lru_cache
def concepts() -> dict[str, tuple[str, list[tuple[str, str, int]]]]:
    """name -> (label, tags)."""
    return {name: (label, _tags(tags)) for name, label, tags in _rows(CONCEPTS)}


@lru_cache
def families() -> dict[str, tuple[str, str, list[tuple[str, str, int]]]]:
    """name -> (concept, label, tags)."""
    return {name: (concept, label, _tags(tags)) for name, concept, label, tags in _rows(FAMILIES)}


def concept_table(spark: SparkSession) -> DataFrame:
    rows = [(n, label, k, v, w, i) for n, (label, tags) in concepts().items() for i, (k, v, w) in enumerate(tags)]
    return spark.createDataFrame(rows, "name string, label string, tag_key string, tag_value string, weight int, ord int")


def family_table(spark: SparkSession) -> DataFrame:
    rows = [(n, c, label, k, v, w, i) for n, (c, label, tags) in families().items() for i, (k, v, w) in enumerate(tags)]
    return spark.createDataFrame(rows, "name string, concept string, label string, tag_key string, tag_value string, weight int, ord int")


def _key(text: str) -> str:
    return normalize_py(text).replace(" ", "_")


def category(text: str) -> str:
    return dict(_pairs(CATEGORY_NAMES)).get(normalize_py(text), "")


def concept(text: str) -> str:
    return _key(text) if _key(text) in concepts() else dict(reversed(_pairs(CONCEPT_NAMES))).get(_key(text), "")


def family(text: str) -> str:
    return _key(text) if _key(text) in families() else dict(reversed(_pairs(FAMILY_NAMES))).get(_key(text), "")


def family_in(query: str) -> str:
    """The family of the first phrase that occurs in a query, within words too."""
    q = normalize_py(query)
    return next((target for phrase, target in _pairs(FAMILY_PHRASES) if phrase in q), "")


def service_in(query: str) -> str:
    """The concept of the first service phrase in a query, as whole words."""
    q = f" {normalize_py(query)} "
    found = next((target for phrase, target in _pairs(SERVICE_PHRASES) if f" {phrase} " in q), "")
    words = set(q.split())
    if not found and "paket" in words and words & {"abgeben", "versenden"}:
        return "parcel_delivery"
    if not found and "auto" in words and words & {"repariert", "reparieren", "reparatur"}:
        return "car_service"
    return found


def target_phrase(query: str) -> str:
    """What a query asks for: its words after the lead, up to four, before a preposition, without a shop-like ending."""
    out: list[str] = []
    for t in ordered_tokens_py(query):
        if not out and (t in LEAD_WORDS or t in NOISE_WORDS):
            continue
        if out and t in STOP_WORDS:
            break
        if t in NOISE_WORDS:
            continue
        out.append(t)
        if len(out) == 4:
            break
    while len(out) > 1 and out[-1] in NAME_SUFFIXES:
        out.pop()
    return " ".join(out)


def target_concept(query: str) -> str:
    target = target_phrase(query)
    if target.startswith("hotel"):
        return "hotel"
    words = set(target.split())
    return next((found for word, found in _pairs(TARGET_WORDS) if word in words), "")


def reference_category(text: str) -> str:
    """The category named within five words after a preposition."""
    toks = ordered_tokens_py(text)
    for i, t in enumerate(toks):
        if t in REFERENCE_WORDS:
            for j in range(i + 1, min(len(toks), i + 6)):
                found = category(toks[j]) or (category(f"{toks[j]} {toks[j + 1]}") if j + 1 < len(toks) else "")
                if found:
                    return found
    return ""


# The same of columns of texts.


def _found(names: dict[str, str], key: Column) -> Column:
    """What a key stands for in a fixed table, else an empty text."""
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain.from_iterable(names.items()))), key), F.lit(""))


def key_of(text: Column) -> Column:
    """A name as the rule tables write it."""
    return F.translate(normalize(text), " ", "_")


def category_of(norm: Column) -> Column:
    """category() of a normalized text; of names that occur twice the last one counts."""
    return _found(dict(_pairs(CATEGORY_NAMES)), norm)


def concept_of(key: Column) -> Column:
    """concept() of a key: a concept's own name, else its first alias."""
    return _found(dict(reversed(_pairs(CONCEPT_NAMES))) | {n: n for n in concepts()}, key)


def family_of(key: Column) -> Column:
    return _found(dict(reversed(_pairs(FAMILY_NAMES))) | {n: n for n in families()}, key)


def concept_label(key: Column) -> Column:
    return _found({n: label for n, (label, _) in concepts().items()}, key)


def concept_of_family(key: Column) -> Column:
    return _found({n: c for n, (c, _, _) in families().items()}, key)


def _first_phrase(pairs: tuple[tuple[str, str], ...], holds: Callable[[Column], Column]) -> Column:
    """The target of the first phrase, in order, that a text holds; null if there is none."""
    rules = F.array(*[F.struct(F.lit(phrase).alias("phrase"), F.lit(target).alias("target")) for phrase, target in pairs])
    return F.get(F.filter(rules, lambda r: holds(r["phrase"])), F.lit(0))["target"]


def family_phrase(norm: Column) -> Column:
    """family_in() of a normalized text."""
    return bind(norm, lambda n: F.coalesce(_first_phrase(_pairs(FAMILY_PHRASES), lambda phrase: F.contains(n, phrase)), F.lit("")))


def service_phrase(norm: Column) -> Column:
    """service_in() of a normalized text."""
    any_of = lambda *w: F.array(*map(F.lit, w))

    def service(n: Column) -> Column:
        words = F.split(n, " ")
        asks = lambda thing, *deeds: F.array_contains(words, thing) & F.arrays_overlap(words, any_of(*deeds))
        parcel = F.when(asks("paket", "abgeben", "versenden"), "parcel_delivery").when(asks("auto", "repariert", "reparieren", "reparatur"), "car_service")
        return F.coalesce(_first_phrase(_pairs(SERVICE_PHRASES), lambda phrase: has_phrase(n, phrase)), parcel, F.lit(""))

    return bind(norm, service)


def category_after(ordered: Column) -> Column:
    """reference_category() of ordered tokens: the first word that is a category, alone or with the next one, and has a
    preposition among the five before it."""
    asked = F.array(*map(F.lit, REFERENCE_WORDS))
    near = lambda words, j: F.arrays_overlap(F.slice(words, F.greatest(F.lit(1), j - 4), F.least(j, F.lit(5))), asked)
    both = lambda words, t, j: F.concat(t, F.lit(" "), F.get(words, j + 1))
    found = bind(ordered, lambda words: F.transform(words, lambda t, j: F.when(near(words, j), F.coalesce(F.nullif(category_of(t), F.lit("")), category_of(both(words, t, j))))))
    return F.coalesce(F.get(F.filter(found, lambda c: c != ""), F.lit(0)), F.lit(""))


# On POI columns.


def in_category(poi_category: Column, tag_value: Column, wanted: str) -> Column:
    """Whether a POI is of a category; underscores and spaces are one, parks take in gardens and greens."""
    if not wanted:
        return F.lit(False)
    c, v, w = normalize(poi_category), normalize(tag_value), wanted.replace("_", " ")
    out = (c == w) | (v == w)
    return out | (c == "garden") | v.isin("park", "recreation ground", "village green") if wanted == "park" else out


def concept_weight(tag_key: Column, tag_value: Column, wanted: str, wanted_family: str = "") -> Column:
    """The weight of the family's first tag that fits, else the concept's, else 0; names are compared normalized."""
    k, v = normalize(tag_key), normalize(tag_value)
    rules = chain(families().get(wanted_family, ("", "", []))[2], concepts().get(wanted, ("", []))[1])
    return F.coalesce(*[F.when((k == normalize_py(rk)) & (v == normalize_py(rv)), w) for rk, rv, w in rules], F.lit(0))


def text_relevance(name: Column, brand: Column, label: Column, poi_category: Column, tag_value: Column, query: Column, normalized: Column) -> Column:
    """Points for how a POI's texts answer a query (tokens, and its normalized text)."""
    texts = [normalize(c) for c in (label, brand, name)]
    name_tokens, all_tokens = tokens(name, brand), tokens(name, brand, poi_category, tag_value)
    equal = (normalized != "") & (texts[0].eqNullSafe(normalized) | (texts[1] == normalized) | (texts[2] == normalized))
    within = has_phrase(texts[0], normalized) | has_phrase(texts[1], normalized) | has_phrase(texts[2], normalized)
    full = (F.size(query) > 0) & (F.size(F.array_except(query, name_tokens)) == 0)
    points = lambda c, n: F.when(c, n).otherwise(0)
    return points(equal, 900) + points(within, 520) + 120 * matches(query, name_tokens) + 35 * matches(query, all_tokens) + points(full, 420)


def type_score(tag_key: Column, tag_value: Column, query: Column) -> Column:
    """Points for kinds that are asked for often, less for parking and playgrounds that aren't asked for."""
    k, v = normalize(tag_key), normalize(tag_value)
    asks = lambda *w: F.arrays_overlap(query, F.array(*map(F.lit, w)))
    return (
        F.when(v.isin("parking", "parking space") & ~asks("parking", "parkplatz"), -700)
        .when((v == "playground") & ~asks("playground", "spielplatz"), -500)
        .when((k == "amenity") & (v == "fast food"), 320)
        .when((k == "amenity") & v.isin("restaurant", "cafe"), 180)
        .otherwise(0)
    )
