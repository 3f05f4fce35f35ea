"""Functions against plain Python."""

import math
import random
import threading

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.functions import geometry as G
from waymark.functions import intent as I
from waymark.functions import rules as K
from waymark.functions import text as X
from waymark.operators import segments, spatial
from waymark.operators.forward import Query, QueryError
from waymark.operators.forward_table import taken_apart
from waymark.operators.graph import connected_components
from waymark.operators.natural import nearest_anchor
from waymark.operators.spatial import nearest_points, points_in_areas
from waymark.operators.streets import assemble_rings, chains
from waymark.operators.viewport import even_sample
from waymark.plans.build import place_inner_rings
from waymark.plans.index import expansions, fuzzy_expansions, substring_expansions
from waymark.sources.pbf import decode, fields, packed
from waymark.sources.schema import type_number, type_of, with_box

LINE = "array<struct<lat_e7:int,lon_e7:int>>"


def test_normalize(spark):
    texts = ["Königstraße 1", "Koenigstrasse 1", "KÖNIGSTR. 1", "", None, " a--b ", "Café", "́x é̂"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.normalize(F.col("t")), X.tokens(F.col("t"))).collect()
    assert [r[0] for r in rows[:3]] == ["koenigstrasse 1", "koenigstrasse 1", "koenigstr 1"]
    assert [r[0] for r in rows] == [X.normalize_py(t or "") for t in texts]
    assert [r[1] for r in rows] == [X.tokens_py(t or "") for t in texts]


def test_words_of_odd_texts(spark):
    texts = ["Str. strasze xstr str1 str-a", "str", "Str STR straße", "İstanbul K\u212a", "a\u0301 str\u0308 x", "\u0131ß", "strasse strassen strasz", "\x00 \t\n str\r"]
    rows = spark.createDataFrame([(t, t[::-1], None) for t in texts], "t string, u string, n string")
    t, u, n = F.col("t"), F.col("u"), F.col("n")
    for r in rows.select("t", "u", X.ordered_tokens(t).alias("o"), X.tokens(t, n, u).alias("b"), X.tokens(n).alias("e")).collect():
        assert r["o"] == X.ordered_tokens_py(r["t"])
        assert r["b"] == sorted({*X.ordered_tokens_py(r["t"]), *X.ordered_tokens_py(r["u"])})
        assert r["e"] == []


def test_expansions_in_one_pass(spark):
    words = ["lane", "lanes", "plane", "lame", "land", "strasse", "strase", "hauptstrasse", "main", "mains", "a", "ab", "remain", "domain"]
    vocab = spark.createDataFrame([(w,) for w in words], "token string")
    for most in ((2, 1), (96, 24)):
        want = []
        for spelling in ("lane", "main", "strasse", "ab", "zzzz"):
            for fuzzy, df in ((False, substring_expansions(vocab, spelling, most[0])), (True, fuzzy_expansions(vocab, spelling, most[1]))):
                want += [(spelling, fuzzy, k, r["token"]) for k, r in enumerate(df.collect(), 1)]
        assert sorted(map(tuple, expansions(vocab, ["lane", "main", "strasse", "ab", "zzzz"], *most).collect())) == sorted(want)
        assert any(w[1] for w in want)
    assert expansions(vocab, [], 96, 24).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_normalize_is_idempotent(t):
    assert X.normalize_py(X.normalize_py(t)) == X.normalize_py(t)


def test_triangle_holds_no_far_point(spark):
    ring = [(480000000, 90000000), (490000000, 90000000), (480000000, 100000000), (480000000, 90000000)]
    df = spark.createDataFrame([([{"lat_e7": a, "lon_e7": b} for a, b in ring],)], f"g {LINE}")
    inside = lambda a, b: G.in_ring(F.lit(a), F.lit(b), F.col("g"))
    got = df.select(inside(600000000, 500000000), inside(482000000, 92000000), inside(485000000, 95000000), inside(489999999, 99999999)).first()
    assert list(got) == [False, True, True, False]


def test_points_in_polygons_with_holes(spark):
    random.seed(3)
    star = lambda n, r: [(int(480000000 + r * random.uniform(0.4, 1) * s), int(90000000 + r * random.uniform(0.4, 1) * c)) for s, c in __import__("itertools").islice(((__import__("math").sin(6.28318 * i / n), __import__("math").cos(6.28318 * i / n)) for i in range(n)), n)]
    outer, hole = star(40, 3_000_000), star(12, 900_000)
    rings = [(0, 0, 0, outer + outer[:1]), (0, 1, 1, hole + hole[:1])]
    df = spark.createDataFrame([(a, n, r, [{"lat_e7": p, "lon_e7": q} for p, q in g]) for a, n, r, g in rings], f"area_idx int, ring_no int, role int, geometry {LINE}")
    areas = with_box(df.where("role = 0").select(F.col("area_idx").alias("idx"), "geometry"))
    pts = [(i, random.randint(477000000, 483000000), random.randint(87000000, 93000000)) for i in range(400)]
    got = {r["point_id"] for r in points_in_areas(spark.createDataFrame(pts, "point_id int, lat_e7 int, lon_e7 int"), areas, df).collect()}

    def odd(y, x, ring):
        return sum(((a > y) != (c > y)) and b + (y - a) * (d - b) / (c - a) >= x for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1

    assert got == {i for i, y, x in pts if odd(y, x, outer) and not odd(y, x, hole)}


def _ring_rows(spark, rings):
    return spark.createDataFrame([(a, n, r, [{"lat_e7": int(p), "lon_e7": int(q)} for p, q in g]) for a, n, r, g in rings], f"area_idx int, ring_no int, role int, geometry {LINE}")


def _wavy(lat, lon, radius, n, waves):
    turn = [2 * math.pi * i / n for i in range(n)]
    ring = [(lat + radius * (0.8 + 0.2 * math.sin(waves * t)) * math.sin(t), lon + radius * (0.8 + 0.2 * math.sin(waves * t)) * math.cos(t)) for t in turn]
    return [(round(a), round(b)) for a, b in ring + ring[:1]]


def test_cover_settles_most_points_and_agrees_with_edges(spark, monkeypatch):
    random.seed(5)
    stairs = [(480000000 + 5_000 * ((i + 1) // 2), 95000000 + 7_000 * (i // 2)) for i in range(400)]
    stairs += [(480000000, stairs[-1][1]), stairs[0]]
    rings = [(0, 0, 0, _wavy(480000000, 90000000, 4_000_000, 4000, 7)), (0, 1, 1, _wavy(480100000, 90200000, 900_000, 600, 3)), (1, 0, 0, stairs)]
    rings += [(2, 0, 0, [(479000000, 89000000), (479000000, 91000000), (481000000, 91000000), (481000000, 89000000), (479000000, 89000000)])]
    rings += [(3, 0, 0, [(a + 3_000_000, b) for a, b in rings[0][3][:-1]])]  # not closed: no cover
    rings += [(4, 0, 0, [(480000000 + i % 2, 90000000 + i) for i in range(300)] + [(480000030, 90000150), (480000000, 90000000)])]  # cells of some units
    df = _ring_rows(spark, rings)
    areas = with_box(df.where("role = 0").select(F.col("area_idx").alias("idx"), "geometry"))
    pts = [(random.randint(475500000, 488000000), random.randint(85500000, 97000000)) for _ in range(20_000)]
    pts += [p for _, _, _, g in rings for p in g[::5]] + [(a + random.randint(-2, 2), b + random.randint(-2, 2)) for _, _, _, g in rings for a, b in g[::7]]
    pts += [(480000000 + y, 90000000 + x) for y in range(-1, 32) for x in range(-2, 303, 3)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "point_id int, lat_e7 int, lon_e7 int")
    answer = lambda: {tuple(r) for r in points_in_areas(points, areas, df).collect()}
    found = answer()
    near = points.limit(20_000).join(areas.where("idx = 0").withColumnRenamed("idx", "area_idx"), G.in_box(F.col("lat_e7"), F.col("lon_e7"), F.col("min_lat"), F.col("max_lat"), F.col("min_lon"), F.col("max_lon")))
    sure = dict(tuple(r) for r in spatial.covered(near, spatial.cell_cover(areas, df)).groupBy(F.col("sure").isNotNull()).count().collect())
    assert sure[False] <= 0.15 * sure[True]
    assert {r["area_idx"] for r in spatial.cell_cover(areas, df).select("area_idx").distinct().collect()} == {0, 1, 4}
    monkeypatch.setattr(spatial, "COVERED", 1 << 60)
    assert spatial.cell_cover(areas, df).count() == 0
    assert found == answer() and {a for _, a in found} == {0, 1, 2, 3, 4}
    assert points_in_areas(points.limit(0), areas, df).count() == points_in_areas(points, areas.limit(0), df.limit(0)).count() == 0


def test_inner_rings_of_a_large_relation(spark):
    """5,000 inner rings and 500 outer ones in one relation, each outer one of a lattice with a smaller one inside, and one around all."""
    square = lambda a, b, n: [(a, b), (a, b + n), (a + n, b + n), (a + n, b), (a, b)]
    at = [(450000000 + 100_000 * (i // 25), 80000000 + 100_000 * (i % 25)) for i in range(250)]
    outer = [square(a, b, 90_000) for a, b in at] + [square(a + 20_000, b + 20_000, 40_000) for a, b in at[:249]] + [square(-900000000, -1800000000, 1_790_000_000)]
    random.seed(6)
    holes = [square(random.randint(449950000, 451050000), random.randint(79950000, 82550000), 10) for _ in range(4_990)]
    holes += [square(a - 10, b - 10, 10) for a, b in at[:5]] + [square(440000000, 1700000000, 10), [], [(0, 0)], square(0, 0, 7), square(a := at[0][0] + 90_000 - 10, at[0][1] + 5, 10)]
    rows = [(7, 0, i, g) for i, g in enumerate(outer)] + [(7, 1, i, g) for i, g in enumerate(holes)] + [(8, 0, 0, square(450000000, 80000000, 5_000_000)), (9, 1, 0, holes[0])]
    rings = spark.createDataFrame([(k, r, n, [{"lat_e7": p, "lon_e7": q} for p, q in g]) for k, r, n, g in rows], f"relation_id long, role int, ring_no int, geometry {LINE}")

    def home(g):
        if not g:
            return None
        y, x = g[len(g) // 2]
        boxes = [(o[2][0] - o[0][0], i) for i, o in enumerate(outer) if o[0][0] <= y <= o[2][0] and o[0][1] <= x <= o[2][1]]
        return min(boxes)[1] if boxes else None

    placed = place_inner_rings(rings)
    assert "NestedLoop" not in placed._jdf.queryExecution().toString() and "Cartesian" not in placed._jdf.queryExecution().toString()
    got = {(r["relation_id"], r["ring_no"]): r["area"] for r in placed.where("role = 1").collect()}
    assert got == {(7, i + 1): h for i, g in enumerate(holes) if (h := home(g)) is not None}
    assert placed.where("role = 0").count() == 501


def test_nearest_points(spark):
    random.seed(4)
    houses = [(i, random.randint(400000000, 500000000), random.randint(50000000, 150000000)) for i in range(300)]
    asked = [(i, random.randint(-500000000, 800000000), random.randint(-1700000000, 1700000000)) for i in range(60)]
    h = spark.createDataFrame(houses, "idx int, lat_e7 int, lon_e7 int")
    q = spark.createDataFrame(asked, "point_id int, lat_e7 int, lon_e7 int")
    got = {r["point_id"]: r["metres"] for r in nearest_points(q, h).collect()}
    d = G.distance_m(F.col("a"), F.col("b"), F.col("lat_e7"), F.col("lon_e7"))
    want = {r["point_id"]: r["m"] for r in q.crossJoin(h.select("idx", F.col("lat_e7").alias("a"), F.col("lon_e7").alias("b"))).groupBy("point_id").agg(F.min(d).alias("m")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want)
    assert nearest_points(q, h.limit(0)).count() == 0


def test_nearest_points_in_a_dense_place(spark, monkeypatch):
    """Cells follow the density, copies at one place count once, and no repeated table is broadcast."""
    random.seed(5)
    houses = [(i, 480000000 + random.randrange(3000), 90000000 + random.randrange(3000)) for i in range(4000)] + [(5000 + i, 480001000, 90001000) for i in range(3000)]
    asked = [(i, 480000000 + random.randrange(3000), 90000000 + random.randrange(3000)) for i in range(500)] + [(500, 480001000, 90001000), (501, 481000000, 90000000), (502, None, 1)]
    h = spark.createDataFrame(houses, "idx int, lat_e7 int, lon_e7 int")
    q = spark.createDataFrame(asked, "point_id int, lat_e7 int, lon_e7 int")
    size, n = spatial.fitted_cell(h.select("lat_e7", "lon_e7").distinct(), G.POINT_CELL)
    assert size < 200 and n <= 4001
    plans, kept = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: (plans.append(df._jdf.queryExecution().toString()), kept(df))[1])
    got = {r["point_id"]: (r["idx"], r["metres"]) for r in nearest_points(q, h).collect()}
    assert plans and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)
    d = G.distance_m(F.col("a"), F.col("b"), F.col("lat_e7"), F.col("lon_e7"))
    pairs = q.where("lat_e7 is not null").crossJoin(h.select("idx", F.col("lat_e7").alias("a"), F.col("lon_e7").alias("b")))
    want = {r["point_id"]: (r["m"]["idx"], r["m"]["d"]) for r in pairs.groupBy("point_id").agg(F.min(F.struct(d.alias("d"), "idx")).alias("m")).collect()}
    assert got == want and len(got) == 502 and got[500][1] == 0


def _lines(spark, rows):
    return with_box(spark.createDataFrame([(i, [{"lat_e7": a, "lon_e7": b} for a, b in g]) for i, g in rows], f"idx int, geometry {LINE}"))


def _nearest_lines_by_force(q, lines):
    m = G.street_m(F.col("lat_e7"), F.col("lon_e7"), F.col("geometry"))
    rows = q.crossJoin(lines.where(F.size("geometry") > 0).select("idx", "geometry")).groupBy("point_id").agg(F.min(F.struct(m.alias("m"), "idx")).alias("m")).collect()
    return {r["point_id"]: (r["m"]["idx"], r["m"]["m"]) for r in rows}


def test_nearest_lines_with_long_segments(spark, monkeypatch):
    """Lines whose boxes touch hundreds of thousands of cells each, in several blocks of places and of segments."""
    random.seed(6)
    monkeypatch.setattr(spatial, "PLACES", 40)
    monkeypatch.setattr(spatial, "SEGMENTS", 900)
    spot = lambda: (random.randint(300000000, 700000000), random.randint(-200000000, 200000000))
    rows = [(i, [spot() for _ in range(3)]) for i in range(1500)]
    asked = [(i, *spot()) for i in range(100)] + [(100 + i, *rows[i][1][1]) for i in range(20)] + [(200, *rows[0][1][1]), (201, None, 1)]
    lines, q = _lines(spark, rows), spark.createDataFrame(asked, "point_id int, lat_e7 int, lon_e7 int")
    late = threading.Timer(90, spark.sparkContext.cancelAllJobs)
    late.start()
    try:
        got = {r["point_id"]: (r["idx"], r["metres"]) for r in spatial.nearest_lines(q, lines, 8, G.STREET_CELL).collect()}
    finally:
        late.cancel()
    want = _nearest_lines_by_force(q.where("lat_e7 is not null"), lines)
    assert len(want) == 121 and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)


def test_segments_run_through_few_strips(monkeypatch):
    """Places that the nearest segment passes at no distance, and long segments of all directions: exact, and far fewer steps
    than strips and places beside a segment that lies as it happens."""
    rng = np.random.default_rng(3)
    y, x = rng.integers(470_000_000, 478_000_000, 20_000), rng.integers(90_000_000, 98_000_000, 20_000)
    y[:50], x[50:100] = y[0], x[50]
    a, b = rng.integers(0, 20_000, 60_000), rng.integers(0, 20_000, 60_000)
    a[:2], b[:2] = (0, 50), (1, 51)
    b[2:4] = a[2:4]  # without length
    k, within, idx = np.cos(np.radians(y / 1e7)), np.full(20_000, 1e-6), rng.permutation(60_000) // 2
    steps, spread = [], segments._spread
    monkeypatch.setattr(segments, "_spread", lambda n, first: steps.append(int(n.sum())) or spread(n, first))
    who, metres = segments.nearest_segments(y, x, k, within, idx, y[a], x[a], y[b], x[b])
    assert sum(steps) < 80 * 60_000
    for i in [*range(100), *rng.integers(0, 20_000, 100)]:
        m = segments.segment_m(*(float(v[i]) for v in (y, x, k)), *(v.astype(float) for v in (y[a], x[a], y[b], x[b])))
        near = m.min() if m.min() <= 1e-6 else np.inf
        assert (metres[i], who[i]) == (near, idx[m == near].min() if near < 1 else -1)
    who, metres = segments.nearest_segments(y, x, k, within, idx, y[a] + 10**8, x[a], y[b] + 10**8, x[b])
    assert (who == -1).all() and np.isinf(metres).all()


def test_segments_dealt_by_direction():
    assert spatial._dealt([(1, 5), (0, 4), (2, 30), (3, 2), (5, 9)], 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (5, 5, 1)]


def test_nearest_lines_of_points_copies_and_far_places(spark):
    random.seed(7)
    spot = lambda: (480000000 + random.randint(0, 2000000), 90000000 + random.randint(0, 2000000))
    rows = [(i, [spot() for _ in range(random.choice((1, 2, 4)))]) for i in range(1, 80)] + [(0, [])]
    rows += [(100 + i, rows[5][1]) for i in range(30)]  # copies: the smallest idx counts
    asked = [(i, *spot()) for i in range(60)] + [(60, *rows[5][1][0]), (61, 482500000, 93000000), (62, 100000000, 90000000)]
    lines, q = _lines(spark, rows), spark.createDataFrame(asked, "point_id int, lat_e7 int, lon_e7 int")
    got = {r["point_id"]: (r["idx"], r["metres"]) for r in spatial.nearest_lines(q, lines, 8, G.STREET_CELL).collect()}
    want = _nearest_lines_by_force(q.where("point_id < 62"), lines)  # 62 lies far beyond 8 cells
    assert got.keys() == want.keys() and got[60][1] == 0
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert spatial.nearest_lines(q, lines.limit(0), 8, G.STREET_CELL).count() == 0


def test_house_way_point(spark):
    big = [(480000000, 90000000), (481000000, 90000000), (481000000, 93000000), (480000000, 93000000), (480000000, 90000000)]
    df = spark.createDataFrame([([{"lat_e7": a, "lon_e7": b} for a, b in g],) for g in (big, big[:3], [])], f"g {LINE}")
    got = [r[0] and tuple(r[0]) for r in df.select(G.house_way_point(F.col("g"))).collect()]
    assert got == [(480500000, 91500000), (480666667, 91000000), None]


def test_rings():
    a, b, c, d = (0, 0), (0, 1), (1, 1), (1, 0)
    assert assemble_rings([[a, b], [c, b], [c, d, a]]) == [[a, b, c, d, a]]
    assert assemble_rings([[a, b], [b, c]]) == []
    assert [len(r) for r in assemble_rings([[a, b, c, a], [(5, 5), (5, 6), (6, 6), (6, 5), (5, 5)]])] == [5, 4]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1)), max_size=4), max_size=9))
def test_rings_by_trial(parts):
    unused, rings = [p for p in parts if len(p) > 1], []
    while unused:
        ring = unused.pop(0)
        while ring[0] != ring[-1]:
            fits = [k for k, p in enumerate(unused) if {p[0], p[-1]} & {ring[0], ring[-1]}]
            if not fits:
                break
            p = unused.pop(fits[0])
            if ring[-1] in (p[0], p[-1]):
                ring = ring + (p if p[0] == ring[-1] else p[::-1])[1:]
            else:
                ring = (p if p[-1] == ring[0] else p[::-1])[:-1] + ring
        if len(ring) > 3 and ring[0] == ring[-1]:
            rings.append(ring)
    assert assemble_rings(parts) == sorted(rings, key=len, reverse=True)


def test_many_ways_make_one_ring():
    n = 20_000
    ways = [[(i, 0), ((i + 1) % n, 0)] for i in range(n)]
    random.Random(5).shuffle(ways)
    assert [len(r) for r in assemble_rings(ways)] == [n + 1]


def test_even_sample_by_ranges(spark):
    for n, limit in ((1000, 37), (41, 40), (40, 40), (7, 1)):
        got = even_sample(spark.range(n).repartition(3), limit, F.col("id")).select("id", "ord").collect()
        want = range(n) if n <= limit else [int((i + 0.5) * n / limit) for i in range(limit)]
        assert sorted(map(tuple, got)) == [(k, k) for k in want]


def test_chains():
    got = chains([(5, [(0, 0), (0, 1)]), (3, [(0, 2), (0, 1)]), (9, [(0, 2), (0, 3)]), (7, [(0, 2), (1, 2)])])
    assert sorted((i, len(p)) for i, p in got) == [(3, 3), (7, 2), (9, 2)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (200, 200)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_match_quality(spark):
    pairs = {("koenigstr", "koenigstrasse"): 1450 + 30 * 9 - 72, ("abc", "abc"): 1400, ("ab", "abc"): 0, ("berlin", "berliner"): 1150 + 150 - 36, ("garten", "rosengarten"): 820 - 90, ("hause", "haus"): 620 - 170 + 220 - 18}
    df = spark.createDataFrame(list(pairs), "q string, t string")
    assert {(r["q"], r["t"]): r["m"] for r in df.select("q", "t", X.match_quality(F.col("q"), F.col("t")).alias("m")).collect()} == pairs


def test_intents():
    assert I.deterministic("McDonalds in Berlin").poi_name == "McDonald's" and I.deterministic("McDonalds in Berlin").place == "berlin"
    assert I.deterministic("where can I buy shampoo near a park") == I.Intent(I.CONCEPT, product_family="hair_body_care", concept="personal_care", reference_category="park")
    assert I.deterministic("restaurants").category == "restaurant"
    assert I.deterministic("burger").category == "fast_food"
    assert I.deterministic("fernsehturm").poi_name == "fernsehturm"
    assert I.parse_model_json("no json").type == I.UNKNOWN
    answer = '{"intent": "nearest_need_to_address", "family": "windeln", "address": "Ulm"}'
    assert I.parse_model_json("Sure: " + answer).concept == "personal_care"
    assert I.corrected(I.parse_model_json(answer), "locksmith").concept == "locksmith"
    assert I.place_spans("cafe in der Altstadt near Ulm")[0] == ["ulm"]
    assert "vague" in I.anchor_refusal("x", "some place", False, lambda w: False)
    assert I.anchor_refusal("x", "Ulm", False, lambda w: True) == ""


def test_rule_tables(spark):
    assert len(K.concepts()) == 38 and len(K.families()) == 37
    assert {K.families()[f][0] for f in K.families()} <= set(K.concepts())
    assert K.concept_table(spark).where("weight not between 1 and 100").count() == 0
    assert K.category("gruenflaeche") == "park" and K.concept("Apotheke") == "medicine" and K.family("usb cable") == "phone_accessories"
    assert K.service_in("wo kann ich ein Paket heute abgeben") == "parcel_delivery"
    assert K.reference_category("hotels near the train station") == "station"


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value


def _zig(values):
    return b"".join(_varint((v << 1) ^ (v >> 63) if v >= 0 else ((-v) << 1) - 1) for v in values)


def _block():
    strings = b"".join(_field(1, s) for s in (b"", b"name", b"Turm", b"outer"))
    dense = _field(1, _zig([5, 2])) + _field(8, _zig([480000000, 10])) + _field(9, _zig([90000000, -10])) + _field(10, bytes([1, 2, 0, 0]))
    way = _field(1, 9) + _field(2, bytes([1])) + _field(3, bytes([2])) + _field(8, _zig([5, 2]))
    relation = _field(1, 3) + _field(8, bytes([3])) + _field(9, _zig([9])) + _field(10, bytes([1]))
    return _field(1, strings) + b"".join(_field(2, g) for g in (_field(2, dense), _field(3, way), _field(4, relation)))


def test_pbf_block():
    block = _block()
    assert list(decode(block, "nodes")) == [(5, 48.0, 9.0, {"name": "Turm"}), (7, 48.000001, 8.999999, {})]
    assert list(decode(block, "ways")) == [(9, [5, 7], {"name": "Turm"})]
    assert list(decode(block, "relations")) == [(3, [("way", 9, "outer")], {})]
    assert packed(_zig([-3, 4]), True) == [-3, 4] and dict(fields(_field(3, b"x"))) == {3: b"x"}


def test_pbf_source(spark, tmp_path):
    import struct
    import zlib

    from waymark.sources.pbf import read_raw

    out = b""
    for kind, data in ((b"OSMHeader", b""), (b"OSMData", _block()), (b"OSMData", _block())):
        blob = _field(2, len(data)) + _field(3, zlib.compress(data))
        header = _field(1, kind) + _field(3, len(blob))
        out += struct.pack(">I", len(header)) + header + blob
    (tmp_path / "x.pbf").write_bytes(out)
    nodes, ways, relations = read_raw(spark, str(tmp_path / "x.pbf"))
    assert (nodes.count(), ways.count(), relations.count()) == (4, 2, 2)
    assert nodes.where("id = 5").first()["tags"] == {"name": "Turm"}


def test_stream(spark, tmp_path):
    from osm_fixture import raw
    from waymark.plans.build import attribute, build_entities
    from waymark.streaming.reverse_stream import reverse_stream

    data = attribute(build_entities(*raw(spark)))
    spark.createDataFrame([(1, 48.051018, 9.051)], "point_id long, lat double, lon double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("point_id long, lat double, lon double").parquet(str(tmp_path / "in"))
    reverse_stream(stream, data, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["result_type"] == "house"


def test_values_of_rule_tables():
    """Written out by hand, not taken from the tables."""
    concepts, families = K.concepts(), K.families()
    assert concepts["personal_care"] == ("personal care products", [("shop", "chemist", 100), ("shop", "cosmetics", 95), ("amenity", "pharmacy", 85), ("shop", "supermarket", 55)])
    assert concepts["park"] == ("parks", [("leisure", "park", 100), ("leisure", "garden", 80), ("landuse", "recreation_ground", 70), ("landuse", "village_green", 70)])
    assert concepts["locksmith"][1] == [("shop", "locksmith", 100), ("craft", "locksmith", 100)] and concepts["restaurant"][1][2] == ("amenity", "fast_food", 65)
    assert concepts["school"][1] == [("amenity", "school", 100), ("amenity", "university", 60)] and concepts["charging"][0] == "vehicle charging stations"
    assert families["running_shoes"] == ("shoes", "running shoes", [("shop", "shoes", 100), ("shop", "sports", 95), ("shop", "department_store", 50)])
    assert families["pet_food"] == ("pet_supplies", "pet food", [("shop", "pet", 100), ("shop", "supermarket", 55)])
    assert families["watch_repair_battery"][2] == [("shop", "watches", 100), ("shop", "jewelry", 80)] and families["car_parts"][0] == "car_service"
    assert families["sports_equipment"][2] == [("shop", "sports", 100), ("leisure", "sports_centre", 40)]
    named = {"Grünanlage": "park", "coffee shop": "cafe", "Imbiss": "fast_food", "Läden": "shop", "restaurants": "restaurant", "parking of nothing": ""}
    assert {t: K.category(t) for t in named} == named
    aliases = {"Drogerie": "personal_care", "arznei": "medicine", "Brot": "bakery_food", "handy zubehör": "electronics_accessories", "auto": "car_service", "Schreibwaren": "books_stationery", "blumen": "flowers", "Pet Supplies": "pet_supplies", "x": ""}
    assert {t: K.concept(t) for t in aliases} == aliases
    products = {"Nagellackentferner": "cosmetics_removal", "deo": "hair_body_care", "Hustensaft": "cold_medicine", "Brot": "bread_pastry", "Ladegerät": "phone_accessories", "fahrrad reparatur": "bike_parts_repair", "home textiles": "home_textiles", "": ""}
    assert {t: K.family(t) for t in products} == products


def test_rule_columns_say_what_the_functions_say(spark, sf):
    random.seed(8)
    known = [n for t in (K.CATEGORY_NAMES, K.CONCEPT_NAMES, K.FAMILY_NAMES, K.FAMILY_PHRASES, K.SERVICE_PHRASES) for n, _ in K._pairs(t)]
    words = [*known, *K.REFERENCE_WORDS, *K.concepts(), *K.families(), "mein", "Paket", "auto", "repariert", "versenden", "Straße", "-5", "é", "usb", "xyz"]
    texts = [*known, *K.concepts(), *K.families(), "", None, " ", "!?", " Houses\t", "\x1fpoi ", "ADMIN_AREA", "Weg weg", "weg 5", "a,-3", "a -3", "a -b"]
    texts += [" ".join(random.choice(words) for _ in range(random.randint(1, 14))) for _ in range(600)] + ["near " + "wort " * 20_000 + "bei dem park"]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    t, norm = F.col("raw"), F.col("norm")
    rows = taken_apart(spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")).select("query_id", "raw", "norm", "ordered", F.coalesce("error", F.lit("")).alias("error"))
    said = rows.select("query_id", K.category_of(F.col("norm")), K.concept_of(K.key_of(t)), K.family_of(K.key_of(t)), K.family_phrase(norm), K.service_phrase(norm), K.category_after(F.col("ordered")), type_of(t), "error", K.concept_label(K.key_of(t)), K.concept_of_family(K.key_of(t)))

    def refused(text):
        try:
            Query(text).check()
        except QueryError as error:
            return str(error)
        return ""

    seen = set()
    for r in said.collect():
        text = texts[r["query_id"]] or ""
        key = K._key(text)
        want = (K.category(text), K.concept(text), K.family(text), K.family_in(text), K.service_in(text), K.reference_category(text), type_number(text), refused(text), K.concepts().get(key, ("",))[0], K.families().get(key, ("",))[0])
        assert tuple(r)[1:] == want, text[:200]
        seen |= {i for i, w in enumerate(want) if w}
    assert seen == set(range(10))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distances_are_formulas_of_their_own_size(spark):
    """A lambda computes each place of a repeated part anew, so the parts have names: a few cosines in all."""
    rows = spark.createDataFrame([(1, 2, [(3, 4), (5, 6)])], f"lat int, lon int, g {LINE}")
    for metres in (G.street_m, G.boundary_m):
        plan = plan_of(rows.select(metres(F.col("lat"), F.col("lon"), F.col("g")).alias("m")))
        assert 0 < plan.count("COS(") <= 3
        assert plan.count("concat(") <= 1


def test_phrases_meet_a_text_that_is_prepared_once(spark):
    rows = spark.createDataFrame([("x",)], "t string").coalesce(1)
    for phrase in (K.family_phrase, K.service_phrase):
        before, within = plan_of(rows.select(phrase(F.reverse("t")).alias("p"))).split("filter(", 1)
        assert "reverse(" in before and "reverse(" not in within
    prepared = plan_of(rows.select(K.category_after(F.split(F.reverse("t"), " ")).alias("c")))
    assert prepared.count("reverse(") == 1


def test_nearest_anchor_keeps_a_row_for_each_place(spark):
    """Pairs of places and anchors would be sorted, all of a task's at once."""
    places = spark.createDataFrame([(i, 470000000 + 1000 * i, 90000000 - 700 * i) for i in range(30)] + [(30, None, None)], "idx int, lat_e7 int, lon_e7 int")
    anchors = spark.createDataFrame([(2, 470002000, 89998600, 1), (9, 470002000, 89998600, 0), (20, 470020000, 89986000, 2)], "idx int, lat_e7 int, lon_e7 int, ord int")
    found = nearest_anchor(places, anchors)
    got = {r["idx"]: (r["anchor_idx"], r["reference_m"]) for r in found.collect()}
    assert got[0][0] == 9 and got[2] == (9, 0.0) and got[29][0] == 20 and got[30][1] is None and len(got) == 31
    d = places.where("idx = 0").select(G.distance_m(F.col("lat_e7"), F.col("lon_e7"), F.lit(470002000), F.lit(89998600))).first()[0]
    assert got[0][1] == d
    assert {r["anchor_idx"] for r in nearest_anchor(places, anchors.where("false")).collect()} == {None}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_shapes_in_areas_with_and_without_covers(spark, monkeypatch):
    """Vertices share their idx and lie on outlines, in holes and in several areas; one that lies twice counts once."""
    random.seed(6)
    square = lambda a, b, n: [(a, b), (a + n, b), (a + n, b + n), (a, b + n), (a, b)]
    rings = [(0, 0, 0, square(480000000, 90000000, 1_600_000)), (0, 1, 1, square(480500000, 90500000, 300_000)), (1, 0, 0, square(481000000, 91000000, 900_000)[:3] + [(481000000, 91000000)])]
    df = _ring_rows(spark, rings)
    areas = with_box(df.where("role = 0").select(F.col("area_idx").alias("idx"), "geometry"))
    pts = [(random.randint(479900000, 482000000), random.randint(89900000, 92000000)) for _ in range(1500)] + [p for *_, g in rings for p in g] * 2
    spots = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "point_id int, lat_e7 int, lon_e7 int")
    one = {tuple(r) for r in points_in_areas(spots, areas, df).collect()}
    want = {(i // 3, a) for i, a in one}
    vertices = spots.select(F.floor(F.col("point_id") / 3).cast("int").alias("idx"), "lat_e7", "lon_e7")
    lookup = spatial.AreaLookup(areas, df)
    told = dict(tuple(r) for r in lookup.told(spots).groupBy(F.col("sure").isNotNull()).count().collect())
    assert told[False] < 0.25 * told[True]  # areas of few edges have a cover, too
    got = [tuple(r) for r in spatial.shapes_in_areas(vertices, lookup).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(spatial, "FEW_AREAS", 0)
    assert {tuple(r) for r in points_in_areas(spots, areas, df).collect()} == one
    plain = spatial.AreaLookup(areas, df)
    assert plain.cover is None and {tuple(r) for r in spatial.shapes_in_areas(vertices, plain).collect()} == want


def test_connected_streets_of_many_components(spark, monkeypatch):
    """Chains of three, the last one lying the other way round; streets that are unnamed, closed or of another kind stay alone. The streets
    given are computed once."""
    from waymark.operators import streets as ST

    seen = []
    monkeypatch.setattr(ST, "cut", lambda df: seen.append(df.columns) or df.localCheckpoint())
    at = lambda c, k: (c * 100, k)
    rows = []
    for c in range(200):
        lines = [(at(c, 0), at(c, 1)), (at(c, 1), at(c, 2)), (at(c, 3), at(c, 2))]
        rows += [(10 * c + i, 10 * c + i + 1000, "a", "x", line) for i, line in enumerate(lines)]
        rows += [(10 * c + 3, 10 * c + 1003, "", "x", lines[0]), (10 * c + 4, 10 * c + 1004, "a", "y", lines[0]), (10 * c + 5, 10 * c + 1005, "a", "x", (at(c, 9), at(c, 8), at(c, 9)))]
    df = spark.createDataFrame([(i, o, n, h, [{"lat_e7": a, "lon_e7": b} for a, b in g]) for i, o, n, h, g in rows], "idx int, osm_id long, name string, highway string, geometry array<struct<lat_e7:int,lon_e7:int>>")
    assert {r["idx"] for r in ST.linked_streets(df).collect()} == {10 * c + i for c in range(200) for i in range(3)}
    got = {(r["component"], r["osm_id"], r["name"], r["highway"], tuple((p["lat_e7"], p["lon_e7"]) for p in r["geometry"])) for r in ST.connect_streets(df).collect()}
    want = {(10 * c, 10 * c + 1000, "a", "x", tuple(at(c, k) for k in range(4))) for c in range(200)} | {(i, o, n, h, g) for i, o, n, h, g in rows if i % 10 >= 3}
    assert got == want and seen == [["idx", "osm_id", "name", "highway", "geometry"]]
