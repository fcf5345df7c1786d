"""Rules of names and places, joins on the whole globe, and recurrences, against plain forms of the same."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trekframe.functions import text
from trekframe.operators import linkage, sequential, spatial
from trekframe.operators.track import cumulative_km


def metres(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(max(0.0, 1 - h)))


@pytest.fixture(scope="module")
def globe(spark):
    """Places all over, and many about the poles, the antimeridian and the equator."""
    rng = random.Random(3)
    spots = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    for lat, lon in [(89.99, 10), (-89.995, -170), (89.0, 0), (0.0, 180.0), (12.0, -179.999), (-40.0, 179.9995), (60.0, 0.0)]:
        spots += [(max(-90.0, min(90.0, lat + rng.gauss(0, 0.002))), (lon + rng.gauss(0, 0.004 / max(0.01, math.cos(math.radians(lat)))) + 180) % 360 - 180) for _ in range(14)]
    left, right = spots[::2], spots[1::2]
    frame = lambda rows, name: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{name} long, lat double, lon double")
    return left, right, frame(left, "a"), frame(right, "b")


@pytest.mark.parametrize("radius", [200.0, 5_000.0, 3_000_000.0, 21_000_000.0])
def test_radius_pairs_on_the_whole_globe(globe, radius):
    left, right, a, b = globe
    got = {(r.a, r.b) for r in spatial.radius_pairs(a, b, radius).collect()}
    want = {(i, j) for i, p in enumerate(left) for j, q in enumerate(right) if metres(*p, *q) <= radius}
    sure = {(i, j) for i, j in want if metres(*left[i], *right[j]) < radius - 1e-3}
    assert sure <= got <= want | {(i, j) for i, j in got if metres(*left[i], *right[j]) < radius + 1e-3} and (len(want) > 20)


def test_nearest_place_at_any_distance(globe):
    left, right, a, b = globe
    got = {r.a: r.metres for r in spatial.nearest_place(a, b, "a", "b", 500.0, widen=8.0).collect()}
    for i, p in enumerate(left):
        assert abs(got[i] - min(metres(*p, *q) for q in right)) < 1e-3


def test_pairs_across_the_antimeridian_and_near_a_pole(spark):
    a = spark.createDataFrame([(1, 10.0, 179.9999), (2, 89.0, 0.0)], "a long, lat double, lon double")
    b = spark.createDataFrame([(1, 10.0, -179.9999), (2, 89.0, 0.05)], "b long, lat double, lon double")
    assert {(r.a, r.b) for r in spatial.radius_pairs(a, b, 200.0).collect()} == {(1, 1), (2, 2)}


def test_snapping_to_long_and_wrapping_segments(spark):
    rng = random.Random(4)
    lines = {1: [(10.0, 178.0), (11.0, -179.0), (12.5, -178.5)], 2: [(-30.0, 20.0), (-31.0, 22.0), (-29.0, 24.0)], 3: [(70.0, 0.0), (70.2, 5.0)]}
    points = [(t, k, *p, 0.0, False) for t, line in lines.items() for k, p in enumerate(line)]
    track = cumulative_km(spark.createDataFrame(points, "trail_id long, idx long, lat double, lon double, ele double, is_break boolean"))
    wrap = lambda d: (d + 540) % 360 - 180
    places, want = [], {}
    for i in range(150):
        t = rng.choice(list(lines))
        k = rng.randrange(len(lines[t]) - 1)
        (la, lo), (lb, lp) = lines[t][k], lines[t][k + 1]
        s = rng.random()
        places.append((i, la + (lb - la) * s + rng.gauss(0, 0.02), wrap(lo + wrap(lp - lo) * s + rng.gauss(0, 0.03))))
    for i, lat, lon in places:
        best = math.inf
        for line in lines.values():
            for (la, lo), (lb, lp) in zip(line, line[1:]):
                k = math.cos(math.radians(la))
                dx, dy, px, py = wrap(lp - lo) * k, lb - la, wrap(lon - lo) * k, lat - la
                t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
                best = min(best, metres(lat, lon, la + (lb - la) * t, lo + wrap(lp - lo) * t))
        if best <= 3000:
            want[i] = best
    got = {r.place_id: r.metres for r in spatial.snap_to_track(spark.createDataFrame(places, "place_id long, lat double, lon double"), track, 3000.0).collect()}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-3 for i in want) and len(want) > 60


NAMES = ["Mt Wills Hut", "Mount Wills Hut", "Finke River Campground", "Finke River", "River Camp", "Creek Camp S", "Night 'n Day", "J W McMahon", "O' Keefes Hut", "O'Keefes Hut", "Devil's Kitchen", "Devils Kitchen",
         "Pāhautea Hut", "Pahautea Hut", "R: Ormiston Gorge", "Ormiston Gorge", "Hamelin Bay - Leeuwin-Naturaliste NP", "Trezona Camp Ground", "Trezona Campsite", "Twins Track 1", "Twins Track 2", "Upper Tank", "Lower Tank",
         "Big River 1", "Big River", "Campsite", "", None, "遍路小屋", "Hewett's", "Hewitt's", "Lake", "Lake Tali Karng", "Opua", "Opua General Store"]


def test_names_as_walkers_compare_them(spark):
    pairs = [(i, j, NAMES[i], NAMES[j]) for i in range(len(NAMES)) for j in range(len(NAMES))]
    frame = spark.createDataFrame(pairs, "i int, j int, x string, y string")
    rows = frame.select("i", "j", "x", "y", text.all_tokens(F.col("x")).alias("a"), text.all_tokens(F.col("y")).alias("b")).repartition(2)
    got = {(r.x, r.y): r for r in rows.select("x", "y", "a", text.name_score(F.col("a"), F.col("b")).alias("score"), text.names_distinguished(F.col("a"), F.col("b")).alias("apart"), text.is_unnamed(F.col("x"), F.col("a")).alias("none")).collect()}
    score = lambda x, y: got[x, y].score
    for x, y in [("Mt Wills Hut", "Mount Wills Hut"), ("O' Keefes Hut", "O'Keefes Hut"), ("Devil's Kitchen", "Devils Kitchen"), ("Pāhautea Hut", "Pahautea Hut"), ("R: Ormiston Gorge", "Ormiston Gorge"),
                 ("Finke River Campground", "Finke River"), ("Trezona Camp Ground", "Trezona Campsite")]:
        assert score(x, y) == score(y, x) == 1.0, (x, y)
    for x, y in [("River Camp", "Finke River Campground"), ("Lake", "Lake Tali Karng"), ("Opua", "Opua General Store")]:
        assert score(x, y) < 0.85, (x, y)
    assert 0.8 < score("Hewett's", "Hewitt's") < 1
    assert got["Creek Camp S", ""].a == ["creek", "camp", "south"] and got["Night 'n Day", ""].a == ["night", "n", "day"] and got["J W McMahon", ""].a == ["j", "w", "mcmahon"]
    assert got["Hamelin Bay - Leeuwin-Naturaliste NP", ""].a == ["hamelin", "bay"]
    assert got["Twins Track 1", "Twins Track 2"].apart and got["Upper Tank", "Lower Tank"].apart and not got["Big River 1", "Big River"].apart
    assert [got[x, ""].none for x in ("Campsite", "", None, "遍路小屋", "Lake")] == [True, True, True, False, False]


def test_letters_in_order(spark):
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert text._lcs(a, b) == slow(a, b)


def test_duplicates_against_a_plain_loop(spark):
    """Pairs within reach, judged one by one with the library's own score of names, which has its tests above."""
    rng = random.Random(6)
    base = ["Ponderosa Camp", "Aire River West Campground", "Aire River", "Blue Hut", "Campsite", None, "Old Blue Hut", "Blue Tank 2", "Blue Tank 3", "Hewett's", "Hewitt's"]
    spot = lambda: (-35 + rng.uniform(0, 0.004), 148 + rng.uniform(0, 0.004))
    places = [(i, rng.choice(["camping", "water", "transport", "resupply"]), rng.choice(base), *spot()) for i in range(120)]
    waypoints = [(1000 + i, rng.choice(["campsite", "hut", "poi", "tank", "shop", "town"]), rng.choice(base), *spot()) for i in range(80)]
    waypoints += [(2000 + i, "poi", n, lat, lon) for i, (_, _, n, lat, lon) in enumerate(places[:30])]
    p = spark.createDataFrame(places, "place_id long, category string, name string, lat double, lon double")
    w = spark.createDataFrame(waypoints, "waypoint_id long, type string, wp_name string, lat double, lon double")
    names = sorted({n for n in base if n}) + [""]
    both = spark.createDataFrame([(x, y) for x in names for y in names], "x string, y string").select("x", "y", text.all_tokens(F.col("x")).alias("a"), text.all_tokens(F.col("y")).alias("b")).repartition(1)
    known = {(r.x, r.y): r for r in both.select("x", "y", "a", text.name_score(F.col("a"), F.col("b")).alias("score"), text.names_distinguished(F.col("a"), F.col("b")).alias("apart")).collect()}
    words = lambda n: sorted({t for t in known[n or "", ""].a if t not in text.GENERIC_WORDS})
    want = {}
    for pid, category, name, lat, lon in places:
        near = [(metres(lat, lon, y, x), wid, kind, wname) for wid, kind, wname, y, x in waypoints]
        allowed = linkage.COMPATIBLE_TYPES.get(category, [])
        if words(name):
            fine = []
            for d, wid, kind, wname in near:
                if d > 250 or not words(wname):
                    continue
                r = known[name, wname]
                colocated = d <= 10 and r.score == 1 and category != "transport" and kind in linkage.GENERIC_TYPES
                if r.score >= (0.85 if d <= 25 else 0.9) and not r.apart and (kind in allowed or colocated):
                    fine.append((-r.score, words(name) != words(wname), d, wid))
            if fine:
                want[pid] = min(fine)[3]
        elif category == "camping":
            own = sorted((d, wid, wname) for d, wid, kind, wname in near if kind in allowed and d <= 60)
            if own and own[0][0] <= 30 and not any(d - own[0][0] <= 30 and known[own[0][2] or "", n or ""].score < 0.9 for d, _, n in own[1:]):
                want[pid] = own[0][1]
    got = {r.place_id: r.waypoint_id for r in linkage.mark_duplicates(p, w).collect()}
    assert got == want and len(want) > 20


def test_simplify_against_a_plain_recursion(spark):
    rng = np.random.default_rng(2)
    lat, lon = np.cumsum(rng.normal(0, 0.001, 300)) - 35, np.cumsum(rng.normal(0, 0.001, 300)) + 148

    def off(a, b, i):
        k = math.cos(math.radians((lat[a] + lat[b]) / 2))
        s = math.pi / 180 * 6371000
        x, y, dx, dy = (lon[i] - lon[a]) * k * s, (lat[i] - lat[a]) * s, (lon[b] - lon[a]) * k * s, (lat[b] - lat[a]) * s
        t = max(0.0, min(1.0, (x * dx + y * dy) / (dx * dx + dy * dy)))
        return math.hypot(x - t * dx, y - t * dy)

    def keep(a, b):
        if b - a < 2:
            return []
        far = max(range(a + 1, b), key=lambda i: off(a, b, i))
        return keep(a, far) + [far] + keep(far, b) if off(a, b, far) > 120 else []

    want = [0, *keep(0, 299), 299]
    assert sequential.douglas_peucker(lat, lon, 120).tolist() == want
    rows = [(1, 0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon))] + [(2, s, i, -35.0 + i * 0.001, 148.0) for s in (0, 1) for i in range(3 * s, 3 * s + 3)]
    frame = spark.createDataFrame(rows, "trail_id long, stretch long, idx long, lat double, lon double").repartition(5)
    got = sorted(tuple(r) for r in sequential.simplify(frame, tolerance_m=120.0).collect())
    assert got == [(1, i) for i in want] + [(2, i) for i in (0, 2, 3, 5)]
    target = sequential.simplify_to_target(lat, lon, 40)
    assert len(target) <= 44 and sequential.simplify_to_target(lat, lon, 400).tolist() == list(range(300))


def test_greedy_nights():
    km, hours = np.array([0.0, 100.0]), np.array([0.0, 25.0])  # four kilometres an hour
    nights = sequential.greedy_stops([(23.0, 7), (50.0, 8), (99.0, 9)], km, hours, 0.0, 100.0, 6.0)
    assert nights == [(23.0, 7), (50.0, 8), (74.0, None)]  # 100 - 74 = 6.5 h, which one last day holds
    assert sequential.greedy_stops([], km, hours, 0.0, 20.0, 6.0) == []
    assert [k for k, _ in sequential.greedy_stops([], km, hours, 0.0, 40.0, 6.0)] == [20.0]


def test_first_fit_boxes():
    boxes = [(0, 0, 0.01, 0.01), (0.005, 0.005, 0.02, 0.02), (0.5, 0.5, 0.6, 0.6), (0.015, 0.0, 0.4, 0.02), (0.019, 0.0, 0.03, 0.01)]
    assert sequential.first_fit_boxes(boxes, 5.0) == [0, 0, 1, 2, 0]


def test_close_stops_and_hours_against_plain_loops(spark):
    rng = random.Random(2)
    rows = [(t, i, rng.uniform(0, 5), rng.randint(0, 9)) for t in (1, 2) for i in range(40)]
    got = {(r.trail_id, r.seq) for r in sequential.drop_close_stops(spark.createDataFrame(rows, "trail_id long, seq long, km double, waypoint long"), 0.3).collect()}
    want = set()
    for t in (1, 2):
        seen, last = set(), -math.inf
        for _, i, km, w in sorted((r for r in rows if r[0] == t), key=lambda r: (r[2], r[1])):
            if w not in seen and km - last >= 0.3:
                want.add((t, i))
                seen.add(w)
                last = km
    assert got == want
    profile = spark.createDataFrame([(1, float(k), 60.0 * k) for k in range(11)], "trail_id long, km double, ascent double")
    assert abs(sequential.reach_in(1.0, 4.0, profile).first().km - 1 / 0.35) < 1e-9


def test_finishing_chain_drops_what_each_step_drops(spark):
    line = cumulative_km(spark.createDataFrame([(1, i, -35.0 + 0.01 * i, 148.0, 0.0, False) for i in range(30)], "trail_id long, idx long, lat double, lon double, ele double, is_break boolean"))
    tag = lambda **t: t
    places = [
        (1, "Spring", tag(natural="spring", note="x"), -34.95, 148.001), (2, "Far spring", tag(natural="spring"), -34.9, 148.2), (3, None, tag(highway="bus_stop"), -34.9, 148.0),
        (4, "Blue Hut", tag(tourism="wilderness_hut"), -34.88, 148.0), (5, "Cafe", tag(amenity="cafe"), -34.8, 148.0), (6, "Bench", tag(amenity="bench"), -34.8, 148.0),
        (7, "Second spring", tag(natural="spring", note="x"), -34.9501, 148.002), (10, "Mid spring", tag(natural="spring"), -34.95005, 148.0015), (8, "Third spring", tag(natural="spring"), -34.75, 148.0),
    ]
    frame = spark.createDataFrame(places, "place_id long, name string, tags map<string,string>, lat double, lon double")
    wp = spark.createDataFrame([(9, "hut", "Blue Hut", -34.8801, 148.0)], "waypoint_id long, type string, wp_name string, lat double, lon double")
    got = {r.place_id: r for r in linkage.finish_places(frame, line, wp, 400.0, 50.0, city=(0.4, 0.2, 2, 5)).collect()}
    assert set(got) == {1, 5, 7, 8}  # of three springs in one kilometre, the first and the last
    assert got[7].tags == {"natural": "spring"} and got[5].category == "restaurant"
    assert abs(got[7].km - 5.6) < 0.2 and got[7].off_km == 0.18


def test_distance_to_line_measures_steps_across_breaks(spark):
    """A place beside a step across a break is nearer to the line than to the snapped point; one past an end has its next index."""
    from trekframe.operators import spatial

    points = spark.createDataFrame(
        [(1, 0, -35.0, 148.0, 0.0, False), (1, 1, -35.0, 148.01, 0.9, False), (1, 2, -35.0, 148.03, 0.9, True), (1, 3, -35.0, 148.04, 1.8, False)],
        "trail_id long, idx long, lat double, lon double, dist double, is_break boolean",
    )
    places = spark.createDataFrame([(1, -35.001, 148.02), (2, -35.001, 148.005), (3, -35.0, 148.012), (4, -35.0, 148.05), (5, 10.0, 10.0)], "place_id long, lat double, lon double")
    got = {r.place_id: r for r in spatial.distance_to_line(places, points, 3000.0).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].metres > 900 and abs(got[1].line_m - 111.32) < 0.01
    assert (got[2].idx, round(got[2].line_m)) == (0, 111)
    assert got[3].idx == 1 and got[3].metres > 180 and got[3].line_m < 0.01
    assert got[4].idx == 3 and abs(got[4].line_m - got[4].metres) < 2
