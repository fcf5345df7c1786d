"""What only larger tables show: ties, long axes, and many rows at one spot."""

import random

import pytest

from trekframe.functions.rounding import js_round
from trekframe.operators import linkage, ordered, routes, spatial, trips
from trekframe.operators.sequential import metres_between
from trekframe.operators.track import cumulative_km


def test_of_rows_at_one_distance_the_first_counts(spark):
    track = [(1, 0, 0.0, 0.0, 0.0), (1, 1, 2.0, 10.0, 0.0), (1, 2, 2.0, 35.0, 4.0), (1, 3, 2.0, 35.0, 9.0), (1, 4, 5.0, 60.0, 9.0), (1, 5, 5.0, 61.0, 9.0)]
    points = spark.createDataFrame(track, "trail_id long, idx long, dist double, cum_ascent double, cum_descent double")
    kms = [0.0, 0.9, 1.2, 2.0, 2.3, 3.5, 3.6, 5.0, 9.0]
    rows = spark.createDataFrame([(1, k, km) for k, km in enumerate(kms)], "trail_id long, place_id long, km double")
    got = {r.place_id: (r.s.up, r.s.down) for r in trips.at_km(rows, points, "s").collect()}
    assert got == {k: min(track, key=lambda t: (abs(t[2] - km), t[1]))[3:] for k, km in enumerate(kms)}


PLACES = "place_id long, lat double, lon double"


def crowds(n, copies, seed):
    """Places on few spots in one degree, ``copies`` at each."""
    rng = random.Random(seed)
    spots = [(rng.uniform(-35, -34), rng.uniform(148, 149)) for _ in range(n)]
    return spots, [(k, *spots[k % n]) for k in range(n * copies)]


@pytest.fixture
def met(monkeypatch):
    """The radius of each search of pairs and how many places take part."""
    seen, real = [], spatial.radius_pairs
    monkeypatch.setattr(spatial, "radius_pairs", lambda left, right, radius, keys=(): seen.append((radius, left.count(), right.count())) or real(left, right, radius, keys))
    return seen


def test_the_nearest_of_crowded_places_is_looked_for_nearby_and_once_a_spot(spark, met):
    (spots, left), (others, right) = crowds(40, 30, 1), crowds(300, 5, 2)
    got = {r.place_id: (r.b, r.metres) for r in spatial.nearest_within(spark.createDataFrame(left, PLACES), spark.createDataFrame(right, "b long, lat double, lon double"), "place_id", "b", 60_000).collect()}
    for k, lat, lon in left:
        d, b = min((metres_between(lat, lon, *spot), i) for i, spot in enumerate(others))
        assert got[k] == (b, pytest.approx(d, abs=1e-6))
    assert len(got) == 1200 and met[0][0] < 20_000 and max(n for _, n, _ in met) == 40 and max(n for _, _, n in met) == 300


def test_crowded_places_are_snapped_nearby_and_once_a_spot(spark, monkeypatch):
    radii, real = [], spatial.Grid
    monkeypatch.setattr(spatial, "Grid", lambda radius: radii.append(radius) or real(radius))
    (_, left), (ends, _) = crowds(200, 4, 3), crowds(60, 1, 4)
    points = [(1, k, *ends[k // 2], 0.0, k % 14 == 7) for k in range(120)]  # every point twice
    track = cumulative_km(spark.createDataFrame(points, "trail_id long, idx long, lat double, lon double, ele double, is_break boolean"))
    got = {r.place_id: r for r in spatial.snap_to_track(spark.createDataFrame(left, PLACES), track, 60_000).collect()}
    monkeypatch.setattr(spatial, "_first_radius", lambda spots, keys, radius_m: radius_m)
    wide = {r.place_id: r for r in spatial.snap_to_track(spark.createDataFrame(left, PLACES), track, 60_000).collect()}
    assert got == wide and len(got) == 800 and all(tuple(got[k])[1:] == tuple(got[k % 200])[1:] for k in got)
    first = next(r for r in radii if r != 60_000)
    assert first < 20_000


def test_distances_off_a_track_are_told_to_the_centimetre(spark):
    track = cumulative_km(spark.createDataFrame([(1, 0, 0.0, 148.0, 0.0, False), (1, 1, 0.0, 149.0, 0.0, False)], "trail_id long, idx long, lat double, lon double, ele double, is_break boolean"))
    lat = 274.998 / 111_194.92664455873
    rows = spark.createDataFrame([(1, lat, 148.5, None), (2, lat, 148.5, 1.25)], PLACES + ", off_km double")
    out = routes.straight_line_access(rows, track, 1_000).select("place_id", js_round("off_km", 2).alias("km")).collect()
    assert {r.place_id: r.km for r in out} == {1: 0.28, 2: 1.25}


def test_a_segment_along_a_parallel_is_met_all_along(spark):
    track = cumulative_km(spark.createDataFrame([(1, 0, -35.0, 148.0, 0.0, False), (1, 1, -35.0, 149.0, 0.0, False)], "trail_id long, idx long, lat double, lon double, ele double, is_break boolean"))
    rows = spark.createDataFrame([(k, -35.001, 148.0 + k / 10) for k in range(11)], PLACES)
    assert {r.place_id for r in spatial.snap_to_track(rows, track, 1_000).collect()} == set(range(11))


def test_intervals_of_any_length_meet_their_points(spark):
    rng = random.Random(5)
    spans = [(1, 0.0, 3e9, 9), (1, 5.5, 5.5, 2), (1, 7.0, 6.0, 1), (2, -40.0, 1e7, 3)] + [(2, a, a + rng.choice([0.2, 1.0, 3.0, 70.0]), n) for n, a in enumerate(rng.uniform(-50, 300) for _ in range(12))]
    points = [(k, k % 3, km) for k, km in enumerate([5.5, -1.0, 2.9e9, 6.5, None, *(rng.uniform(-60, 400) for _ in range(150))])]
    frame = spark.createDataFrame(points, "event_id long, trail_id long, km double")
    got = {r.event_id: r.number for r in ordered.first_containing(frame, spark.createDataFrame(spans, "trail_id long, from_km double, to_km double, number int")).collect()}
    assert got == {k: min((n for s, a, b, n in spans if km is not None and s == t and a <= km <= b), default=0) for k, t, km in points}
    pieces = spark.createDataFrame([(t, a, b, n, 10.0 * n) for t, a, b, n in spans], "trail_id long, from_km double, to_km double, rank int, route_start double")
    routes_km = {r.event_id: r.route_km for r in ordered.map_piecewise(frame, pieces).collect()}
    for k, t, km in points:
        held = min(((n, a) for s, a, b, n in spans if km is not None and s == t and a <= km <= b), default=None)
        assert routes_km[k] == (held and 10.0 * held[0] + km - held[1])


def test_dense_stretches_draw_no_grid_where_nothing_is(spark):
    rng = random.Random(6)
    bins = {t: [rng.choice([0, 0, 1, 2, 3, 8]) if 20 < b < 120 else 0 for b in range(160)] for t in (1, 2, 3)}
    rows = [(t, b + 0.5) for t, ns in bins.items() for b, n in enumerate(ns) for _ in range(n)] + [(t, km) for t in bins for km in (0.5, 3e9 * t)]
    want = []
    for t, ns in bins.items():
        ns = [1, *ns[1:]]
        density = [sum(ns[max(0, b - 2) : b + 3]) / 5 for b in range(160)]
        islands, b = [], 0
        while b < 160:
            end = b
            while end < 160 and density[end] >= 2:
                end += 1
            if end > b and max(density[b:end]) >= 4:
                islands += [k for k in range(b, end) if ns[k]]
            b = end + 1
        parts = []
        for k in islands:
            if parts and k - parts[-1][1] - 1 <= 5:
                parts[-1][1] = k
            else:
                parts.append([k, k])
        want += [(t, a, z, sum(ns[a : z + 1])) for a, z in parts if sum(ns[a : z + 1]) >= 20]
    got = ordered.dense_stretches(spark.createDataFrame(rows, "trail_id long, km double"), 4.0, 2.0, 20, 5).collect()
    assert sorted((r.trail_id, r.from_bin, r.to_bin, r.n) for r in got) == sorted(want) and want


@pytest.fixture
def compared(monkeypatch):
    """How many rows of either side each search of pairs in ``linkage`` gets."""
    seen, real = [], linkage.radius_pairs
    monkeypatch.setattr(linkage, "radius_pairs", lambda left, right, radius, keys=(): seen.append((left.count(), right.count())) or real(left, right, radius, keys))
    return seen


def test_places_and_waypoints_of_one_kind_are_compared_once(spark, compared):
    kinds = [("camping", "Blue Gum", -35.0), ("camping", "Blue Gum", -35.1), ("camping", None, -35.2), ("camping", None, -35.3), ("camping", None, -35.4), (None, "Blue Gum", -35.0)]
    marks = [("hut", "Blue Gum", -35.0), ("hut", "Grey Owl", -35.2), ("hut", "Campsite", -35.3), ("hut", "Grey Owl", -35.4), ("hut", "Red Fox", -35.4), ("spring", "Blue Gum", -35.1)]
    places = [(k, *kinds[k % 6], 148.0) for k in range(120)]
    wps = [(1000 + k, *marks[k % 6], 148.0) for k in range(120)]
    got = linkage.mark_duplicates(spark.createDataFrame(places, "place_id long, category string, name string, lat double, lon double"), spark.createDataFrame(wps, "waypoint_id long, type string, wp_name string, lat double, lon double"))
    want = {k: 1000 if k % 6 == 0 else 1001 for k in range(120) if k % 6 in (0, 2)}  # names that say nothing are rivals of each other
    assert {r.place_id: r.waypoint_id for r in got.collect()} == want
    assert max(max(n) for n in compared) <= 60


def test_copies_at_one_position_are_linked_with_the_first(spark, compared):
    rows = [(k, "n", "hut", -35.0 + k % 4 * 0.001, 148.0, k % 7 == 3, 0.0, f"d{k % 2}") for k in range(200)] + [(900 + k, None, "hut", -35.0, 148.0, False, 0.0, "") for k in range(3)]
    got = linkage.merge_near_copies(spark.createDataFrame(rows, "waypoint_id long, name string, type string, lat double, lon double, preferred boolean, km double, description string"), 150.0).collect()
    assert [(r.survivor, r.merged_ids, r.description) for r in got] == [(3, list(range(200)), "d0\n\nd1")] and compared == [(4, 4)]
