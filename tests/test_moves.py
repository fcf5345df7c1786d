"""Stored routes, retraces, registry and thinning against plain forms and small cases."""

import math
import random

import pytest

from trekframe.operators import matching, ordered, replan, retraces
from trekframe.operators.sequential import metres_between

POINTS = "trail_id long, idx long, lat double, lon double, dist double"
M = 1 / 111_194.93  # a metre of latitude, in degrees


def line(trail, spots):
    """Rows of a track through spots given in metres north and east of a place on the equator."""
    out, dist = [], 0.0
    for k, (y, x) in enumerate(spots):
        if k:
            dist += metres_between(spots[k - 1][0] * M, spots[k - 1][1] * M, y * M, x * M) / 1000
        out.append((trail, k, y * M, x * M, dist))
    return out


OUT = [(0, 200 * k) for k in range(21)]  # 4 km east
LOLLIPOP = [*OUT[:11], *[(300 * k, 2000) for k in range(1, 11)], *[(3000, 2000 + 300 * k) for k in range(1, 6)], *[(3000 - 300 * k, 3500) for k in range(1, 11)], *[(0, 3500 - 300 * k) for k in range(1, 5)], *OUT[10::-1]]
EIGHT = [(2000 * math.sin(2 * t), 3000 * math.sin(t)) for t in (0.05 + k * 2 * math.pi / 80 for k in range(80))]


def plain_retraces(rows, near=150.0, least=1.0, end=0.5):
    rows = sorted(rows, key=lambda r: r[1])
    total, pairs = rows[-1][4], []
    for j, b in enumerate(rows):
        i = next((i for i, a in enumerate(rows[:j]) if b[4] - a[4] >= 2 * least and metres_between(*a[2:4], *b[2:4]) <= near), None)
        if i is not None and not (rows[i][4] <= end and total - b[4] <= end):
            pairs.append((i, j))
    spans = []
    for i, j in sorted(pairs):
        if spans and i <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], j)
        else:
            spans.append([i, j])
    out = []
    for i, j in spans:
        turn = max(range(i, j + 1), key=lambda k: (metres_between(*rows[i][2:4], *rows[k][2:4]), -k))
        length = min(rows[turn][4] - rows[i][4], rows[j][4] - rows[turn][4])
        if length >= least:
            out.append((rows[0][0], i, turn, j, round(length, 6), rows[i][4] <= end or total - rows[j][4] <= end))
    return out


def test_retraces_of_tracks_of_all_shapes(spark):
    rng = random.Random(3)
    shapes = [[*OUT, *OUT[-2::-1]], LOLLIPOP, EIGHT, OUT, [(0, -3000), (0, -1500), *OUT, *OUT[-2:5:-1], (2500, 1000), (5000, 0)]]
    shapes += [[(rng.randrange(12) * 250, rng.randrange(12) * 250) for _ in range(60)] for _ in range(4)]
    tracks = [line(t, s) for t, s in enumerate(shapes)]
    got = retraces.self_retraces(spark.createDataFrame([r for t in tracks for r in t], POINTS)).collect()
    want = [w for t in tracks for w in plain_retraces(t)]
    assert sorted((r.trail_id, r.start_idx, r.turn_idx, r.end_idx, round(r.length_km, 6), r.terminal) for r in got) == sorted(want)
    assert not [w for w in want if w[0] == 3] and [w for w in want if w[0] == 4]


def test_greedy_matching_is_the_sequential_choice(spark):
    rng = random.Random(8)
    for n in (1, 40, 300):
        rows = list({(rng.randrange(3), rng.randrange(12), rng.randrange(12)): None for _ in range(n)})
        rows = [(t, a, b, float(rng.randrange(6))) for t, a, b in rows] + [(9, k, k + d, float(k * 2 + d)) for k in range(12) for d in (0, 1)]  # and one long chain
        used, want = set(), []
        for d, t, a, b in sorted((d, t, a, b) for t, a, b, d in rows):
            if ("a", t, a) not in used and ("b", t, b) not in used:
                used |= {("a", t, a), ("b", t, b)}
                want.append((t, a, b))
        frame = spark.createDataFrame(rows, "t long, a long, b long, d double")
        got = matching.greedy_matching(frame, ["t", "a"], ["t", "b"], ["d"]).collect()
        assert sorted((r.t, r.a, r.b) for r in got) == sorted(want)


@pytest.mark.parametrize("name", ["jon23_match_one_to_one", "jon40_known_retraces"])
def test_pairs_of_whole_tables(spark, name, monkeypatch):
    from trekframe.plans import load_queries

    held = {}
    real = matching.greedy_matching
    monkeypatch.setattr(matching, "greedy_matching", lambda rows, *args: real(held.setdefault("rows", rows), *args))
    got = sorted(tuple(r) for r in load_queries()[0][name](spark, "/root/testdata/sf0.001").collect())
    used, want = set(), []
    for d, t, a, b in sorted((r.metres, r.trail_id, r.a, r.b) for r in held["rows"].collect()):
        if ("a", t, a) not in used and ("b", t, b) not in used:
            used |= {("a", t, a), ("b", t, b)}
            want.append((t, a, b))
    assert got == sorted(want) and want


def plain_registry(waypoints, entries, radius=150.0, unmoved=1.0):
    out, kept = {}, set()
    for trail in {w[0] for w in waypoints}:
        wps, own = sorted(w for w in waypoints if w[0] == trail), [e for e in entries if e[0] == trail]
        cand = {}
        for w in wps:
            found = [(e[3] != w[3], metres_between(*w[4:6], *e[4:6]), e[1]) for e in own if e[2] == w[2] and not (e[6] and e[3] != w[3])]
            cand[w[1]] = sorted(c for c in found if c[1] <= radius)
        named, got = {}, {}
        for d, w, i in sorted((c[1], w, c[2]) for w, cs in cand.items() for c in cs if not c[0]):
            if w not in got and i not in named:
                named[i], got[w] = w, (i, d)
        names, moved = {w[1]: w[3] for w in wps}, set()
        for a in got:
            for b in got:
                if a < b and names[a] == names[b] and min(got[a][1], got[b][1]) > unmoved and any(c[2] == got[b][0] and not c[0] for c in cand[a]) and any(c[2] == got[a][0] and not c[0] for c in cand[b]):
                    moved |= {a, b}
        taken = dict(named)
        for w in wps:
            key, w = (trail, w[1]), w[1]
            if w in got:
                out[key] = "moved" if w in moved else "named", None if w in moved else got[w][0]
                continue
            pick = next((c for c in cand[w] if c[2] not in taken), None)
            if pick:
                taken[pick[2]] = w
                out[key] = "near", pick[2]
                continue
            block = next((c for c in cand[w] if not c[0] or c[2] not in named), None)
            out[key] = ("duplicate" if not block[0] else "ambiguous", None) if block else ("minted-beside" if cand[w] else "minted", "new")
        kept |= {(trail, i) for i in taken}
    return out, sorted((e[0], e[1]) for e in entries if (e[0], e[1]) not in kept)


@pytest.mark.parametrize("seed", [1, 2])
def test_registry_against_the_sequential_form(spark, seed):
    rng = random.Random(seed)
    spot = lambda: (rng.randrange(5) * 60 * M, rng.randrange(5) * 60 * M + rng.randrange(3) * 1e-7)
    waypoints = [(t, k, rng.choice(["camp", "water"]), rng.choice("abcdef"), *spot()) for t in (1, 2, 3) for k in range(rng.choice([3, 14, 25]))]
    entries = [(t, f"{t}{k:07d}", rng.choice(["camp", "water"]), rng.choice("abcdefg"), *spot(), rng.random() < 0.25) for t in (1, 2, 4) for k in range(18)]
    w = spark.createDataFrame(waypoints, "trail_id long, wp long, type string, name string, lat double, lon double")
    e = spark.createDataFrame(entries, "trail_id long, id string, type string, name string, lat double, lon double, retired boolean")
    ids, retire = matching.resolve_registry(w, e)
    got = {(r.trail_id, r.wp): (r.state, r.id) for r in ids.collect()}
    want, gone = plain_registry(waypoints, entries)
    assert {k: (s, "new" if s.startswith("minted") else i) for k, (s, i) in got.items()} == want
    assert sorted(tuple(r) for r in retire.collect()) == gone
    new = [(k[0], i) for k, (s, i) in got.items() if s.startswith("minted")]
    assert len(set(new)) == len(new) and all(len(i) in (8, 12) for _, i in new)


def test_entries_name_the_retraces_nearest_to_them(spark):
    found = spark.createDataFrame([(1, 1, 5.0, 3.0), (1, 2, 6.2, 3.0), (1, 3, 40.0, 7.0)], "trail_id long, retrace_id long, turn_km double, length_km double")
    known = spark.createDataFrame([(1, 1, 5.9, 3.2), (1, 2, 4.2, 3.4), (1, 3, 40.1, 4.0), (1, 4, 90.0, 3.0)], "trail_id long, entry_id long, entry_km double, entry_length_km double")
    pairs, stale = matching.pair_retraces(found, known)
    assert sorted((r.retrace_id, r.entry_id) for r in pairs.collect()) == [(1, 2), (2, 1)] and sorted(r.entry_id for r in stale.collect()) == [3, 4]


def test_a_city_keeps_its_ends_and_an_anchor_every_two_km(spark):
    rows = [(1, k, 10 + k / 30, "food", "supermarket" if k % 10 == 0 else None, k == 40, k / 100, k == 57) for k in range(120)] + [(1, 900 + k, 50.0 + 5 * k, "food", None, False, 0.1, False) for k in range(5)]
    frame = spark.createDataFrame(rows, "trail_id long, place_id long, km double, category string, anchor string, branded boolean, off_km double, kept boolean")
    stretches = ordered.dense_stretches(frame, 15.0, 7.5, 40, 5)
    assert [(r.from_bin, r.to_bin) for r in stretches.collect()] == [(10, 13)]
    got = {r.place_id for r in ordered.thin_dense(frame, stretches).collect()}
    assert got == {0, 40, 57, 60, 119, *range(900, 905)}  # ends, one of a brand, one kept, the nearest of the second two km


def test_an_unchanged_route_comes_back_as_it_was_and_a_loop_keeps_its_leg(spark):
    track = [(*r, 0.0, False) for r in line(1, [*OUT, *OUT[-2::-1]])]
    frame = spark.createDataFrame(track, POINTS + ", ele double, is_break boolean")
    n = len(track)
    same = [(1, k, 1, "snap", track[k][2], track[k][3], track[k][4]) for k in (0, 5, 20, 35, n - 1)]
    grown = [(2, k, 1, "snap", track[k][2], track[k][3] + 30 * M, track[k][4] - 0.35) for k in (3, 20, 33, 38)]
    off = [(3, 0, 1, "snap", 900 * M, 400 * M, 0.4), (3, 1, 1, "sketch", 0.0, 0.0, None)]
    taps = spark.createDataFrame(same + grown + off, "route_id long, seq long, trail_id long, kind string, lat double, lon double, km double")
    got = {(r.route_id, r.seq): r for r in replan.resnap_routes(taps, frame).collect()}
    assert all(not got[1, k].moved and got[1, k].km == track[k][4] for _, k, *_ in same)
    assert [round(got[2, k].km, 6) for k in (3, 20, 33, 38)] == [round(track[k][4], 6) for k in (3, 20, 33, 38)]
    assert got[3, 0].kind == "sketch" and got[3, 0].km is None and got[3, 0].moved and not got[3, 1].moved


def plain_access(edges, nodes, places, touches, snap=300.0, slack=60.0):
    """Dijkstra's search from each place."""
    import heapq

    links = {}
    for a, b, m in edges:
        links.setdefault(a, []).append((b, m))
        links.setdefault(b, []).append((a, m))
    climb = lambda a, b: 0.0 if a is None or b is None else abs(a - b)
    out = {}
    for place, lat, lon, ele in places:
        seeds = sorted((metres_between(lat, lon, *nodes[n][:2]), n) for n in nodes if metres_between(lat, lon, *nodes[n][:2]) <= snap)
        for own in ([s for s in seeds if s[0] <= seeds[0][0] + slack] if seeds else [], seeds):
            heap, done = [], set()
            for d, n in own:
                rise = climb(ele, nodes[n][2])
                if not (d > 150 and n in touches and not (d <= 500 and rise <= d * 0.2)):
                    heapq.heappush(heap, (3 * d + 5000 / 600 * rise, n, d))
            while heap:
                cost, n, walked = heapq.heappop(heap)
                if n in done:
                    continue
                done.add(n)
                if n in touches:
                    out[place] = (n, round(cost, 4), round(walked, 4))
                    break
                for to, m in links.get(n, ()):
                    heapq.heappush(heap, (cost + 2 * m + 5000 / 600 * climb(nodes[n][2], nodes[to][2]), to, walked + m))
            if place in out:
                break
    return out


def test_access_walks_against_dijkstra(spark):
    from trekframe.operators.access import access_walks
    from trekframe.plans.moves import lattice

    network, nodes, places, route = lattice(spark, "/root/testdata/sf0.001")
    edges = [(r.a, r.b, r.metres) for r in network.collect()]
    spots = {r.node: (r.lat, r.lon, r.ele) for r in nodes.collect()}
    on_route = [(r.lat, r.lon) for r in route.collect()]
    columns = {lon for _, lon in on_route}
    touches = {n for n, (lat, lon, _) in spots.items() if any(abs(lon - c) < 1e-9 for c in columns) and lat <= max(y for y, _ in on_route) + 1e-9}
    got = {r.place_id: r for r in access_walks(network, nodes, places, route).collect()}
    want = plain_access(edges, spots, [tuple(r) for r in places.select("place_id", "lat", "lon", "ele").collect()], touches)
    assert set(got) == set(want) and len(want) > 50
    for k, (node, effort, walked) in want.items():
        assert round(got[k].effort, 4) == pytest.approx(effort, abs=2e-4)
        if got[k].node == node:
            assert got[k].length_m == pytest.approx(walked, abs=0.01) or got[k].effort == pytest.approx(effort)
    assert sum(got[k].node == want[k][0] for k in want) >= 0.9 * len(want) and max(r.hops for r in got.values()) > 5
