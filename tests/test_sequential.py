import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trekframe.functions import text
from trekframe.operators import sequential as S


def test_douglas_peucker_keeps_what_is_far():
    rng = random.Random(1)
    lat = np.cumsum([rng.uniform(-1, 1) for _ in range(200)]) * 1e-3 - 35
    lon = np.cumsum([rng.uniform(0, 1) for _ in range(200)]) * 1e-3 + 148
    kept = S.douglas_peucker(lat, lon, 80.0)
    assert kept[0] == 0 and kept[-1] == 199 and len(kept) < 200
    for a, b in zip(kept, kept[1:]):
        assert b - a < 2 or S._offline_m(lat, lon, a, b).max() <= 80.0
    target = S.simplify_to_target(lat, lon, 30)
    assert abs(len(target) - 30) <= 6


def test_rate_limit_counts_only_allowed(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 5000)) for k in range(3) for i in range(60)]
    got = {(r.key, r.seq): r.allowed for r in S.rate_limited(spark.createDataFrame(rows, "key long, seq long, ms long"), 3, 1000).collect()}
    for k in range(3):
        allowed = []
        for ms, i in sorted((ms, i) for kk, i, ms in rows if kk == k):
            ok = sum(ms - 1000 < t <= ms for t in allowed) < 3
            assert got[k, i] == ok
            if ok:
                allowed.append(ms)


def test_pack_in_order(spark):
    rows = [(1, i, s) for i, s in enumerate([3.0, 4.0, 5.0, 20.0, 1.0, 9.0])] + [(2, 0, 1.0)]
    got = {r.trail_id: list(r.batches) for r in S.pack_in_order(spark.createDataFrame(rows, "trail_id long, seq int, size double"), 10).collect()}
    assert got == {1: [0, 0, 1, 2, 3, 3], 2: [0]}


def test_beam_finds_the_cheapest_plan():
    camps = [(3.0, 1), (7.0, 2), (10.0, 3), (14.0, 4), (19.0, 5), (24.0, 6)]
    total, target, most = 28.0, 8.0, 12.0

    def cost(path):
        at, c = 0.0, 0.0
        for camp in path:
            km = dict((i, k) for k, i in camps)[camp]
            if km - at > most or km <= at:
                return None
            c += ((km - at - target) / target) ** 2
            at = km
        rest = total - at
        return None if rest > most else c + (0 if rest <= target else ((rest - target) / target) ** 2)

    every = [(cost(p), list(p)) for n in range(7) for p in itertools.combinations([1, 2, 3, 4, 5, 6], n) if cost(p) is not None]
    assert S.beam_days(camps, total, target, most, width=50)[0] == min(every)[1]


def every_plan(camps, total, target, most, days):
    """All plans by brute force: ``(mean cost, days, camps, reaches the end)``, and the days where all fall short."""
    at = {i: k for k, i in camps}
    ended, short = [], {}
    for n in range(len(camps) + 1):
        for path in itertools.combinations([i for k, i in sorted(camps)], n):
            stops = [0.0, *(at[i] for i in path)]
            legs = [b - a for a, b in zip(stops, stops[1:])]
            if n > days or any(not 0 < x <= most for x in legs):
                continue
            cost = sum(((x - target) / target) ** 2 for x in legs)
            if n:
                short.setdefault(n, []).append((cost / n, n, path, False))
            rest = total - stops[-1]
            if n < days and rest <= most:
                forced = n == 0 or total - stops[-2] > most
                ended.append(((cost + (0.0 if forced and rest <= target else ((rest - target) / target) ** 2)) / (n + 1), n + 1, path, True))
    if ended or days in short:
        return ended + short.get(days, []), None
    return (short[max(short)], max(short)) if short else ([], None)


def test_days_without_the_end_against_all_plans(spark):
    rng = random.Random(3)
    kinds = set()
    for _ in range(150):
        total, days = rng.choice([30.0, 60.0, 100.0]), rng.randint(2, 5)
        camps = [(round(rng.uniform(0.5, total - 0.5), 2), i) for i in range(rng.randint(1, 9))]
        want, short = every_plan(camps, total, 12.0, 25.0, days)
        got = S.rank_days(camps, total, 12.0, 25.0, days, width=1000)
        assert bool(got) == bool(want)
        if want:
            best = min(want)
            assert got[0] == (best[2], best[3], short) and {g[0] for g in got} == {w[2] for w in want}
            kinds.add((best[3], short is None))
    assert kinds == {(True, True), (False, True), (False, False)}


def test_suggested_days_of_long_trails_and_wide_gaps(spark):
    long = [(1, 12.0 * i, i, 400.0) for i in range(1, 34)]
    gap = [(2, 12.0, 1, 90.0), (2, 24.0, 2, 90.0), (2, 60.0, 3, 90.0)]
    near = [(3, 12.0, 1, 20.0)]
    frame = spark.createDataFrame(long + gap + near + [(4, 30.0, 1, 90.0)], "trail_id long, km double, camp long, total double")
    got = sorted((r.trail_id, r.day, r.camp, r.short_of) for r in S.suggest_days(frame, 12.0, 25.0).collect())
    assert got == [(1, d, d, None) for d in range(1, 15)] + [(2, 1, 1, 2), (2, 2, 2, 2), (3, 1, 1, None), (3, 2, None, None)]


def test_chains():
    assert [c[:2] for c in S.chain_tracks([(1, 0, 0, 0, 1), (2, 0, 5, 0, 3), (3, 0, 3, 0, 1.1)])] == [(1, False), (3, True), (2, True)]
    days = S.chain_tracks([(2, 0, 10, 0, 20), (1, 0, 0, 0, 9.9), (3, 0, 31, 0, 20.1)])  # day 2 stands first and is not turned round
    assert [c[:2] for c in days] == [(1, False), (2, False), (3, True)] and days[0][2] is None and 11_000 < days[1][2] < 11_200
    assert [c[:2] for c in S.chain_tracks([(1, 0, 10, 0, 20), (2, 0, 9.9, 0, 5)])] == [(2, True), (1, False)]


def test_letters_in_order_and_python_text(spark):
    rows = [("lake camp", "lake camp"), ("north hut", "norht hut"), ("", "x"), (None, "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(text.lcs_ratio("a", "b")).collect()]

    def lcs(a, b):
        return 0 if not a or not b else 1 + lcs(a[:-1], b[:-1]) if a[-1] == b[-1] else max(lcs(a[:-1], b), lcs(a, b[:-1]))

    assert got == [pytest.approx(2 * lcs(a or "", b) / (len(a or "") + len(b))) for a, b in rows]
    one = spark.createDataFrame([("x | St. Mary is far. Next.", "&#65;&#0;&lt;", "::ffff:1.2.3.4", "2001:db8:1:2:3::4", "Café – Mt Éa - x")], "s string, e string, a string, b string, n string")
    r = one.select(text.first_sentence("s").alias("s"), text.decode_entities("e").alias("e"), text.rate_key("a").alias("a"), text.rate_key("b").alias("b"), text.name_tokens(F.col("n")).alias("n")).first()
    assert (r.s, r.e, r.a, r.b, list(r.n)) == ("St. Mary is far.", "A&#0;<", "1.2.3.4", "2001:db8:1:2::/64", ["cafe", "mount", "ea"])


def test_suggestions_differ_as_long_as_they_can():
    km = {k: float(k) * 0.6 for k in range(60)}
    ranked = S.rank_days([(v, k) for k, v in km.items()], 30.0, 10.0, 14.0, days=4, width=12)
    got = S.told_apart(ranked, km, 3)
    assert got[0] == ranked[0] and len(got) == 3 and got != ranked[:3]
    for i, a in enumerate(got):
        for b in got[:i]:
            assert len(a[0]) != len(b[0]) or a[1] != b[1] or any(abs(km[x] - km[y]) >= 1 for x, y in zip(a[0], b[0]))
    close = [((1,), True, None), ((2,), True, None), ((3,), True, None)]
    assert S.told_apart(close, {1: 5.0, 2: 5.5, 3: 9.0}, 2) == [close[0], close[2]] and S.told_apart(close, {1: 5.0, 2: 5.5, 3: 5.2}, 2) == close[:2]
