"""Recurrences that no set operation expresses: each trail is one group, and many trails run in parallel.

A trail is small (recorded tracks have some hundred thousand points at most), so a group fits in a task whatever the
size of the table. The helpers take plain arrays and are tested on their own.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EARTH_M = 6_371_000.0


def _offline_m(lat, lon, a: int, b: int) -> np.ndarray:
    """Metres of the points between ``a`` and ``b`` from the segment of both, on a plane that is true at its mean latitude."""
    k = math.cos(math.radians((lat[a] + lat[b]) / 2))
    scale = math.pi / 180 * _EARTH_M
    x, y = (lon[a + 1 : b] - lon[a]) * k * scale, (lat[a + 1 : b] - lat[a]) * scale
    dx, dy = (lon[b] - lon[a]) * k * scale, (lat[b] - lat[a]) * scale
    square = dx * dx + dy * dy
    t = np.clip((x * dx + y * dy) / square, 0, 1) if square else 0.0
    return np.hypot(x - t * dx, y - t * dy)


def douglas_peucker(lat: np.ndarray, lon: np.ndarray, tolerance_m: float) -> np.ndarray:
    """Sorted indexes of the kept points: ends, and whatever lies farther than the tolerance from its chord (SIM01)."""
    n = len(lat)
    keep = np.zeros(n, dtype=bool)
    keep[[0, n - 1]] = True
    todo = [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        away = _offline_m(lat, lon, a, b)
        far = int(np.argmax(away))
        if away[far] > tolerance_m:
            keep[a + 1 + far] = True
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return np.flatnonzero(keep)


def simplify_to_target(lat, lon, target: int, rounds: int = 20) -> np.ndarray:
    """Bisects the tolerance between 1 and 500 m (SIM02). The last result with at most ``target`` points counts, or the
    first within a tenth of it; all points if there is none."""
    best = np.arange(len(lat))
    if len(lat) <= target:
        return best
    lo, hi = 1.0, 500.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        got = douglas_peucker(lat, lon, mid)
        if len(got) > target:
            lo = mid
        else:
            hi, best = mid, got
        if abs(len(got) - target) < 0.1 * target:
            return got
    return best


def simplify(points: DataFrame, tolerance_m: float | None = None, target: int | str | None = None) -> DataFrame:
    """``(trail_id, idx)`` of the points kept of each stretch (SIM01, SIM02, SIM04, SNK06).

    ``target`` is a number of points, or a column that has one for each stretch. Points are dealt by stretch and sorted once, and a task walks its stretches one after the other.
    """

    def thin(batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(6)]
            held = now if held is None else [np.concatenate(pair) for pair in zip(held, now)]
            edges = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            if len(edges):
                yield work([c[: edges[-1]] for c in held], edges[:-1])
                held = [c[edges[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield work(held, np.empty(0, dtype=np.int64))

    def work(columns, edges) -> pa.RecordBatch:
        trail, _, idx, lat, lon, most = columns
        kept = []
        for a, b in zip([0, *edges], [*edges, len(idx)]):
            own = douglas_peucker(lat[a:b], lon[a:b], tolerance_m) if target is None else simplify_to_target(lat[a:b], lon[a:b], int(most[a]))
            kept.append(a + own)
        at = np.concatenate(kept)
        return pa.RecordBatch.from_arrays([pa.array(trail[at]), pa.array(idx[at])], names=["trail_id", "idx"])

    rows = points.select(F.col("trail_id").cast("long"), F.col("stretch").cast("long"), F.col("idx").cast("long"), F.col("lat").cast("double"), F.col("lon").cast("double"), (F.col(target) if isinstance(target, str) else F.lit(target or 0)).cast("long").alias("most"))
    rows = rows.dropna().repartition("trail_id", "stretch").sortWithinPartitions("trail_id", "stretch", "idx")
    return rows.mapInArrow(thin, "trail_id long, idx long")


def pack_in_order(sizes: DataFrame, most: float, key: str = "trail_id", order: str = "seq", size: str = "size") -> DataFrame:
    """``(key, batches)``: rows dealt in order into batches that hold at most ``most`` (SIM05, SIM06).

    A fold over the ordered array, in the JVM; ``batches`` has the batch of each row.
    """
    series = sizes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("s"))
    start = F.struct(F.lit(0.0).alias("used"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def step(acc, x):
        fits = (acc["used"] + x[size] <= most) | (acc["used"] == 0)
        n = F.when(fits, acc["n"]).otherwise(acc["n"] + 1)
        return F.struct(F.when(fits, acc["used"] + x[size]).otherwise(x[size].cast("double")).alias("used"), n.alias("n"), F.array_append(acc["at"], n).alias("at"))

    return series.select(key, F.aggregate("s", start, step)["at"].alias("batches"))


def rate_limited(events: DataFrame, limit: int, window_ms: int, key: str = "key", at: str = "ms", tie: str = "seq") -> DataFrame:
    """``(key, seq, allowed)``: at most ``limit`` allowed events in any window; refused ones do not count (STM04)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, tie])
        kept: list[int] = []
        out = []
        for t in rows[at]:
            kept = [k for k in kept if k > t - window_ms]
            allowed = len(kept) < limit
            if allowed:
                kept.append(t)
            out.append(allowed)
        return pd.DataFrame({key: rows[key], tie: rows[tie], "allowed": out})

    return events.select(key, tie, at).groupBy(key).applyInPandas(one, f"{key} long, {tie} long, allowed boolean")


def metres_between(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(a), math.sqrt(1 - a))


def chain_tracks(ends: list[tuple]) -> list[tuple[int, bool, float | None]]:
    """Order, direction and gap before each of tracks ``(id, lat1, lon1, lat2, lon2)`` (SIM08).

    The chain begins with the first track as it is drawn and grows at both ends: the nearest free end of all tracks left is
    put behind it, or before it, turned round where that end asks for it. Ties go to the end of the chain, then to the
    track that stands first.
    """
    left = list(ends[1:])
    chain = [(ends[0][0], False, ends[0][1:3], ends[0][3:5])]  # id, reversed, where it starts and ends
    while left:
        head, tail = chain[0][2], chain[-1][3]
        ways = []
        for k, t in enumerate(left):
            start, end = t[1:3], t[3:5]
            ways += [(metres_between(*x, *y), k, n) for n, (x, y) in enumerate(((tail, start), (tail, end), (head, start), (head, end)))]
        _, k, n = min(ways)
        t = left.pop(k)
        turned = n in (1, 2)
        link = (t[0], turned, *((t[3:5], t[1:3]) if turned else (t[1:3], t[3:5])))
        chain = [link, *chain] if n > 1 else [*chain, link]
    return [(c[0], c[1], metres_between(*before[3], *c[2]) if before else None) for before, c in zip([None, *chain], chain)]


def combine_tracks(tracks: DataFrame, warn_m: float = 100.0) -> DataFrame:
    """``(trail_id, track_id, place, reversed, gap_m)`` of each trail's tracks in walking order; ``gap_m`` is the distance from
    the track before where that is over ``warn_m``. The first track is that of the least id."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("track_id")
        order = chain_tracks(list(rows[["track_id", "lat1", "lon1", "lat2", "lon2"]].itertuples(index=False, name=None)))
        gaps = [g if g is not None and g > warn_m else None for _, _, g in order]
        return pd.DataFrame({"trail_id": rows["trail_id"].iloc[0], "track_id": [t for t, _, _ in order], "place": range(len(order)), "reversed": [r for _, r, _ in order], "gap_m": pd.array(gaps, dtype="Float64")})

    return tracks.groupBy("trail_id").applyInPandas(one, "trail_id long, track_id long, place int, reversed boolean, gap_m double")


def rank_days(camps: list[tuple[float, int]], total: float, target: float, most: float, days: int = 14, width: int = 8) -> list[tuple[tuple, bool, int | None]]:
    """``(camps slept at, whether the end is reached, short_of)`` of the plans, least mean cost of a day first (SRT11, SRT12).

    A layer per day holds the best few plans that end at each camp ``(km, id)``. Complete are those that reach the end
    and those that fill all ``days``; where there are none, the deepest layer's plans are returned, with ``short_of``
    the number of days that they cover. A day costs its squared miss of ``target`` and is never over ``most``. The last
    day to the end may be short for free, unless the day before could have walked out itself. Ties go to fewer days.
    """
    camps = sorted(c for c in camps if 0 < c[0] < total)
    kms = [km for km, _ in camps]

    def cost_of(km: float) -> float:
        return ((km - target) / target) ** 2

    layer = {(0.0, -1): [(0.0, (), None)]}
    done: list[tuple[float, tuple]] = []
    deepest: list[tuple[float, tuple]] = []
    depth = 0
    for day in range(1, days + 1):
        nxt: dict = {}
        for (km, _), plans in layer.items():
            rest = total - km
            near = camps[bisect.bisect_right(kms, km) : bisect.bisect_right(kms, km + most + 1e-9)]
            for cost, path, before in plans:
                if rest <= most + 1e-9:
                    forced = before is None or total - before > most + 1e-9
                    done.append(((cost + (0.0 if forced and rest <= target else cost_of(rest))) / day, path))
                for at, camp in near:
                    nxt.setdefault((at, camp), []).append((cost + cost_of(at - km), (*path, camp), km))
        layer = {k: heapq.nsmallest(width, v) for k, v in nxt.items()}
        if layer:
            depth, deepest = day, [(cost / day, path) for v in layer.values() for cost, path, _ in v]
    full = deepest if depth == days else []
    short = None if done or full else depth
    found = [(c, len(p) + 1, p, True) for c, p in done] + [(c, len(p), p, False) for c, p in (full if short is None else deepest)]
    return [(path, reaches, short) for _, _, path, reaches in sorted(found)]


def told_apart(ranked: list[tuple[tuple, bool, int | None]], km_of: dict, most: int, near_km: float = 1.0) -> list[tuple[tuple, bool, int | None]]:
    """The first ``most`` of ranked plans, without those like a better one as long as there are others; in their order."""

    def alike(a, b) -> bool:
        return len(a[0]) == len(b[0]) and a[1] == b[1] and all(abs(km_of[x] - km_of[y]) < near_km for x, y in zip(a[0], b[0]))

    chosen: list[int] = []
    for k, plan in enumerate(ranked):
        if len(chosen) < most and not any(alike(ranked[c], plan) for c in chosen):
            chosen.append(k)
    chosen += [k for k in range(len(ranked)) if k not in chosen][: most - len(chosen)]
    return [ranked[k] for k in sorted(chosen)]


def beam_days(camps: list[tuple[float, int]], total: float, target: float, most: float, days: int = 14, width: int = 8) -> list[list[int]]:
    """The camps of each plan of ``rank_days``, best first."""
    return [list(path) for path, _, _ in rank_days(camps, total, target, most, days, width)]


def greedy_stops(camps: list[tuple[float, int]], km: np.ndarray, hours: np.ndarray, start: float, end: float, target_h: float) -> list[tuple[float, int | None]]:
    """``(km, camp)`` of the nights between two places (SRT13), with the walking time to each ``km`` of a profile.

    A day goes on for ``target_h``; the last two are balanced, and a rest that a day can hold ends it. A night is at the camp
    nearest in time within a window, unless too little would be left, else in the wild, to a tenth of a kilometre.
    """
    target_h = max(0.1, target_h)
    window, floor = min(2.5, max(0.75, target_h * 0.35)), max(0.75, target_h * 0.25)
    time = lambda x: float(np.interp(x, km, hours))
    inner = sorted(c for c in camps if start < c[0] < end)
    out, last = [], start
    for _ in range(500):
        rest = time(end) - time(last)
        if rest <= target_h + floor:
            break
        goal = rest / 2 if rest <= 2 * target_h else target_h
        near = [(abs(time(at) - time(last) - goal), at, camp) for at, camp in inner if at > last and time(end) - time(at) >= floor]
        near = [c for c in near if c[0] <= window]
        if near:
            _, last, camp = min(near, key=lambda c: c[0])
            out.append((last, camp))
        else:
            last = math.floor(float(np.interp(time(last) + goal, hours, km)) * 10 + 0.5) / 10
            out.append((last, None))
    return out


def day_stops(camps: DataFrame, profile: DataFrame, target_h: float, kmh: float = 4.0) -> DataFrame:
    """``(trail_id, day, km, camp)``: nights of each trail by ``greedy_stops``, a null camp in the wild (SRT13). ``camps`` are
    ``(trail_id, km, camp)``, ``profile`` ``(trail_id, km, ascent)`` with the running climb."""

    def one(key, c: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("km")
        if len(p) < 2:
            return pd.DataFrame({"trail_id": [], "day": [], "km": [], "camp": []})
        km, up = p["km"].to_numpy(), p["ascent"].to_numpy()
        hours = (km - km[0]) / kmh + (up - up[0]) / 600
        found = greedy_stops(list(c[["km", "camp"]].itertuples(index=False, name=None)), km, hours, float(km[0]), float(km[-1]), target_h)
        rows = [(key[0], day + 1, at, camp) for day, (at, camp) in enumerate(found)]
        return pd.DataFrame(rows, columns=["trail_id", "day", "km", "camp"]).astype({"camp": "Int64"})

    sides = camps.select("trail_id", "km", "camp").groupBy("trail_id"), profile.select("trail_id", "km", "ascent").groupBy("trail_id")
    return sides[0].cogroup(sides[1]).applyInPandas(one, "trail_id long, day int, km double, camp long")


def first_fit_boxes(boxes: list[tuple], most_km: float) -> list[int]:
    """The cluster of each box ``(west, south, east, north)``, taken in order: the first one that it overlaps and that stays
    within ``most_km`` with it, else a new one (SIM12)."""
    clusters: list[list[float]] = []
    out = []
    for w, s, e, n in boxes:
        for k, c in enumerate(clusters):
            u = [min(c[0], w), min(c[1], s), max(c[2], e), max(c[3], n)]
            wide = max(u[3] - u[1], (u[2] - u[0]) * math.cos(math.radians((u[1] + u[3]) / 2))) * 111.32
            if c[0] <= e and w <= c[2] and c[1] <= n and s <= c[3] and wide <= most_km:
                clusters[k] = u
                out.append(k)
                break
        else:
            clusters.append([w, s, e, n])
            out.append(len(clusters) - 1)
    return out


def cluster_candidates(candidates: DataFrame, most_km: float) -> DataFrame:
    """``(trail_id, id, cluster)`` of each trail's boxes ``(trail_id, id, km, west, south, east, north)`` along it (SIM12)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["km", "id"])
        found = first_fit_boxes(list(rows[["west", "south", "east", "north"]].itertuples(index=False, name=None)), most_km)
        return pd.DataFrame({"trail_id": rows["trail_id"], "id": rows["id"], "cluster": found})

    return candidates.groupBy("trail_id").applyInPandas(one, "trail_id long, id long, cluster int")


def corridor_chunks(points: DataFrame, radius_m: float, most: int = 300, gap_m: float | None = None) -> DataFrame:
    """``(trail_id, idx, line, chunk)``: stretches of tracks simplified at a quarter of the radius, joined over gaps of up to
    twice it, and cut into chunks of at most ``most`` rows that overlap by one (SIM04)."""
    from pyspark.sql import Window

    from trekframe.functions.geo import haversine_m

    kept = points.join(simplify(points, tolerance_m=max(1.0, radius_m / 4)), ["trail_id", "idx"], "left_semi")
    w = Window.partitionBy("trail_id").orderBy("idx")
    apart = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) > (2 * radius_m if gap_m is None else gap_m)
    fresh = F.coalesce((F.lag("stretch").over(w) != F.col("stretch")) & apart, F.lit(False))
    rows = kept.withColumn("_f", fresh.cast("int")).withColumn("line", F.sum("_f").over(w).cast("long"))
    own = Window.partitionBy("trail_id", "line")
    rows = rows.withColumn("k", F.row_number().over(own.orderBy("idx")) - 1).withColumn("n", F.count("*").over(own))
    at, step = F.floor(F.col("k") / (most - 1)), F.col("k") % (most - 1) == 0
    both = (F.col("n") > most) & step & (F.col("k") > 0)
    chunks = F.when(F.col("n") <= most, F.array(F.lit(0).cast("long"))).when(both & (F.col("k") == F.col("n") - 1), F.array(at - 1)).when(both, F.array(at - 1, at)).otherwise(F.array(at))
    return rows.select("trail_id", "idx", "line", F.explode(chunks).alias("chunk"))


def suggest_days(camps: DataFrame, target: float, most: float, plans: int = 1, days: int = 14) -> DataFrame:
    """``(trail_id, plan, day, camp, short_of)``: the best ``plans`` ways to cut each trail into days at its camps (SRT12), of
    four times as many kept for each camp and day. One that ends all its days within a kilometre of another's is given only if
    there are not enough others.

    ``camp`` is null on a day that walks out to the trail's end. ``short_of`` is the number of days covered where no
    plan reaches the end or fills all the days. A trail whose first day has no camp and no end in reach has no rows.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        camps, total = list(rows[["km", "camp"]].itertuples(index=False, name=None)), float(rows["total"].iloc[0])
        found = told_apart(rank_days(camps, total, target, most, days, 4 * plans), {camp: km for km, camp in camps}, plans)
        out = [(rows["trail_id"].iloc[0], p, d + 1, c, short) for p, (path, reaches, short) in enumerate(found) for d, c in enumerate((*path, None) if reaches else path)]
        return pd.DataFrame(out, columns=["trail_id", "plan", "day", "camp", "short_of"]).astype({"camp": "Int64", "short_of": "Int32"})

    schema = "trail_id long, plan int, day int, camp long, short_of int"
    return camps.select("trail_id", "km", "camp", "total").groupBy("trail_id").applyInPandas(one, schema)


def drop_close_stops(stops: DataFrame, least_km: float = 0.01, key: str = "trail_id") -> DataFrame:
    """``(key, seq)`` of stops kept: not of a waypoint met before, nor too near the last one kept (SET11)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        seen, last, keep = set(), None, []
        rows = rows.sort_values(["km", "seq"])
        for w, km in rows[["waypoint", "km"]].itertuples(index=False, name=None):
            ok = w not in seen and (last is None or km - last >= least_km)
            if ok:
                seen.add(w)
                last = km
            keep.append(ok)
        return rows[keep][[key, "seq"]]

    return stops.select(key, "seq", "km", "waypoint").groupBy(key).applyInPandas(one, f"{key} long, seq long")


def km_at_hours(index: pd.DataFrame, hours: float, kmh: float) -> float:
    """Kilometres reached after so many hours: the inverse of the walking time along a profile (WIN26)."""
    km, up = index["km"].to_numpy(), index["ascent"].to_numpy()
    time = (km - km[0]) / kmh + (up - up[0]) / 600
    return float(np.interp(hours, time, km))


def reach_in(hours: float, kmh: float, profile: DataFrame) -> DataFrame:
    """``(trail_id, km)`` reached on each trail (WIN26)."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"trail_id": [rows["trail_id"].iloc[0]], "km": [km_at_hours(rows.sort_values("km"), hours, kmh)]})

    return profile.select("trail_id", "km", "ascent").groupBy("trail_id").applyInPandas(one, "trail_id long, km double")
