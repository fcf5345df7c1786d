"""Nearest, radius and containment joins.

Places meet through cells of a grid, so that each side is shuffled once by cell and only near pairs are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.geo import EARTH_M, haversine_m, plane_distance_m, segment_fraction, wrap_lon
from trekframe.storage import materialize


class Grid:
    """Cells of at least ``radius_m`` on the whole globe: rows of latitude, each cut into as many columns as fit around it.

    Near the poles a row has few columns or one, and columns are numbered around the circle, so that places on both sides
    of the antimeridian, or around a pole, are neighbours like all others.
    """

    def __init__(self, radius_m: float):
        self.half = min(math.pi / 2, radius_m / EARTH_M / 2)  # half the angle that the radius spans
        self.step = min(180.0, math.degrees(2 * self.half) * 1.0001)

    def row(self, lat: Column) -> Column:
        return F.floor(lat / self.step)

    def columns(self, row: Column) -> Column:
        """How many columns a row has: places in it and in the rows beside it are less than one apart."""
        widest = F.least(F.lit(90.0), F.greatest(F.abs((row - 1) * self.step), F.abs((row + 2) * self.step)))
        sine = F.least(F.lit(1.0), math.sin(self.half) / F.greatest(F.cos(F.radians(widest)), F.lit(1e-12)))
        fit = F.floor(180.0 / (F.degrees(F.asin(sine)) * 1.0001) - 1e-9)
        return F.when(fit < 3, F.lit(1).cast("long")).otherwise(fit.cast("long"))

    def column(self, lon: Column, columns: Column) -> Column:
        return F.pmod(F.floor((lon + 180) / 360 * columns).cast("long"), columns)

    def own(self, lat: Column, lon: Column) -> list[Column]:
        """Row and column of a place."""
        row = self.row(lat)
        return [row.alias("cy"), self.column(lon, self.columns(row)).alias("cx")]

    def around(self, frame: DataFrame) -> DataFrame:
        """Rows with a place ``lat``, ``lon``, once for each cell ``(cy, cx)`` of those that hold all places within the radius."""
        rows = frame.withColumn("cy", F.explode(F.sequence(self.row(F.col("lat")) - 1, self.row(F.col("lat")) + 1)))
        rows = rows.withColumn("_n", self.columns(F.col("cy"))).withColumn("_x", self.column(F.col("lon"), F.col("_n")))
        near = F.array_distinct(F.array(*(F.pmod(F.col("_x") + k, F.col("_n")) for k in (-1, 0, 1))))
        return rows.select(*frame.columns, "cy", F.explode(near).alias("cx"))

    def along(self, frame: DataFrame) -> DataFrame:
        """Rows with a segment ``lat1``, ``lon1``, ``lat2``, ``lon2``, once for each cell ``(cy, cx)`` of those of all places within
        the radius of it, row by row along it."""
        lat1, lon1, lat2, lon2 = (F.col(c) for c in ("lat1", "lon1", "lat2", "lon2"))
        row, n, turn = F.col("cy"), F.col("_n"), wrap_lon(lon2 - lon1)
        rows = frame.withColumn("cy", F.explode(F.sequence(self.row(F.least(lat1, lat2)) - 1, self.row(F.greatest(lat1, lat2)) + 1)))

        def share(lat, other):
            return F.when(lat2 == lat1, F.lit(other)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (lat - lat1) / F.nullif(lat2 - lat1, F.lit(0.0)))))

        rows = rows.withColumns({"_n": self.columns(row), "_a": lon1 + turn * share((row - 1) * self.step, 0.0), "_b": lon1 + turn * share((row + 2) * self.step, 1.0)})
        rows = rows.withColumn("_x", F.floor((F.least("_a", "_b") + 180) / 360 * n).cast("long") - 1)
        rows = rows.withColumn("_y", F.least(F.floor((F.greatest("_a", "_b") + 180) / 360 * n).cast("long") + 1, F.col("_x") + n - 1))
        return rows.withColumn("_x", F.explode(F.sequence("_x", "_y"))).select(*frame.columns, "cy", F.pmod(F.col("_x"), n).alias("cx"))


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``left`` columns, ``right`` columns and ``metres`` of all pairs within ``radius_m``, anywhere on the globe (JON18).

    Both sides need ``lat`` and ``lon``; the right side's come back as ``r_lat`` and ``r_lon``. The left side goes to
    its own cell and those around it, the right side to its own. Rows without a position meet nothing.
    """
    grid = Grid(radius_m)
    a = grid.around(left)
    b = right.withColumnsRenamed({"lat": "r_lat", "lon": "r_lon"})
    b = b.select("*", *grid.own(F.col("r_lat"), F.col("r_lon")))
    met = a.join(b, ["cy", "cx", *keys]).withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return met.where(F.col("metres") <= radius_m).drop("cy", "cx")


def _spots(places: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(_spot, lat, lon, *keys)``: each position of places once, those without one left out; written down."""
    spots = places.select("lat", "lon", *keys).where("lat is not null and lon is not null").distinct()
    return materialize(spots.select(F.struct("lat", "lon", *keys).alias("_spot"), "*"), "spots")


def _at_spots(places: DataFrame, found: DataFrame, place_id: str, keys: tuple[str, ...], rank: list[str]) -> DataFrame:
    """``(place_id, *rank)``: what was found at the spots, for each place again."""
    met = places.select(place_id, F.struct("lat", "lon", *keys).alias("_spot")).join(found, "_spot")
    return met.groupBy(place_id).agg(F.min(F.struct(*rank)).alias("b")).select(place_id, *(f"b.{c}" for c in rank))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores: each of a short table may meet many cells."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *rows.columns)


def _first_radius(spots: DataFrame, keys: tuple[str, ...], radius_m: float) -> float:
    """The radius whose cells hold about one of the spots, 1/64 of ``radius_m`` at least: dense spots need no wide search."""
    n, cells = spots.select(F.struct(*keys, *Grid(radius_m).own(F.col("lat"), F.col("lon"))).alias("c")).agg(F.count("*"), F.count_distinct("c")).first()
    return radius_m * max(1 / 64, min(1.0, math.sqrt(cells / max(1, n))))


def _in_rings(rest: DataFrame, search: Callable[[DataFrame, float], DataFrame], first_m: float, most_m: float, spot: str = "_spot", widen: float = 4.0) -> DataFrame:
    """``search(rest, radius)`` in rings of growing radius, each written down: what is found within a ring is the nearest at
    all, and only the other spots go on to the next. The last ring is ``most_m`` wide."""
    if first_m * 2 > most_m:
        return search(rest, most_m)
    found, radius = None, first_m
    while True:
        got = materialize(search(rest, radius), "ring")
        found = got if found is None else found.unionByName(got)
        if radius >= most_m:
            return found
        rest = materialize(rest.join(got.select(spot), spot, "left_anti"), "rest")
        if rest.isEmpty():
            return found
        radius = min(radius * widen, most_m)


def nearest_within(left: DataFrame, right: DataFrame, left_id: str, right_id: str, radius_m: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(left_id, right_id, metres)`` of the nearest right place within the radius; the smaller id in a tie (JON12, JON15).
    Places with different ``keys`` do not meet. Places at one spot are searched for, and met, together, and where places are
    dense the search begins with a smaller radius."""
    spots = _spots(left, keys)
    at = materialize(right.where("lat is not null and lon is not null").groupBy("lat", "lon", *keys).agg(F.min(right_id).alias(right_id)), "at")

    def search(rest: DataFrame, radius: float) -> DataFrame:
        met = radius_pairs(_dealt(rest), at, radius, keys)
        return met.groupBy("_spot").agg(F.min(F.struct("metres", right_id)).alias("b")).select("_spot", "b.*")

    found = _in_rings(spots, search, _first_radius(at, keys, radius_m), radius_m)
    return _at_spots(left, found, left_id, keys, ["metres", right_id]).select(left_id, right_id, "metres")


def nearest_place(left: DataFrame, right: DataFrame, left_id: str, right_id: str, first_radius_m: float, widen: float = 4.0) -> DataFrame:
    """``(left_id, right_id, metres)`` of the nearest right place at any distance (JON17), in rings of growing radius; the last
    one spans the globe."""
    search = lambda rest, radius: nearest_within(rest, right, left_id, right_id, radius)
    return _in_rings(left.select(left_id, "lat", "lon"), search, first_radius_m, math.pi * EARTH_M, left_id, widen)


def near_rows(left: DataFrame, right: DataFrame, left_id: str, metres: float) -> DataFrame:
    """Left rows with any right place nearer than ``metres`` (JON19)."""
    ids = radius_pairs(left.select(left_id, "lat", "lon"), right.select("lat", "lon"), metres).where(F.col("metres") < metres).select(left_id).distinct()
    return left.join(ids, left_id, "left_semi")


def segments(points: DataFrame) -> DataFrame:
    """``(trail_id, idx, lat1, lon1, lat2, lon2, d1, d2)``: the steps of tracks, none across a break."""
    w = Window.partitionBy("trail_id").orderBy("idx")
    after = points.select(
        "trail_id", "idx", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2"),
        F.col("dist").alias("d1"), F.lead("dist").over(w).alias("d2"), F.lead("is_break").over(w).alias("_b"),
    )
    return after.where("lat2 is not null and not coalesce(_b, false)").drop("_b")


def snap_to_track(places: DataFrame, points: DataFrame, radius_m: float, place_id: str = "place_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(place_id, trail_id, idx, km, metres)``: where each place meets the nearest segment within the radius (JON14, JON15, JON47).

    A segment goes to the cells along it, a place to its own; the earlier segment wins a tie. With ``keys`` (``trail_id``),
    places meet only the track of their own. Places at one spot are snapped together, equal segments count as the first of
    them, and where places are dense the search begins with a smaller radius.
    """
    spots = _spots(places, keys)
    corners, own = ["lat1", "lon1", "lat2", "lon2"], [c for c in ("trail_id", "idx", "d1", "d2") if c not in keys]
    steps = segments(points).groupBy(*corners, *keys).agg(F.min(F.struct(*own)).alias("_s"))
    turn, k = wrap_lon(F.col("lon2") - F.col("lon1")), F.cos(F.radians("lat1"))
    steps = steps.select(*corners, *keys, "_s.*", turn.alias("turn"), k.alias("k"), (turn * k).alias("dx"), (F.col("lat2") - F.col("lat1")).alias("dy"))
    steps = _dealt(materialize(steps.withColumn("square", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), "steps"))
    along = (wrap_lon(F.col("lon") - F.col("lon1")) * F.col("k") * F.col("dx") + (F.col("lat") - F.col("lat1")) * F.col("dy")) / F.col("square")
    t = F.when(F.col("square") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)))

    def search(rest: DataFrame, radius: float) -> DataFrame:
        grid = Grid(radius)
        met = rest.select("*", *grid.own(F.col("lat"), F.col("lon"))).join(grid.along(steps), ["cy", "cx", *keys])
        met = met.select("*", F.explode(F.array(t)).alias("t"))  # a column of its own; written out in place, it makes code too long to be compiled
        met = met.withColumn("metres", haversine_m(F.col("lat"), F.col("lon"), F.col("lat1") + F.col("dy") * F.col("t"), F.col("lon1") + F.col("turn") * F.col("t")))
        km = F.col("d1") + (F.col("d2") - F.col("d1")) * F.col("t")
        return met.where(F.col("metres") <= radius).withColumn("km", km).groupBy("_spot").agg(F.min(F.struct("metres", "trail_id", "idx", "km")).alias("b")).select("_spot", "b.*")

    found = _in_rings(spots, search, _first_radius(spots, keys, radius_m), radius_m)
    return _at_spots(places, found, place_id, keys, ["metres", "trail_id", "idx", "km"]).select(place_id, "trail_id", "idx", "km", "metres")


def distance_to_line(places: DataFrame, points: DataFrame, radius_m: float, place_id: str = "place_id", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(place_id, trail_id, idx, metres, line_m)``: how far each place is from the track as a line (JON44).

    The place is snapped first (``idx``, ``metres``), which leaves out steps across breaks; ``idx`` is the point that it
    has reached, so one later if it lies past the segment's end. Then the two steps before that point and the two behind
    it are measured on the plane of the place, those across breaks too, and the least of all is ``line_m``. Points are
    numbered without gaps. A place without a segment in reach, and a track of one point, give no row.
    """
    snapped = snap_to_track(places, points, radius_m, place_id, keys).drop("km")
    w = Window.partitionBy("trail_id").orderBy("idx")
    steps = points.select(
        "trail_id", F.col("idx").alias("_at"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")
    ).where("lat2 is not null")
    near = snapped.join(places.select(place_id, "lat", "lon"), place_id).withColumn("_at", F.explode(F.sequence(F.col("idx") - 2, F.col("idx") + 2)))
    met = near.join(steps, ["trail_id", "_at"])
    past = segment_fraction(*(F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2"))) >= 1
    line = plane_distance_m(*(F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")))
    best = met.groupBy(place_id, "trail_id", "idx", "metres").agg(
        F.max(F.when(F.col("_at") == F.col("idx"), past)).alias("_past"),
        F.min(F.when(F.col("_at") <= F.col("idx") + 1, line)).alias("_here"),
        F.min(F.when(F.col("_at") >= F.col("idx") - 1, line)).alias("_next"),
    )
    least = F.least("metres", F.when(F.col("_past"), F.col("_next")).otherwise(F.col("_here")))
    return best.select(place_id, "trail_id", (F.col("idx") + F.col("_past").cast("int")).alias("idx"), "metres", least.alias("line_m"))


def nearest_on_route(places: DataFrame, points: DataFrame, first_radius_m: float, place_id: str = "place_id", widen: float = 4.0) -> DataFrame:
    """``(place_id, trail_id, idx, km, metres)`` of the nearest segment at any distance (JON16): rings of growing radius,
    each written down, as in ``nearest_place``."""
    search = lambda rest, radius: snap_to_track(rest, points, radius, place_id)
    return _in_rings(places.select(place_id, "lat", "lon"), search, first_radius_m, math.pi * EARTH_M, place_id, widen)


def bounds(points: DataFrame, buffer_deg: float = 0.0) -> DataFrame:
    """``(trail_id, south, north, west, east)`` with a margin (AGG33)."""
    return points.groupBy("trail_id").agg(
        (F.min("lat") - buffer_deg).alias("south"), (F.max("lat") + buffer_deg).alias("north"), (F.min("lon") - buffer_deg).alias("west"), (F.max("lon") + buffer_deg).alias("east")
    )


def cells_of(places: DataFrame, step: int, shards: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """``(lat, lon, shard, n)``: the cells of a world-wide lattice that hold places, with their number (SIM14); a cell belongs to
    the first shard ``(name, south, north, west, east)`` whose half-open box holds its centre, null if none does."""
    corner = lambda c: (F.floor(F.col(c) / step) * step).cast("int").alias(c)
    cells = places.groupBy(corner("lat"), corner("lon")).agg(F.count("*").alias("n"))
    y, x = F.col("lat") + step / 2, F.col("lon") + step / 2
    return cells.select("lat", "lon", F.coalesce(*(F.when((y >= s) & (y < n) & (x >= w) & (x < e), name) for name, s, n, w, e in shards)).alias("shard"), "n")


def visits(places: DataFrame, points: DataFrame, radius_m: float, place_id: str = "place_id", merge_loops: bool = False) -> DataFrame:
    """``(place_id, trail_id, visit, idx, metres)``: a row each time a track comes to a place (JON13).

    A visit begins at a row within ``radius_m`` and lasts until one beyond three times that; its nearest row counts,
    the earlier in a tie. Rows out of the wider radius are not in the join, so a jump in ``idx`` ends a visit as well.
    With ``merge_loops``, the visit in which a closed track ends is no second one of a place that is in reach of its first row.
    Places that stand at one spot are visited together: the track is followed once a spot, and places are met at the end.
    """
    spots = places.select("lat", "lon").where("lat is not null and lon is not null").distinct()
    per = _visits(spots.withColumn("_spot", F.struct("lat", "lon")), points, radius_m, "_spot", merge_loops)
    return places.select(place_id, F.struct("lat", "lon").alias("_spot")).join(per, "_spot").drop("_spot")


def _visits(places: DataFrame, points: DataFrame, radius_m: float, place_id: str, merge_loops: bool) -> DataFrame:
    met = radius_pairs(places.select(place_id, "lat", "lon"), points.select("trail_id", "idx", "lat", "lon"), 3 * radius_m)
    w = Window.partitionBy(place_id, "trail_id").orderBy("idx")
    met = met.withColumn("_run", F.sum(F.coalesce((F.col("idx") - F.lag("idx").over(w) > 1).cast("int"), F.lit(0))).over(w))
    per = met.groupBy(place_id, "trail_id", "_run").agg(F.min(F.struct("metres", "idx")).alias("b"), F.max("idx").alias("_until"), F.first("lat").alias("_lat"), F.first("lon").alias("_lon")).where(F.col("b.metres") <= radius_m)
    order = Window.partitionBy(place_id, "trail_id").orderBy("b.idx")
    per = per.withColumn("visit", F.row_number().over(order))
    if merge_loops:
        at = F.struct("lat", "lon")
        ends = points.groupBy("trail_id").agg(F.min_by(at, "idx").alias("_a"), F.max_by(at, "idx").alias("_z"), F.max("idx").alias("_end"))
        loops = ends.where(haversine_m(F.col("_a.lat"), F.col("_a.lon"), F.col("_z.lat"), F.col("_z.lon")) <= radius_m).select("trail_id", "_a", "_end")
        again = (F.col("visit") > 1) & (F.col("_until") == F.col("_end")) & (haversine_m(F.col("_lat"), F.col("_lon"), F.col("_a.lat"), F.col("_a.lon")) <= radius_m)
        per = per.join(loops, "trail_id", "left").where(~F.coalesce(again, F.lit(False)))
    return per.select(place_id, "trail_id", "visit", "b.idx", "b.metres")


def region_of(places: DataFrame, edges: DataFrame, place_id: str = "place_id") -> DataFrame:
    """``(place_id, region)``: the first region whose rings hold the place, by the even-odd rule (JON32).

    ``edges`` are ``(region, rank, lat1, lon1, lat2, lon2)``. An edge and a place meet in latitude bands of one degree.
    """
    bands = edges.withColumn("band", F.explode(F.sequence(F.floor(F.least("lat1", "lat2")), F.floor(F.greatest("lat1", "lat2")))))
    met = places.select(place_id, "lat", "lon", F.floor("lat").alias("band")).join(bands, "band")
    crosses = (F.col("lat1") > F.col("lat")) != (F.col("lat2") > F.col("lat"))
    at = F.col("lon1") + (F.col("lat") - F.col("lat1")) / F.nullif(F.col("lat2") - F.col("lat1"), F.lit(0.0)) * (F.col("lon2") - F.col("lon1"))
    odd = met.groupBy(place_id, "region", "rank").agg((F.count_if(crosses & (F.col("lon") < at)) % 2).alias("odd")).where("odd = 1")
    return odd.groupBy(place_id).agg(F.min_by("region", "rank").alias("region"))


def majority_region(points: DataFrame, edges: DataFrame, samples: int = 256, share: float = 0.02) -> DataFrame:
    """``(trail_id, country, states, state)`` of tracks ``(trail_id, idx, lat, lon)`` with ``idx`` from 0 on (AGG25).

    ``samples`` rows of each track, evenly spaced with the first and the last, vote for the region that holds them; ``edges``
    are as in ``region_of`` with the ``country`` of each region. The country is that with the most votes, of equal ones that
    reached first. Of its regions, ``states`` are those with a ``share`` of all votes, in the order they are reached, and
    ``state`` the one with the most. A track that no region holds has no row.
    """
    last = points.groupBy("trail_id").agg(F.max("idx").alias("last"))
    picks = last.where(F.col("last") >= samples).select("trail_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.floor(k * F.col("last") / (samples - 1) + 0.5))).alias("idx")).distinct()
    short = last.where(F.col("last") < samples).select("trail_id")
    chosen = points.join(short, "trail_id", "left_semi").unionByName(points.join(picks, ["trail_id", "idx"], "left_semi"))
    hits = region_of(chosen.select(F.struct("trail_id", "idx").alias("at"), "lat", "lon"), edges, "at").join(edges.select("region", "country").distinct(), "region")
    votes = hits.groupBy(F.col("at.trail_id").alias("trail_id"), "country", "region").agg(F.count("*").alias("n"), F.min("at.idx").alias("first"))
    of = Window.partitionBy("trail_id", "country")
    votes = votes.withColumns({"all": F.sum("n").over(Window.partitionBy("trail_id")), "in_country": F.sum("n").over(of), "reached": F.min("first").over(of)})
    best = votes.withColumn("r", F.rank().over(Window.partitionBy("trail_id").orderBy(F.desc("in_country"), "reached"))).where("r = 1")
    fair = F.col("n") >= F.greatest(F.lit(1), F.ceil(share * F.col("all")))
    out = best.groupBy("trail_id", "country").agg(F.array_sort(F.collect_list(F.when(fair, F.struct("first", "region")))).alias("s"), F.max_by("region", F.when(fair, F.struct("n", -F.col("first")))).alias("state"))
    return out.select("trail_id", "country", F.transform("s", lambda x: x["region"]).alias("states"), "state")


def near_duplicate_routes(routes: DataFrame, metres: float = 200.0, share: float = 0.05) -> DataFrame:
    """``(a, b)`` of routes with near ends and lengths within the share (JON39)."""
    starts = routes.select("id", F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), "end_lat", "end_lon", "km")
    other = starts.withColumnsRenamed({"id": "b", "end_lat": "b_end_lat", "end_lon": "b_end_lon", "km": "b_km"})
    met = radius_pairs(starts.withColumnRenamed("id", "a"), other, metres).where("a < b")
    ends = haversine_m(F.col("end_lat"), F.col("end_lon"), F.col("b_end_lat"), F.col("b_end_lon")) <= metres
    return met.where(ends & (F.abs(F.col("km") - F.col("b_km")) <= share * F.greatest("km", "b_km"))).select("a", "b")
