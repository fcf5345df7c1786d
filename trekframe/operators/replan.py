"""Stored routes, plans and rows carried over when the line below them changes.

Tracks are ``(trail_id, idx, lat, lon, ele, is_break, dist, cum_ascent, cum_descent)`` as ``track`` makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.geo import haversine_m, segment_distance_m, segment_fraction
from trekframe.functions.rounding import js_round
from trekframe.operators.spatial import radius_pairs, segments, snap_to_track
from trekframe.storage import materialize

SAME_KM = 1e-6  # smaller steps are rounding
KM_EPSILON = 0.01  # stops nearer than this are one place
END_SLACK_KM = 0.1


def resnap_routes(taps: DataFrame, track: DataFrame, threshold_m: float = 200.0, same_m: float = 1.0) -> DataFrame:
    """``(route_id, seq, kind, lat, lon, km, moved)``: the points of stored routes on a track that has changed (SIM17).

    ``taps`` are ``(route_id, seq, trail_id, kind, lat, lon, km)``. A snap point that still stands at the vertex of its km
    stays. Any other goes to the nearer end of the nearest segment within ``threshold_m``; beyond that it becomes a
    sketch point where it was. Where the track passes a place more than once, the pass is chosen that is nearest the
    point's old km moved by the shift of the nearest point of its route that is sure (kept, or on a place with one pass;
    the earlier of two equally near). All joins are by trail and cell; the choice needs one window a route.
    """
    key = ["route_id", "seq"]
    snaps = taps.where((F.col("kind") == "snap") & F.col("km").isNotNull()).select(*key, "trail_id", "lat", "lon", "km")
    width = 10 * SAME_KM
    cell = lambda km: F.floor(km / width)
    there = track.select("trail_id", "idx", "dist", F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), cell(F.col("dist")).alias("cell"))
    at_km = snaps.withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("km") - SAME_KM), cell(F.col("km") + SAME_KM))))).join(there, ["trail_id", "cell"])
    off = F.abs(F.col("dist") - F.col("km"))
    at_km = at_km.where(off < SAME_KM).groupBy(*key).agg(F.min_by(haversine_m(F.col("lat"), F.col("lon"), F.col("v_lat"), F.col("v_lon")), F.struct(off, F.col("idx"))).alias("m"))
    kept = materialize(at_km.where(F.col("m") <= same_m).select(*key), "kept")

    rest = snaps.join(kept, key, "left_anti").withColumn("tap", F.struct(*key))
    landed = snap_to_track(rest, track, threshold_m, "tap", keys=("trail_id",))
    ends = track.select("trail_id", "idx", F.col("dist").alias("d1")), track.select("trail_id", (F.col("idx") - 1).alias("idx"), F.col("dist").alias("d2"))
    landed = landed.join(ends[0], ["trail_id", "idx"]).join(ends[1], ["trail_id", "idx"])
    vertex = F.col("idx") + F.when(F.abs(F.col("d2") - F.col("km")) < F.abs(F.col("km") - F.col("d1")), 1).otherwise(0)
    spots = track.select("trail_id", "idx", "lat", "lon")
    landed = landed.select("tap", "trail_id", vertex.alias("idx")).join(spots, ["trail_id", "idx"]).select("tap", "trail_id", "lat", "lon")
    passes = radius_pairs(landed, track.select("trail_id", "idx", F.col("dist").alias("pass_km"), "lat", "lon"), same_m, ("trail_id",))
    passes = materialize(passes.select("tap", "lat", "lon", "idx", "pass_km"), "passes")

    found = passes.groupBy("tap").agg(F.count("*").alias("n"), F.min("pass_km").alias("one"), F.first("lat").alias("to_lat"), F.first("lon").alias("to_lon"))
    found = found.select("tap.*", "n", "one", "to_lat", "to_lon")
    rows = taps.join(kept.withColumn("is_kept", F.lit(True)), key, "left").join(found, key, "left")
    snap = (F.col("kind") == "snap") & F.col("km").isNotNull()
    rows = rows.withColumn("shift", F.when(F.col("is_kept"), 0.0).when(F.col("n") == 1, F.col("one") - F.col("km")))
    w = Window.partitionBy("route_id").orderBy("seq")
    rows = rows.withColumn("pos", F.row_number().over(w))
    sure = F.when(F.col("shift").isNotNull(), F.struct("pos", "shift"))
    rows = rows.withColumns({"_b": F.last(sure, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "_a": F.first(sure, True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    nearer = F.when(F.col("_a").isNull() | (F.col("pos") - F.col("_b.pos") <= F.col("_a.pos") - F.col("pos")), F.col("_b.shift")).otherwise(F.col("_a.shift"))
    rows = rows.withColumn("expected", F.col("km") + F.coalesce("shift", nearer, F.col("_a.shift"), F.lit(0.0)))

    chosen = passes.join(rows.select(F.struct(*key).alias("tap"), "expected"), "tap").groupBy("tap").agg(F.min_by("pass_km", F.struct(F.abs(F.col("pass_km") - F.col("expected")), F.col("idx"))).alias("new_km"))
    rows = rows.join(chosen.select("tap.*", "new_km"), key, "left")
    same = (F.abs(F.col("new_km") - F.col("km")) < SAME_KM) & (F.col("to_lat") == F.col("lat")) & (F.col("to_lon") == F.col("lon"))
    stays, gone = ~snap | F.col("is_kept").isNotNull() | F.coalesce(same, F.lit(False)), F.col("n").isNull()
    pick = lambda old, off_track, on_track: F.when(stays, old).when(gone, off_track).otherwise(on_track)
    return rows.select(
        *key, pick(F.col("kind"), F.lit("sketch"), F.col("kind")).alias("kind"), pick(F.col("lat"), F.col("lat"), F.col("to_lat")).alias("lat"), pick(F.col("lon"), F.col("lon"), F.col("to_lon")).alias("lon"),
        pick(F.col("km"), F.lit(None), F.col("new_km")).alias("km"), (~stays).alias("moved"),
    )


def planned_segments(plans: DataFrame, options: DataFrame, taken: DataFrame) -> DataFrame:
    """``(plan_id, segments)``: the line that each plan walks (SIM18), main, alternate, main ..., as an array of
    ``(name, from_km, to_km, route_km, length_km)`` with a null name on the main line.

    ``plans`` are ``(plan_id, trail_id, total_km)``, ``options`` ``(trail_id, name, from_km, to_km, length_km)``, ``taken``
    ``(plan_id, name)``. Alternates are taken in the order of their branch, none that overlaps one taken before; names
    that the trail does not offer are passed over. A plan's alternates are few, so they are folded in one array.
    """
    part = F.struct("from_km", "to_km", "name", "length_km")
    wanted = taken.distinct().join(plans.select("plan_id", "trail_id"), "plan_id").join(options, ["trail_id", "name"])
    wanted = wanted.groupBy("plan_id").agg(F.array_sort(F.collect_list(part)).alias("wanted"))
    rows = plans.select("plan_id", "total_km").join(wanted, "plan_id", "left")
    piece = "struct<name:string,from_km:double,to_km:double,route_km:double,length_km:double>"
    start = F.struct(F.lit(0.0).alias("main_km"), F.lit(0.0).alias("route_km"), F.array().cast(f"array<{piece}>").alias("out"))

    def main(acc: Column, to_km: Column) -> Column:
        return F.struct(F.lit(None).cast("string").alias("name"), acc["main_km"].alias("from_km"), to_km.alias("to_km"), acc["route_km"].alias("route_km"), (to_km - acc["main_km"]).alias("length_km"))

    def take(acc: Column, x: Column) -> Column:
        ok = (F.size(acc["out"]) == 0) | (x["from_km"] >= acc["main_km"] - KM_EPSILON)
        branch = acc["route_km"] + x["from_km"] - acc["main_km"]
        own = F.struct(x["name"].alias("name"), x["from_km"].alias("from_km"), x["to_km"].alias("to_km"), branch.alias("route_km"), x["length_km"].alias("length_km"))
        added = F.concat(acc["out"], F.array(main(acc, x["from_km"]), own))
        return F.when(ok, F.struct(x["to_km"].alias("main_km"), (branch + x["length_km"]).alias("route_km"), added.alias("out"))).otherwise(acc)

    done = F.aggregate(F.coalesce("wanted", F.array().cast("array<struct<from_km:double,to_km:double,name:string,length_km:double>>")), start, take, lambda acc: acc)
    rows = rows.withColumn("_d", done)
    return rows.select("plan_id", F.concat("_d.out", F.array(main(F.col("_d"), F.col("total_km")))).alias("segments"))


def _on_route(segs: Column, name: Column, km: Column) -> Column:
    """Whether a place on the main line (null name) or on an alternate is on the line of the segments."""

    def holds(s: Column) -> Column:
        on_main = s["name"].isNull() & km.between(s["from_km"] - KM_EPSILON, s["to_km"] + KM_EPSILON)
        along = (km - s["from_km"]).between(F.lit(-END_SLACK_KM), s["length_km"] + END_SLACK_KM)
        return F.when(name.isNull(), on_main).otherwise(s["name"].eqNullSafe(name) & along)

    return F.exists(segs, lambda s: F.coalesce(holds(s), F.lit(False)))


def set_alternates(plans: DataFrame, options: DataFrame, taken: DataFrame, edits: DataFrame, stops: DataFrame, waypoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans after an alternate was taken or dropped (SIM24): ``(plan_id, name)`` of the alternates they take then, and
    ``(plan_id, seq, waypoint_id, km, name)`` of their stops.

    ``edits`` are ``(plan_id, name, take)``, at most one a plan; ``stops`` ``(plan_id, seq, waypoint_id, km, name)`` with
    a null name on the main line; ``waypoints`` ``(trail_id, seq, waypoint_id, km, name)``; the rest as in
    ``planned_segments``. Taking an alternate drops those that overlap it. A stop that this takes off the line goes to the
    place of the same waypoint on the line now walked (the main line's last one, else that on the first alternate), or goes;
    one that was off the line already stays as stored. Of stops at one waypoint, or at one place of a line, the first by km
    stays. Plans without an edit, or whose edit changes nothing, come back as they were.
    """
    asked = edits.join(plans.select("plan_id", "trail_id"), "plan_id").join(options.select("trail_id", "name", F.col("from_km").alias("f"), F.col("to_km").alias("t")), ["trail_id", "name"], "left")
    has = taken.select("plan_id", "name", F.lit(True).alias("has"))
    asked = asked.join(has, ["plan_id", "name"], "left").where(F.when(F.col("take"), F.col("f").isNotNull() & F.col("has").isNull()).otherwise(F.col("has").isNotNull()))
    asked = asked.select("plan_id", F.col("name").alias("asked"), "take", "f", "t")
    rows = taken.join(plans.select("plan_id", "trail_id"), "plan_id").join(options.select("trail_id", "name", "from_km", "to_km"), ["trail_id", "name"], "left").join(asked, "plan_id", "left")
    overlaps = F.coalesce((F.col("from_km") < F.col("t") - KM_EPSILON) & (F.col("f") < F.col("to_km") - KM_EPSILON), F.lit(False))
    goes = F.coalesce(F.when(F.col("take"), overlaps).otherwise(F.col("name") == F.col("asked")), F.lit(False))
    then = materialize(rows.where(~goes).select("plan_id", "name").unionByName(asked.where("take").select("plan_id", F.col("asked").alias("name"))), "then")

    before, after = planned_segments(plans, options, taken), planned_segments(plans, options, then)
    lines = plans.select("plan_id", "trail_id").join(before.withColumnRenamed("segments", "before"), "plan_id").join(after.withColumnRenamed("segments", "after"), "plan_id").join(asked.select("plan_id", "asked"), "plan_id", "left")
    own = stops.join(lines, "plan_id").join(options.select("trail_id", "name", F.lit(True).alias("known")), ["trail_id", "name"], "left")
    stays = F.col("asked").isNull() | (F.col("name").isNotNull() & F.col("known").isNull()) | ~_on_route(F.col("before"), F.col("name"), F.col("km")) | _on_route(F.col("after"), F.col("name"), F.col("km"))
    own = materialize(own.withColumn("stays", stays).select("plan_id", "trail_id", "seq", "waypoint_id", "km", "name", "stays", "after", "asked"), "stops")
    cols = ["plan_id", "seq", "waypoint_id", "km", "name"]

    there = waypoints.select("trail_id", "waypoint_id", F.col("seq").alias("w_seq"), F.col("km").alias("w_km"), F.col("name").alias("w_name"))
    moved = own.where("not stays and waypoint_id is not null").join(there, ["trail_id", "waypoint_id"])
    place = F.coalesce(F.array_position(F.transform("after", lambda s: F.coalesce(s["name"], F.lit(""))), F.col("w_name")), F.lit(0))
    taken_now = F.col("w_name").isNull() & _on_route(F.col("after"), F.col("w_name"), F.col("w_km")) | (F.col("w_name").isNotNull() & (place > 0))
    best = F.min_by(F.struct("w_km", "w_name"), F.struct(place, F.when(F.col("w_name").isNull(), -F.col("w_seq")).otherwise(F.col("w_seq"))))
    moved = moved.where(taken_now).groupBy("plan_id", "seq", "waypoint_id").agg(best.alias("to")).select("plan_id", "seq", "waypoint_id", F.col("to.w_km").alias("km"), F.col("to.w_name").alias("name"))

    changed = own.where("stays and asked is not null").select(*cols).unionByName(moved)
    item = F.struct("km", F.coalesce("name", F.lit("")).alias("line"), "seq", "waypoint_id")
    per = changed.groupBy("plan_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    again = lambda kept, x: F.exists(kept, lambda k: (k["waypoint_id"] == x["waypoint_id"]) | ((k["line"] == x["line"]) & (F.abs(k["km"] - x["km"]) < KM_EPSILON)))
    kind = "array<struct<km:double,line:string,seq:bigint,waypoint_id:string>>"
    first = F.aggregate("s", F.array().cast(kind), lambda kept, x: F.when(F.coalesce(again(kept, x), F.lit(False)), kept).otherwise(F.concat(kept, F.array(x))))
    out = per.select("plan_id", F.inline(first)).select("plan_id", "seq", "waypoint_id", "km", F.nullif("line", F.lit("")).alias("name"))
    return then, out.unionByName(own.where("asked is null").select(*cols))


def rows_at_junctions(rows: DataFrame, track: DataFrame, beside: int = 20, start_km: float = 0.0) -> DataFrame:
    """Rows of a datasheet put at the km of their junction on the line (JON46).

    ``rows`` are ``(trail_id, seq, lat, lon, applied, track_idx, km, leg_km, elevation, ascent, descent, total_ascent,
    total_descent)`` in the order of ``seq``, from 0 on. A row that is ``applied`` meets the ``beside`` segments on either
    side of its vertex, by equal segment numbers, never across a break, and takes the nearest; of segments within half a metre
    of each other, the one nearer its vertex. The nearer end becomes its vertex, with the height and climb there. Rows are put
    back in km order, and only the legs into and out of moved or reordered rows are measured anew; all others come back
    as they were. ``seq`` is the old place, ``place`` the new one.
    """
    steps = segments(track).withColumnRenamed("idx", "k").select("trail_id", "k", "lat1", "lon1", "lat2", "lon2", "d1", "d2")
    asked = rows.where("applied").select("trail_id", "seq", "lat", "lon", "track_idx", F.explode(F.sequence(F.col("track_idx") - beside, F.col("track_idx") + beside - 1)).alias("k"))
    ends = [F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")]
    reach = F.least(F.abs(F.col("k") - F.col("track_idx")), F.abs(F.col("k") + 1 - F.col("track_idx")))
    met = asked.join(steps, ["trail_id", "k"]).select("trail_id", "seq", F.struct("k", segment_distance_m(*ends).alias("m"), reach.alias("reach"), (F.col("d1") + (F.col("d2") - F.col("d1")) * segment_fraction(*ends)).alias("km"), "d1", "d2").alias("s"))
    per = met.groupBy("trail_id", "seq").agg(F.array_sort(F.collect_list("s")).alias("s"))  # 2 * beside of them at most
    better = lambda best, x: (x["m"] < best["m"] - 0.5) | ((x["m"] <= best["m"] + 0.5) & (x["reach"] < best["reach"]))
    per = per.select("trail_id", "seq", F.aggregate(F.slice("s", 2, 2 * beside), F.col("s")[0], lambda best, x: F.when(better(best, x), x).otherwise(best)).alias("b"))
    vertex = F.col("b.k") + F.when(F.col("b.km") - F.col("b.d1") <= F.col("b.d2") - F.col("b.km"), 0).otherwise(1)
    per = per.select("trail_id", "seq", js_round("b.km", 2).alias("new_km"), vertex.alias("new_idx"))
    heights = track.select("trail_id", F.col("idx").alias("new_idx"), js_round("ele").alias("new_ele"), js_round(js_round("cum_ascent", 6)).alias("up"), js_round(js_round("cum_descent", 6)).alias("down"))
    out = rows.join(per, ["trail_id", "seq"], "left").join(heights, ["trail_id", "new_idx"], "left")
    moved = F.coalesce((F.col("new_km") != F.col("km")) | (F.col("new_idx") != F.col("track_idx")), F.lit(False))
    other = F.coalesce(F.col("new_idx") != F.col("track_idx"), F.lit(False))
    take = lambda when, new, old: F.when(when, F.col(new)).otherwise(F.col(old))
    out = out.withColumns({"_m": moved, "_v": moved & other}).withColumns(
        {"km": take(F.col("_m"), "new_km", "km"), "elevation": take(F.col("_v"), "new_ele", "elevation"), "total_ascent": take(F.col("_v"), "up", "total_ascent"), "total_descent": take(F.col("_v"), "down", "total_descent"), "track_idx": take(F.col("_v"), "new_idx", "track_idx")}
    )
    w = Window.partitionBy("trail_id").orderBy("km", "track_idx", "seq")
    before = lambda c: F.lag(c).over(w)
    away = ~before("seq").eqNullSafe(F.when(F.col("seq") > 0, F.col("seq") - 1))
    leg = away | F.col("_m") | F.coalesce(before("_m"), F.lit(False))
    climb = away | F.col("_v") | F.coalesce(before("_v"), F.lit(False))
    return out.select(
        "trail_id", F.row_number().over(w).alias("place"), "seq", "track_idx", "km", "elevation", "total_ascent", "total_descent",
        F.when(leg, js_round(F.col("km") - F.coalesce(before("km"), F.lit(start_km)), 2)).otherwise(F.col("leg_km")).alias("leg_km"),
        F.when(climb, F.col("total_ascent") - F.coalesce(before("total_ascent"), F.lit(0.0))).otherwise(F.col("ascent")).alias("ascent"),
        F.when(climb, F.col("total_descent") - F.coalesce(before("total_descent"), F.lit(0.0))).otherwise(F.col("descent")).alias("descent"), F.col("_m").alias("moved"),
    )
