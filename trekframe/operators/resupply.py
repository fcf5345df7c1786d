"""Where supplies can be had: options in groups, a traveller's choice of them, and the carries between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.geo import haversine_m
from trekframe.functions.hiking import option_access
from trekframe.functions.pois import is_access, is_resupply
from trekframe.functions.rounding import js_round

_EPS = 1e-9


def resupply_points(waypoints: DataFrame) -> DataFrame:
    """``(trail_id, km, ord, ...)`` of the waypoints with supplies, with names and kilometres filled in and their ``place``
    in walking order (FLT21)."""
    rows = waypoints.where(is_resupply(F.col("type"))).withColumns({"name": F.coalesce("name", F.lit("Resupply")), "km": F.coalesce("km", F.lit(0.0))})
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("trail_id").orderBy("km", "ord")))


def off_trail(km: Column) -> Column:
    return F.when(km > 0, km).otherwise(F.lit(0.0))


def selected_stops(options: DataFrame, choices: DataFrame) -> DataFrame:
    """``(trail_id, group, km, name, option_ids, walk_km, ride_km)``: a stop for each group with a chosen option (JON50).

    ``options`` are ``(trail_id, group, ord, option_id, name, km, off_km, mode, routed)``; ``choices`` are ``(trail_id,
    chosen)``, the chosen ids of the trails for which a choice was made: trails without one have all options chosen, and
    an empty list leaves no stop. The access kept is the longest walk, then the longest ride.
    """
    met = options.join(choices, "trail_id", "left").where(F.col("chosen").isNull() | F.array_contains("chosen", F.col("option_id")))
    off = off_trail(F.col("off_km"))
    walked = option_access(off, F.col("mode"), F.col("routed")) == "walk"
    met = met.withColumns({"walk": F.when(walked, off).otherwise(0.0), "ride": F.when(walked, 0.0).otherwise(off)})
    in_order = F.array_sort(F.collect_list(F.struct("ord", "option_id", "name")))
    per = met.groupBy("trail_id", "group").agg(F.min("km").alias("km"), in_order.alias("o"), F.max(F.when(off > 0, F.struct("walk", "ride"))).alias("access"))
    return per.select(
        "trail_id", "group", "km", F.array_join(F.transform("o", lambda x: x["name"]), " / ").alias("name"), F.transform("o", lambda x: x["option_id"]).alias("option_ids"),
        F.col("access.walk").alias("walk_km"), F.col("access.ride").alias("ride_km"),
    )


def planned_ids(options: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(trail_id, option_id)``: chosen options, and the turn-offs of their groups that lead to them (JON51).

    A turn-off is an access type; it serves any chosen option of its group if it lies on the route, else one that is no
    turn-off and lies as far off. The self join is on the group.
    """
    off = off_trail(F.col("off_km"))
    ticked = options.join(chosen, ["trail_id", "option_id"], "left_semi")
    pick = ticked.select("trail_id", "group", F.col("option_id").alias("pick"), is_access(F.col("type")).alias("pick_access"), off.alias("pick_off"))
    met = options.where(is_access(F.col("type"))).withColumn("off", off).join(pick, ["trail_id", "group"]).where("option_id <> pick")
    serves = (F.col("off") == 0) | (~F.col("pick_access") & (F.abs(F.col("off") - F.col("pick_off")) < _EPS))
    return ticked.select("trail_id", "option_id").unionByName(met.where(serves).select("trail_id", "option_id")).distinct()


def next_stop(positions: DataFrame, stops: DataFrame) -> DataFrame:
    """Adds ``next_km`` and ``next_name`` to positions ``(trail_id, km)``: the first stop ahead (SRT15)."""
    from trekframe.operators.ordered import asof

    value = F.struct(F.col("km").alias("km"), F.col("name").alias("name"))
    return asof(positions, stops, "trail_id", "km", value, "_n", forward=True, inclusive=False).withColumns({"next_km": F.col("_n.km"), "next_name": F.col("_n.name")}).drop("_n")


def plan_summary(legs: DataFrame, start: str = "Trail Start", end: str = "Trail End") -> DataFrame:
    """Headline figures of each trail's legs (AGG22): stops chosen, longest leg and carry, heaviest food, all the walking."""
    stops = F.array(F.when(F.col("from_name") != start, F.col("from_km")), F.when(F.col("to_name") != end, F.col("to_km")))
    per = legs.groupBy("trail_id").agg(
        F.size(F.array_compact(F.array_distinct(F.flatten(F.collect_list(stops))))).cast("long").alias("stops"), F.max("walked_km").alias("longest_km"), F.max("ascent_m").alias("most_climb_m"),
        F.max("days").alias("longest_days"), F.max("food_g").alias("food_g"), F.sum("walked_km").alias("walking"), F.sum("days").alias("walking_days"), F.sum("zero_days").alias("zero_days"),
    )
    return per.select(
        "trail_id", "stops", "longest_km", "most_climb_m", "longest_days", (js_round(F.col("food_g") / 100) / 10).alias("heaviest_kg"), (js_round(F.col("walking") * 10) / 10).alias("walking_km"),
        (F.col("walking_days") + F.col("zero_days")).alias("total_days"), "zero_days",
    )


def climb_along(points: DataFrame, reach: DataFrame) -> DataFrame:
    """``(trip_id, ascent_m, descent_m)`` of a side trip from its junction to ``along_km`` (WIN28).

    ``points`` are ``(trip_id, idx, lat, lon, ele)``, ``reach`` ``(trip_id, along_km, ascent, descent)`` with the whole
    trip's climb, to which the part measured on the points is scaled.
    """
    w = Window.partitionBy("trip_id").orderBy("idx")
    rise = F.coalesce(F.col("ele") - F.lag("ele").over(w), F.lit(0.0))
    step = F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    rows = points.withColumns({"up": F.greatest(rise, F.lit(0.0)), "down": F.greatest(-rise, F.lit(0.0)), "step": step})
    before = F.coalesce(F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("before", before).join(reach, "trip_id")
    walked = (F.col("before") < F.col("along_km") * 1000) | (F.col("before") == 0)
    per = rows.groupBy("trip_id", "ascent", "descent").agg(
        F.sum("up").alias("up_all"), F.sum("down").alias("down_all"), F.sum(F.when(walked, F.col("up")).otherwise(0.0)).alias("up"), F.sum(F.when(walked, F.col("down")).otherwise(0.0)).alias("down")
    )
    scaled = lambda part, whole, total: js_round(F.coalesce(F.when(F.col(whole) > 0, F.col(part) * F.col(total) / F.col(whole)), F.col(part)))
    return per.select("trip_id", scaled("up", "up_all", "ascent").alias("ascent_m"), scaled("down", "down_all", "descent").alias("descent_m"))
