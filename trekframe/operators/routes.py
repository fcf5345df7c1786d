"""Routes with variants: one kilometre scale, pieces put together, junctions, legs and the way back.

Tracks are ``(trail_id, idx, lat, lon, ele, ...)`` as in ``track``; variants add a ``variant`` number within their trail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.geo import haversine_m
from trekframe.functions.rounding import js_round
from trekframe.operators.spatial import nearest_within, snap_to_track
from trekframe.storage import materialize


def concatenate_stretches(points: DataFrame, min_gap_m: float) -> DataFrame:
    """Tracks of a trail in their given order as one (WIN27): ``(trail_id, idx, lat, lon, ele, is_break)``.

    ``points`` are ``(trail_id, track_no, seq, lat, lon, ele)``. Where a track begins ``min_gap_m`` or more from the end of
    the one before, its first row is a break; a narrower join is walked.
    """
    w = Window.partitionBy("trail_id").orderBy("track_no", "seq")
    gap = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    broken = (F.lag("track_no").over(w) != F.col("track_no")) & (gap >= min_gap_m)
    return points.select("trail_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), "lat", "lon", "ele", F.coalesce(broken, F.lit(False)).alias("is_break"))


def route_scale(main: DataFrame, variants: DataFrame, variant_points: DataFrame, reach_m: float = 20_000.0) -> DataFrame:
    """``(trail_id, part, idx, lat, lon, km)``: main track (part 0) and variants on one kilometre axis (JON48).

    ``main`` has ``dist``; ``variants`` are ``(trail_id, variant, start_km)`` with a null start where they are not
    attached; such variants take, point by point, the km of the nearest main point within ``reach_m``.
    """
    w = Window.partitionBy("trail_id", "variant").orderBy("idx")
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) / 1000
    rows = variant_points.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("along", F.sum("_s").over(w)).drop("_s").join(variants, ["trail_id", "variant"])
    out = ["trail_id", F.col("variant").alias("part"), "idx", "lat", "lon"]
    attached = rows.where("start_km is not null").select(*out, (F.col("start_km") + F.col("along")).alias("km"))
    loose = rows.where("start_km is null").withColumn("_id", F.struct("trail_id", "variant", "idx"))
    spots = main.select("trail_id", F.struct("idx", F.col("dist").alias("km")).alias("_at"), "lat", "lon")
    near = nearest_within(loose, spots, "_id", "_at", reach_m, keys=("trail_id",)).select("_id", F.col("_at.km").alias("km"))
    borrowed = loose.join(near, "_id", "left").select(*out, "km")
    return main.select("trail_id", F.lit(0).cast("long").alias("part"), "idx", "lat", "lon", F.col("dist").alias("km")).unionByName(attached).unionByName(borrowed)


def clip_scale(scale: DataFrame, from_km: float, to_km: float) -> DataFrame:
    """The rows of a scale within a range, with ``run``: a part that leaves the range and comes back begins anew (FLT23)."""
    w = Window.partitionBy("trail_id", "part").orderBy("idx")
    inside = F.coalesce(F.col("km").between(from_km, to_km), F.lit(False))
    fresh = inside & ~F.coalesce(F.lag("_in").over(w), F.lit(False))
    return scale.withColumn("_in", inside).withColumn("run", F.sum(fresh.cast("int")).over(w).cast("long")).where("_in").drop("_in")


def km_on_scale(places: DataFrame, scale: DataFrame) -> DataFrame:
    """Adds ``km`` to ``(trail_id, part, idx, t, along_km)``: between the two rows of the scale around a place, never across
    the end of a part; the place's own distance where the scale has none (JON49)."""
    w = Window.partitionBy("trail_id", "part").orderBy("idx")
    rows = scale.select("trail_id", "part", "idx", F.col("km").alias("_a"), F.lead("km").over(w).alias("_b"))
    met = places.join(rows, ["trail_id", "part", "idx"], "left")
    inner = F.when((F.col("t") <= 0) | F.col("_b").isNull(), F.col("_a")).otherwise(F.col("_a") + F.col("t") * (F.col("_b") - F.col("_a")))
    return met.withColumn("km", F.coalesce(inner, "along_km")).drop("_a", "_b")


def segment_stats(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``(trail_id, span, km, ascent, descent)`` between two rows ``from_idx`` and ``to_idx`` of a track, breaks left out
    (AGG20): differences of the running sums ``dist``, ``cum_ascent`` and ``cum_descent``."""
    sums = points.select("trail_id", F.col("idx"), F.struct("dist", "cum_ascent", "cum_descent").alias("s"))
    a = sums.select("trail_id", F.col("idx").alias("from_idx"), F.col("s").alias("a"))
    b = sums.select("trail_id", F.col("idx").alias("to_idx"), F.col("s").alias("b"))
    met = spans.join(a, ["trail_id", "from_idx"]).join(b, ["trail_id", "to_idx"])
    part = lambda name: F.when(F.col("to_idx") > F.col("from_idx"), F.col(f"b.{name}") - F.col(f"a.{name}")).otherwise(0.0)
    return met.select("trail_id", "span", part("dist").alias("km"), part("cum_ascent").alias("ascent"), part("cum_descent").alias("descent"))


def between_km(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``(trail_id, span, gain, loss)`` between the rows nearest two distances (WIN36), rounded to metres."""
    row = F.struct("cum_ascent", "cum_descent")
    met = spans.join(points.select("trail_id", "idx", "dist", "cum_ascent", "cum_descent"), "trail_id")
    at = lambda km: F.min_by(row, F.struct(F.abs(F.col("dist") - F.col(km)), F.col("idx")))
    got = met.groupBy("trail_id", "span").agg(at("from_km").alias("a"), at("to_km").alias("b"))
    diff = lambda name: js_round(js_round(F.col(f"b.{name}") - F.col(f"a.{name}"), 6))
    return got.select("trail_id", "span", diff("cum_ascent").alias("gain"), diff("cum_descent").alias("loss"))


def variant_junctions(variants: DataFrame, main: DataFrame, most_m: float = 500.0) -> DataFrame:
    """``(trail_id, variant, start_idx, start_km, end_idx, end_km)``: where variants leave and rejoin the main track (JON34).

    ``variants`` are ``(trail_id, variant, kind, start_lat, start_lon, end_lat, end_lon)``. Each end meets the nearest main
    point within ``most_m``; a side trip that ends where it began (fewer than 10 rows apart) has no end of its own, and
    junctions are given in the order of the track.
    """
    spots = main.select("trail_id", F.struct("idx", F.col("dist").alias("km")).alias("_at"), "lat", "lon")

    def end_of(name):
        ends = variants.select(F.struct("trail_id", "variant").alias("_v"), F.col(f"{name}_lat").alias("lat"), F.col(f"{name}_lon").alias("lon"), "trail_id")
        near = nearest_within(ends, spots, "_v", "_at", most_m, keys=("trail_id",))
        return near.select(F.col("_v.trail_id").alias("trail_id"), F.col("_v.variant").alias("variant"), F.struct(F.col("_at.idx").alias("idx"), js_round(F.col("_at.km"), 2).alias("km")).alias(name))

    met = variants.select("trail_id", "variant", "kind").join(end_of("start"), ["trail_id", "variant"], "left").join(end_of("end"), ["trail_id", "variant"], "left")
    same = (F.col("kind") != "alternate") & F.coalesce(F.abs(F.col("end.idx") - F.col("start.idx")) < 10, F.lit(False))
    met = met.withColumn("end", F.when(~same, F.col("end")))
    turned = F.coalesce(F.col("end.idx") < F.col("start.idx"), F.lit(False))
    first, last = F.when(turned, F.col("end")).otherwise(F.col("start")), F.when(turned, F.col("start")).otherwise(F.col("end"))
    met = met.select("trail_id", "variant", first.alias("s"), last.alias("e"))
    return met.select("trail_id", "variant", F.col("s.idx").alias("start_idx"), F.col("s.km").alias("start_km"), F.col("e.idx").alias("end_idx"), F.col("e.km").alias("end_km"))


def attach_to_parents(variants: DataFrame, links: DataFrame, max_rounds: int = 30) -> DataFrame:
    """``(variant, parent, depth)``: variants that reach the main route, and then those that reach an attached one, round by
    round until no more do (JON35).

    ``variants`` are ``(variant, attached)``, ``links`` ``(variant, other, metres)`` of ends near other variants. Each takes
    the nearest attached one of the first round that offers any, the smaller number in a tie. A round is one join and one
    aggregation, written down.
    """
    done = materialize(variants.where("attached").select("variant", F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")), "attached")
    rest = materialize(links.join(done.select("variant"), "variant", "left_anti"), "loose")
    for depth in range(1, max_rounds + 1):
        offers = rest.join(done.select(F.col("variant").alias("other")), "other")
        new = materialize(offers.groupBy("variant").agg(F.min(F.struct("metres", "other")).alias("b")).select("variant", F.col("b.other").alias("parent"), F.lit(depth).alias("depth")), "attached")
        if new.isEmpty():
            return done
        rest = materialize(rest.join(new.select("variant"), "variant", "left_anti"), "loose")
        done = done.unionByName(new)
    raise RuntimeError("variants did not settle; raise max_rounds")


def mirrored(km: Column, total: Column) -> Column:
    return js_round(total - km, 2)


def reverse_variants(variants: DataFrame) -> DataFrame:
    """Variants of a trail walked the other way (WIN34): ``(trail_id, variant, total_km, start_km, end_km, kind)`` with both
    junctions mirrored and swapped; a side trip and a variant of one junction keep reading from it, unattached ones stay."""
    total, both = F.col("total_km"), F.col("start_km").isNotNull() & F.col("end_km").isNotNull() & (F.col("kind") == "alternate")
    start = F.when(both, mirrored(F.col("end_km"), total)).otherwise(mirrored(F.col("start_km"), total))
    end = F.when(both, mirrored(F.col("start_km"), total)).otherwise(mirrored(F.col("end_km"), total))
    return variants.withColumns({"start_km": start, "end_km": end})


def reverse_waypoints(waypoints: DataFrame) -> DataFrame:
    """Datasheet rows walked the other way (WIN20): ``(trail_id, seq, total_km, km, ascent, descent, first_ascent,
    first_descent)`` gives each row's leg from the row before it in the new order, with the climb of the leg once walked
    into that row, swapped, and the climb from the new start, ``first_*``, for the first one."""
    w = Window.partitionBy("trail_id").orderBy(F.desc("seq"))
    km = F.col("total_km") - F.col("km")
    rows = waypoints.withColumn("new_km", km)
    up = F.coalesce(F.lag("descent").over(w), F.col("first_ascent"))
    down = F.coalesce(F.lag("ascent").over(w), F.col("first_descent"))
    rows = rows.withColumns({"_up": up, "_down": down, "leg": F.abs(F.col("new_km") - F.coalesce(F.lag("new_km").over(w), F.lit(0.0)))})
    return rows.select(
        "trail_id", F.row_number().over(w).alias("place"), "seq", F.col("new_km").alias("km"), "leg", F.col("_up").alias("ascent"), F.col("_down").alias("descent"),
        F.sum("_up").over(w).alias("total_ascent"), F.sum("_down").over(w).alias("total_descent"),
    )


def reverse_breaks(breaks: DataFrame) -> DataFrame:
    """Breaks of a track walked the other way (WIN33): ``(trail_id, idx, km, n, total_km, from_track, to_track)``."""
    return breaks.select(
        "trail_id", (F.col("n") - F.col("idx")).alias("idx"), (F.col("total_km") - F.col("km")).alias("km"), F.col("to_track").alias("from_track"), F.col("from_track").alias("to_track")
    )


def extract_spur(points: DataFrame, spurs: DataFrame) -> DataFrame:
    """``(trail_id, idx, line)`` with line 'main' or 'spur': a range of a track cut out as a side trip (SIM09).

    ``spurs`` are ``(trail_id, from_km, to_km)``. The junction row is on both lines: where the spur begins, or, for a spur
    at the head of the track, where it ends.
    """
    at = lambda km: F.min_by("idx", F.struct(F.abs(F.col("dist") - F.col(km)), F.col("idx")))
    met = points.select("trail_id", "idx", "dist").join(spurs, "trail_id")
    cuts = met.groupBy("trail_id").agg(at("from_km").alias("a"), at("to_km").alias("b")).where("b > a")
    rows = points.select("trail_id", "idx").join(cuts, "trail_id")
    main = F.when(F.col("a") == 0, F.col("idx") >= F.col("b")).otherwise((F.col("idx") <= F.col("a")) | (F.col("idx") > F.col("b")))
    spur = F.col("idx").between(F.col("a"), F.col("b"))
    lines = F.array_compact(F.array(F.when(main, F.lit("main")), F.when(spur, F.lit("spur"))))
    return rows.select("trail_id", "idx", F.explode(lines).alias("line"))


def route_legs(taps: DataFrame, points: DataFrame) -> DataFrame:
    """Legs between the taps of a drawn route (SIM16): ``(route_id, seq, straight, km, ascent, descent, from_km, to_km)``.

    ``taps`` are ``(route_id, seq, trail_id, lat, lon, km)`` with a null km off the track. Between two taps on the track the
    way follows it, and climb and descent swap where it is walked backwards; any other leg is a straight line.
    """
    w = Window.partitionBy("route_id").orderBy("seq")
    legs = taps.select("route_id", "seq", "trail_id", "lat", "lon", F.col("km").alias("b"), F.lag("km").over(w).alias("a"), F.lag("lat").over(w).alias("lat1"), F.lag("lon").over(w).alias("lon1"))
    legs = legs.where("lat1 is not null").withColumn("straight", F.col("a").isNull() | F.col("b").isNull())
    spans = legs.where("not straight").select("trail_id", F.struct("route_id", "seq").alias("span"), F.least("a", "b").alias("from_km"), F.greatest("a", "b").alias("to_km"))
    climbs = between_km(points, spans).select(F.col("span.route_id").alias("route_id"), F.col("span.seq").alias("seq"), "gain", "loss")
    met = legs.join(climbs, ["route_id", "seq"], "left")
    ahead = F.col("b") >= F.col("a")
    return met.select(
        "route_id", "seq", "straight", F.when(F.col("straight"), haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")) / 1000).otherwise(F.abs(F.col("b") - F.col("a"))).alias("km"),
        F.when(F.col("straight"), 0.0).when(ahead, F.col("gain")).otherwise(F.col("loss")).alias("ascent"), F.when(F.col("straight"), 0.0).when(ahead, F.col("loss")).otherwise(F.col("gain")).alias("descent"),
        F.when(~F.col("straight"), F.least("a", "b")).alias("from_km"), F.when(~F.col("straight"), F.greatest("a", "b")).alias("to_km"),
    )


def highlight_ranges(taps: DataFrame) -> DataFrame:
    """``(route_id, seq, from_km, to_km)`` of the legs whose both ends lie on the track (WIN39)."""
    w = Window.partitionBy("route_id").orderBy("seq")
    legs = taps.select("route_id", "seq", F.col("km").alias("b"), F.lag("km").over(w).alias("a")).where("a is not null and b is not null")
    return legs.select("route_id", "seq", F.least("a", "b").alias("from_km"), F.greatest("a", "b").alias("to_km"))


def splice_route(main: DataFrame, variant_points: DataFrame, taken: DataFrame) -> DataFrame:
    """The line that a plan walks (WIN29): ``(trail_id, idx, source, lat, lon, dist, cum_ascent, cum_descent)``.

    ``taken`` are ``(trail_id, variant, start_idx, end_idx)`` of alternates that do not overlap; their points stand in place
    of the main rows between the two junctions, and distance and climb are summed anew along the line.
    """
    from trekframe.operators.track import cumulative_climb, cumulative_km

    inside = taken.select("trail_id", F.explode(F.sequence(F.col("start_idx") + 1, F.col("end_idx") - 1)).alias("idx")).where("idx >= 0")
    kept = main.join(inside, ["trail_id", "idx"], "left_anti").select("trail_id", F.col("idx").alias("at"), F.lit(0).alias("source"), F.lit(0).cast("long").alias("k"), "lat", "lon", "ele", "is_break")
    lines = variant_points.join(taken, ["trail_id", "variant"]).select("trail_id", F.col("start_idx").alias("at"), F.lit(1).alias("source"), (F.col("idx") + 1).alias("k"), "lat", "lon", "ele", F.lit(False).alias("is_break"))
    order = Window.partitionBy("trail_id").orderBy("at", "source", "k")
    rows = kept.unionByName(lines).withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return cumulative_climb(cumulative_km(rows)).select("trail_id", "idx", "source", "lat", "lon", "dist", "cum_ascent", "cum_descent")


def alternate_markers(alternates: DataFrame) -> DataFrame:
    """``(trail_id, name, kind, km, place)``: cards where alternates branch and rejoin, in walking order (SIM23).

    ``alternates`` are ``(trail_id, name, rank, taken, from_km, to_km)`` in route kilometres, null where the route does not
    pass. One taken has both cards, another only the first; of one km a rejoin comes first, then the alternates' order.
    """
    lo, hi = F.least("from_km", "to_km"), F.greatest("from_km", "to_km")
    cards = F.when(F.col("taken"), F.array(F.struct(F.lit("branch").alias("kind"), lo.alias("km")), F.struct(F.lit("rejoin").alias("kind"), hi.alias("km"))))
    cards = cards.otherwise(F.array(F.struct(F.lit("branch").alias("kind"), lo.alias("km"))))
    rows = alternates.where("from_km is not null and to_km is not null").select("trail_id", "name", "rank", F.inline(cards))
    w = Window.partitionBy("trail_id").orderBy("km", F.desc("kind"), "rank")
    return rows.select("trail_id", "name", "kind", "km", F.row_number().over(w).alias("place"))


def walk_network(ways: DataFrame, densify_m: float = 25.0) -> DataFrame:
    """Edges ``(a, b, metres)`` of a walking network (SIM10): ways ``(way_id, seq, lat, lon)`` joined where they share a
    vertex (to seven decimals), long steps cut into pieces of at most ``densify_m``. Nodes are strings of their place."""
    w = Window.partitionBy("way_id").orderBy("seq")
    steps = ways.select("way_id", "seq", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 is not null")
    key = lambda lat, lon: F.format_string("%.7f,%.7f", lat, lon)
    steps = steps.where(key(F.col("lat1"), F.col("lon1")) != key(F.col("lat2"), F.col("lon2")))
    length = haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    steps = steps.withColumn("length", length).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("length") / densify_m)).cast("int"))
    cut = steps.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))

    def node(k):
        first, last = key(F.col("lat1"), F.col("lon1")), key(F.col("lat2"), F.col("lon2"))
        inner = F.concat_ws(":", "way_id", "seq", k)  # a piece's end belongs to its step alone
        return F.when(k == 0, first).when(k == F.col("n"), last).otherwise(inner)

    return cut.select(node(F.col("k")).alias("a"), node(F.col("k") + 1).alias("b"), (F.col("length") / F.col("n")).alias("metres"))


def straight_line_access(rows: DataFrame, points: DataFrame, radius_m: float) -> DataFrame:
    """Rows ``(place_id, lat, lon, off_km)`` with the straight line to the track, to the centimetre, where no distance is known
    (JON47)."""
    snapped = snap_to_track(rows.where("off_km is null"), points, radius_m).select("place_id", (js_round("metres", 2) / 1000).alias("_d"))
    return rows.join(snapped, "place_id", "left").withColumn("off_km", F.coalesce("off_km", "_d")).drop("_d")
