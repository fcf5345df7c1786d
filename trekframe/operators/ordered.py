"""Gaps, islands, as-of lookups and intervals along a kilometre axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.storage import materialize

EPS = 1e-9


def consecutive_gaps(stops: DataFrame, ends: DataFrame, key: str = "trail_id") -> DataFrame:
    """``(key, from_km, to_km, gap_km)`` between neighbouring stops, start and end included; repeats and empty gaps go (WIN08).

    ``stops`` are ``(key, km)``; ``ends`` has one row ``(key, start_km, end_km)`` per trail.
    """
    inner = stops.join(ends, key).where("km > start_km and km < end_km").select(key, "km")
    marks = inner.unionByName(ends.select(key, F.explode(F.array("start_km", "end_km")).alias("km"))).distinct()
    w = Window.partitionBy(key).orderBy("km")
    rows = marks.select(key, F.col("km").alias("from_km"), F.lead("km").over(w).alias("to_km")).where("to_km is not null")
    return rows.withColumn("gap_km", F.col("to_km") - F.col("from_km")).where("gap_km > 0")


def water_gaps(sources: DataFrame, ends: DataFrame, dry_km: float, key: str = "trail_id") -> DataFrame:
    """Gaps between water sources, the walk off the trail and back counted; ``dry`` from the threshold on (WIN09).

    Of sources at one place, the one nearest the trail counts.
    """
    near = sources.groupBy(key, "km").agg(F.min(F.coalesce("walk_km", F.lit(0.0))).alias("walk_km"))
    inner = near.join(ends, key).where("km >= start_km and km <= end_km").select(key, "km", "walk_km")
    sentinels = ends.select(key, F.explode(F.array("start_km", "end_km")).alias("km")).withColumn("walk_km", F.lit(0.0))
    marks = inner.unionByName(sentinels.join(inner.select(key, "km"), [key, "km"], "left_anti"))
    w = Window.partitionBy(key).orderBy("km")
    rows = marks.select(key, F.col("km").alias("from_km"), F.lead("km").over(w).alias("to_km"), "walk_km", F.lead("walk_km").over(w).alias("next_walk"))
    rows = rows.where("to_km > from_km").withColumn("gap_km", F.col("to_km") - F.col("from_km") + F.col("walk_km") + F.col("next_walk"))
    return rows.select(key, "from_km", "to_km", "gap_km", (F.col("gap_km") >= dry_km).alias("dry"))


def gap_summary(gaps: DataFrame, key: str = "trail_id") -> DataFrame:
    """Longest gap and number of dry ones (AGG23, AGG24)."""
    return gaps.groupBy(key).agg(F.max("gap_km").alias("longest_km"), F.count_if("dry").alias("n_dry"), F.count("*").alias("n_gaps"))


def chain_groups(rows: DataFrame, gap: float, key: str = "trail_id", at: str = "km", tie: str = "seq") -> DataFrame:
    """Adds ``grp``: a new group wherever the step from the row before is over ``gap`` (WIN12)."""
    w = Window.partitionBy(key).orderBy(at, tie)
    fresh = F.coalesce((F.col(at) - F.lag(at).over(w) > gap + EPS).cast("int"), F.lit(0))
    return rows.withColumn("_f", fresh).withColumn("grp", F.sum("_f").over(w).cast("long")).drop("_f")


def dense_stretches(places: DataFrame, high: float, low: float, least: int, merge: int, half: int = 2, key: str = "trail_id") -> DataFrame:
    """``(key, from_bin, to_bin, n)``: stretches that are dense in places (WIN13).

    Unit bins, each with the mean of those within ``half``; islands of bins of at least ``low`` that hold one of
    ``high``, joined over gaps of up to ``merge`` bins, of at least ``least`` places. A stretch begins and ends with a bin that holds
    places.
    """
    bins = places.select(key, F.floor("km").alias("bin")).repartition(key).groupBy(key, "bin").agg(F.count("*").alias("n"))
    bins = materialize(bins.where("bin is not null"), "bins")
    w, least_n = Window.partitionBy(key).orderBy("bin"), low * (2 * half + 1)
    whole = Window.partitionBy(key)
    if low > 0:  # a bin is dense only if those around it hold so many; all others are left out before the grid is drawn
        wide = bins.withColumns({"a": F.min("bin").over(whole), "b": F.max("bin").over(whole), "around": F.sum("n").over(w.rangeBetween(-2 * half, 2 * half))})
        some = wide.where(F.col("around") >= least_n - EPS).select(key, "bin", "n", "a", "b", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_d"))
        grid = some.select(key, (F.col("bin") + F.col("_d")).alias("bin"), F.when(F.col("_d") == 0, F.col("n")).otherwise(0).alias("own"), "n", "a", "b").where("bin between a and b")
        grid = grid.groupBy(key, "bin").agg(F.sum("own").alias("own"), F.sum("n").alias("_sum")).withColumn("density", F.col("_sum") / float(2 * half + 1))
        grid = grid.select(key, "bin", F.col("own").alias("n"), "density").where(F.col("density") >= low)
    else:
        span = bins.groupBy(key).agg(F.min("bin").alias("a"), F.max("bin").alias("b"))
        grid = span.select(key, F.explode(F.sequence("a", "b")).alias("bin")).join(bins, [key, "bin"], "left").fillna({"n": 0})
        grid = grid.withColumn("density", F.sum("n").over(w.rangeBetween(-half, half)) / float(2 * half + 1)).where(F.col("density") >= low)
    grid = grid.withColumn("island", F.col("bin") - F.row_number().over(w))
    islands = grid.groupBy(key, "island").agg(F.min("bin").alias("a"), F.max("bin").alias("b"), F.max("density").alias("peak"), F.sum("n").alias("n")).where(F.col("peak") >= high)
    cells = islands.select(key, F.explode(F.sequence("a", "b")).alias("bin"))
    w2 = Window.partitionBy(key).orderBy("bin")
    fresh = F.coalesce((F.col("bin") - F.lag("bin").over(w2) - 1 > merge).cast("int"), F.lit(0))
    joined = bins.select(key, "bin").join(cells, [key, "bin"], "left_semi").withColumn("_f", fresh).withColumn("g", F.sum("_f").over(w2))
    joined = joined.groupBy(key, "g").agg(F.min("bin").alias("from_bin"), F.max("bin").alias("to_bin"))
    reach = joined.withColumn("bin", F.explode(F.sequence("from_bin", "to_bin")))
    inside = bins.join(reach, [key, "bin"])
    return inside.groupBy(key, "from_bin", "to_bin").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def thin_dense(places: DataFrame, stretches: DataFrame, spacing_km: float = 2.0, key: str = "trail_id") -> DataFrame:
    """Places left when dense stretches are thinned out (WIN14); those outside stay as they are.

    ``places`` are ``(key, place_id, km, category, anchor, branded, off_km, kept)``, ``stretches`` as from
    ``dense_stretches``. Inside a stretch stay: places that are ``kept`` in any case, the first and the last of each category,
    and for each kind of ``anchor`` the best of every ``spacing_km`` from the stretch's start on: one of a brand, then the
    one nearest the trail, then the lower km and id. Places and stretches meet by equal unit bins.
    """
    bins = stretches.select(key, F.explode(F.sequence("from_bin", "to_bin")).alias("_bin"), F.col("from_bin").alias("_from"))
    met = materialize(places.withColumn("_bin", F.floor("km")).join(bins, [key, "_bin"], "left"), "met")
    town = met.where("_from is not null")
    better = [~F.coalesce("branded", F.lit(False)), F.col("off_km"), F.col("km"), F.col("place_id")]
    cat = Window.partitionBy(key, "_from", "category")
    first = F.row_number().over(cat.orderBy("km", *better)) == 1
    last = F.row_number().over(cat.orderBy(F.desc("km"), *[c.desc() for c in better])) == 1
    slot = Window.partitionBy(key, "_from", "anchor", F.floor((F.col("km") - F.col("_from")) / spacing_km)).orderBy(*better)
    best = F.col("anchor").isNotNull() & (F.row_number().over(slot) == 1)
    town = town.withColumn("_k", F.coalesce("kept", F.lit(False)) | first | last | best).where("_k").drop("_k")
    return met.where("_from is null").unionByName(town).drop("_bin", "_from")


def coalesce_intervals(rows: DataFrame, key: str = "trail_id") -> DataFrame:
    """``(key, from_km, to_km, n)``: overlapping intervals merged (WIN15)."""
    w = Window.partitionBy(key).orderBy("from_km", "to_km")
    before = F.max("to_km").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("from_km") > before).cast("int"), F.lit(0))
    grouped = rows.withColumn("_f", fresh).withColumn("_g", F.sum("_f").over(w))
    return grouped.groupBy(key, "_g").agg(F.min("from_km").alias("from_km"), F.max("to_km").alias("to_km"), F.count("*").alias("n")).drop("_g")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: Column, name: str, forward: bool = False, inclusive: bool = True) -> DataFrame:
    """Adds to each left row the right side's ``value`` at the latest place at or before it, or the next after (JON24, JON25).

    One ordered pass over both sides together: no range join, so no row is met more than once. Right rows come before
    left ones of the same place where equality counts.
    """
    side = 0 if inclusive != forward else 2
    both = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None)).unionByName(
        right.select(key, at, value.alias("_v")).withColumn("_side", F.lit(side)), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(at, "_side")
    frame = w.rowsBetween(0, Window.unboundedFollowing) if forward else w.rowsBetween(Window.unboundedPreceding, 0)
    found = F.first("_v", True).over(frame) if forward else F.last("_v", True).over(frame)
    return both.withColumn(name, found).where("_side = 1").drop("_side", "_v")


def nearest_by_km(left: DataFrame, right: DataFrame, key: str = "trail_id", at: str = "km") -> DataFrame:
    """Adds ``near_km``, the right side's nearest place; the earlier one in a tie (JON26)."""
    back = asof(left, right, key, at, F.col(at), "_b")
    both = asof(back, right, key, at, F.col(at), "_a", forward=True)
    return both.withColumn("near_km", F.when(F.col("_b").isNull() | (F.col("_a") - F.col(at) < F.col(at) - F.col("_b")), F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b")


def _met_in_cells(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """Points with the ``from_km``, ``to_km`` and ``number`` of all intervals that may hold them, null if there is none.

    Intervals are dealt to cells of about their own length, so three at most, however long they are; a point looks into its
    cell of each width that its trail's intervals have.
    """
    level = F.floor(F.log2(F.greatest(F.lit(1.0), F.col("to_km") - F.col("from_km")))).cast("int")
    sized = intervals.select(key, "from_km", "to_km", "number").withColumn("_level", level)
    at = lambda km, by: F.floor(F.col(km) / F.pow(F.lit(2.0), F.col(by)))
    cells = sized.where("from_km <= to_km").withColumn("_cell", F.explode(F.sequence(at("from_km", "_level"), at("to_km", "_level"))))
    looks = points.join(sized.select(key, "_level").distinct().hint("merge"), key, "left").withColumn("_cell", at("km", "_level"))
    return looks.join(cells.hint("merge"), [key, "_level", "_cell"], "left")


def first_containing(points: DataFrame, intervals: DataFrame, key: str = "trail_id") -> DataFrame:
    """Adds ``number``: the first interval ``from_km <= km <= to_km`` that holds the point, 0 if none (JON27).

    Intervals and points meet in cells, so that the join is on equal cells and not on a range alone.
    """
    hit = F.when(F.col("km").between(F.col("from_km"), F.col("to_km")), F.col("number"))
    return _met_in_cells(points, intervals, key).groupBy(*points.columns).agg(F.coalesce(F.min(hit), F.lit(0)).alias("number"))


def map_piecewise(points: DataFrame, pieces: DataFrame, key: str = "trail_id") -> DataFrame:
    """Adds ``route_km``: kilometres carried over by the first piece ``[from_km, to_km]`` that holds them, else null (JON28-30)."""
    numbered = pieces.select(key, "from_km", "to_km", F.struct("rank", "route_start", "from_km").alias("number"))
    hit = F.when(F.col("km").between(F.col("from_km"), F.col("to_km")), F.col("number"))
    out = _met_in_cells(points, numbered, key).groupBy(*points.columns).agg(F.min(hit).alias("p"))
    return out.withColumn("route_km", F.col("p.route_start") + F.col("km") - F.col("p.from_km")).drop("p")


def overlapping_pairs(rows: DataFrame, key: str = "trail_id") -> DataFrame:
    """``(key, a, b)`` of intervals that overlap by more than their ends touch (JON31)."""
    cells = rows.withColumn("_cell", F.explode(F.sequence(F.floor("from_km"), F.floor("to_km"))))
    a = cells.select(key, "_cell", F.col("id").alias("a"), F.col("from_km").alias("fa"), F.col("to_km").alias("ta"))
    b = cells.select(key, "_cell", F.col("id").alias("b"), F.col("from_km").alias("fb"), F.col("to_km").alias("tb"))
    return a.join(b, [key, "_cell"]).where((F.col("a") < F.col("b")) & (F.col("fa") < F.col("tb") - EPS) & (F.col("fb") < F.col("ta") - EPS)).select(key, "a", "b").distinct()


def day_split(stops: DataFrame, ends: DataFrame, key: str = "trail_id") -> DataFrame:
    """``(key, day, from_km, to_km)``: the trail cut at its stops (WIN10)."""
    gaps = consecutive_gaps(stops, ends, key)
    day = F.row_number().over(Window.partitionBy(key).orderBy("from_km"))
    return gaps.select(key, day.alias("day"), "from_km", "to_km")


def rest_day_dates(days: DataFrame, key: str = "trail_id") -> DataFrame:
    """Adds ``date``: the start date moved by the days walked and the nights rested before (WIN11)."""
    before = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    rested = F.coalesce(F.sum(F.greatest(F.col("nights") - 1, F.lit(0))).over(before), F.lit(0))
    return days.withColumn("date", F.date_add("start_date", (F.col("day") - 1 + rested).cast("int")))


def relog_after_drop(rows: DataFrame, key: str = "trail_id") -> DataFrame:
    """Surviving rows with the legs of dropped ones before them added to their own (WIN19)."""
    w = Window.partitionBy(key).orderBy("seq")
    kept = rows.where("not dropped")
    return kept.withColumn("leg", F.col("total") - F.coalesce(F.lag("total").over(w), F.lit(0.0)))


def rows_ahead(rows: DataFrame, current_km: float, key: str = "trail_id") -> DataFrame:
    """Rows from the first at or ahead of the current place on, in their own order, and how many went (FLT22)."""
    first = F.min(F.when(F.col("km") >= current_km - 0.05, F.col("seq"))).over(Window.partitionBy(key))
    flagged = rows.withColumn("_first", first)
    gone = F.count_if(F.col("_first").isNull() | (F.col("seq") < F.col("_first"))).over(Window.partitionBy(key))
    return flagged.withColumn("n_gone", gone).where("seq >= _first").drop("_first")


def neighbours_of_slice(rows: DataFrame, lo: float, hi: float, key: str = "trail_id") -> DataFrame:
    """Rows within the range and one neighbour on either side (FLT17)."""
    w = Window.partitionBy(key).orderBy("km", "seq")
    flagged = rows.withColumn("_n", F.lead("km").over(w)).withColumn("_p", F.lag("km").over(w))
    return flagged.where(((F.col("_n") >= lo) | F.col("_n").isNull()) & ((F.col("_p") <= hi) | F.col("_p").isNull())).drop("_n", "_p")


def decayed_vote(reports: DataFrame, now_ms: int, decay_days: float = 30.0, window_days: float = 120.0, key: str = "waypoint_id") -> DataFrame:
    """``(key, status, weight, n, latest_ms)``: the status with the most weight, each report's fading with its age; of
    equal weights the one reported last (AGG11, AGG12)."""
    age = (F.lit(now_ms) - F.col("time_ms")) / 86_400_000.0
    aged = reports.where("status is not null and time_ms is not null").withColumn("age", age).where(F.col("age") <= window_days)
    votes = aged.groupBy(key, "status").agg(F.sum(F.exp(-F.greatest(F.lit(0.0), F.col("age")) / decay_days)).alias("weight"), F.count("*").alias("n"), F.max("time_ms").alias("latest_ms"))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), F.desc("latest_ms"), "status")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def monthly_climate(daily: DataFrame, key: str = "location") -> DataFrame:
    """Twelve rows per place: mean extremes of days that have both, rain and rainy days per year (AGG01)."""
    from trekframe.functions.rounding import js_round

    both = F.col("t_max").isNotNull() & F.col("t_min").isNotNull()
    per_month = daily.groupBy(key, F.month("day").alias("month")).agg(
        F.avg(F.when(both, F.col("t_min"))).alias("lo"), F.avg(F.when(both, F.col("t_max"))).alias("hi"), F.sum("rain").alias("rain"),
        F.count_if(F.col("rain") > 1).alias("wet"), F.count_distinct(F.when(both, F.year("day"))).alias("years"),
    )
    grid = daily.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    has = F.col("years") > 0
    zero = lambda c: F.coalesce(F.when(has, js_round(c, 1)), F.lit(0.0))
    out = grid.join(per_month, [key, "month"], "left")
    return out.select(
        key, "month", zero(F.col("lo")).alias("avg_temp_min"), zero(F.col("hi")).alias("avg_temp_max"),
        zero(F.coalesce("rain", F.lit(0.0)) / F.col("years")).alias("avg_precipitation"), zero(F.col("wet") / F.col("years")).alias("avg_rainy_days"),
    )


def alternate_km(points: DataFrame, pieces: DataFrame, slack_km: float = 0.1) -> DataFrame:
    """Adds ``route_km`` to ``(trail_id, name, km)`` on an alternate's own axis: a little beyond its ends counts as the end
    (JON30). ``pieces`` are ``(trail_id, name, from_km, to_km, route_start)``, one an alternate taken."""
    met = points.join(pieces, ["trail_id", "name"], "left")
    inside = F.col("km").between(F.col("from_km") - slack_km, F.col("to_km") + slack_km)
    at = F.least("to_km", F.greatest("from_km", "km")) - F.col("from_km")
    return met.withColumn("route_km", F.when(inside, F.col("route_start") + at)).drop("from_km", "to_km", "route_start")


def count_in_window(events: DataFrame, window_ms: int, key: str = "key", at: str = "ms") -> DataFrame:
    """Adds ``n``: the key's events up to this one within the window before it (AGG31)."""
    return events.withColumn("n", F.count("*").over(Window.partitionBy(key).orderBy(at).rangeBetween(-window_ms + 1, 0)))
