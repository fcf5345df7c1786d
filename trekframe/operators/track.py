"""Measuring and reshaping ordered tracks: rows ``(trail_id, idx, lat, lon, ele, is_break)``, one partition per trail.

A row with ``is_break`` starts a new stretch: nothing is measured between it and the row before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.geo import haversine_m
from trekframe.functions.rounding import js_round


def _along(key: str = "trail_id", order: str = "idx"):
    return Window.partitionBy(key).orderBy(order)


def _broken():
    return F.coalesce(F.col("is_break"), F.lit(False))


def cumulative_km(points: DataFrame) -> DataFrame:
    """Adds ``dist``: kilometres from the start (WIN01)."""
    w = _along()
    step = F.when(_broken() | F.lag("lat").over(w).isNull(), 0.0).otherwise(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")))
    return points.withColumn("_step", step).withColumn("dist", F.sum("_step").over(w) / 1000.0).drop("_step")


def cumulative_climb(points: DataFrame) -> DataFrame:
    """Adds ``cum_ascent`` and ``cum_descent`` (WIN02)."""
    w = _along()
    rise = F.when(_broken(), 0.0).otherwise(F.coalesce(F.col("ele") - F.lag("ele").over(w), F.lit(0.0)))
    out = points.withColumn("_rise", rise)
    up, down = F.sum(F.greatest("_rise", F.lit(0.0))).over(w), F.sum(F.greatest(-F.col("_rise"), F.lit(0.0))).over(w)
    return out.withColumn("cum_ascent", up).withColumn("cum_descent", down).drop("_rise")


def hysteresis_climb(points: DataFrame, threshold: float = 3.0) -> DataFrame:
    """``(trail_id, gain, loss)`` with noise below the threshold left out (WIN03, AGG32).

    The height last counted moves only by steps of at least ``threshold``; a fold over the trail's ordered array.
    """
    series = points.groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct("idx", "ele", _broken().alias("brk")))).alias("s"))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.lit(0.0).alias("gain"), F.lit(0.0).alias("loss"))

    def step(acc, p):
        diff = p["ele"] - acc["at"]
        fresh = acc["at"].isNull() | p["brk"]
        moves = ~fresh & (F.abs(diff) >= threshold)
        return F.struct(
            F.when(fresh | moves, p["ele"]).otherwise(acc["at"]).alias("at"),
            (acc["gain"] + F.when(moves & (diff > 0), diff).otherwise(0.0)).alias("gain"),
            (acc["loss"] + F.when(moves & (diff < 0), -diff).otherwise(0.0)).alias("loss"),
        )

    return series.select("trail_id", F.aggregate("s", start, step).alias("r")).select("trail_id", "r.gain", "r.loss")


def smooth_elevation(points: DataFrame, window: int = 7) -> DataFrame:
    """Adds ``smooth``: a centred mean, shorter at the ends; too short a trail stays as it is (WIN04)."""
    half = window // 2
    near = _along().rowsBetween(-half, half)
    whole = Window.partitionBy("trail_id")
    return points.withColumn("smooth", F.when(F.count("*").over(whole) < window, F.col("ele")).otherwise(F.avg("ele").over(near)))


def remove_spikes(points: DataFrame, threshold: float) -> DataFrame:
    """Adds ``clean``: local extremes beyond the threshold on both sides are drawn between their sound neighbours (WIN05)."""
    w = _along()
    a, b = F.col("ele") - F.lag("ele").over(w), F.col("ele") - F.lead("ele").over(w)
    spike = F.coalesce(((a > threshold) & (b > threshold)) | ((a < -threshold) & (b < -threshold)), F.lit(False))
    out = points.withColumn("_spike", spike).withColumn("_ok", F.when(~F.col("_spike"), F.struct("idx", "ele")))
    back = w.rowsBetween(Window.unboundedPreceding, -1)
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    out = out.withColumn("_p", F.last("_ok", True).over(back)).withColumn("_n", F.first("_ok", True).over(ahead))
    drawn = F.col("_p.ele") + (F.col("_n.ele") - F.col("_p.ele")) * (F.col("idx") - F.col("_p.idx")) / (F.col("_n.idx") - F.col("_p.idx"))
    return out.withColumn("clean", F.when(F.col("_spike"), F.coalesce(drawn, "_p.ele", "_n.ele")).otherwise(F.col("ele"))).drop("_spike", "_ok", "_p", "_n")


def split_at_breaks(points: DataFrame) -> DataFrame:
    """Adds ``stretch``: the number of the run between breaks (WIN24, WIN38)."""
    return points.withColumn("stretch", F.sum(_broken().cast("int")).over(_along()).cast("long"))


def break_crossings(points: DataFrame) -> DataFrame:
    """``(trail_id, idx, gap_km)`` of each break (WIN37)."""
    w = _along()
    gap = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) / 1000.0
    return points.withColumn("gap_km", gap).where(_broken() & F.col("gap_km").isNotNull()).select("trail_id", "idx", "gap_km")


def gap_check(points: DataFrame, most_km: float = 2.0) -> DataFrame:
    """``(trail_id, n_gaps, first_idx, longest_km)`` of steps that are too long (AGG29)."""
    w = _along()
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) / 1000.0
    wide = F.col("step") > most_km
    return points.withColumn("step", step).groupBy("trail_id").agg(
        F.count_if(wide).alias("n_gaps"), F.min(F.when(wide, F.col("idx"))).alias("first_idx"), F.max(F.when(wide, F.col("step"))).alias("longest_km")
    )


def lod_rows(points: DataFrame, buckets: int, dist: str = "dist") -> DataFrame:
    """The rows that keep a profile's outline: the lowest and highest of each of ``buckets`` equal lengths, and both ends (WIN16)."""
    whole = Window.partitionBy("trail_id")
    lo, hi = F.min(dist).over(whole), F.max(dist).over(whole)
    b = F.least(F.lit(buckets - 1), F.floor((F.col(dist) - lo) / F.nullif(hi - lo, F.lit(0.0)) * buckets))
    cut = points.withColumn("_b", F.coalesce(b, F.lit(0))).withColumn("_n", F.count("*").over(whole))
    own = Window.partitionBy("trail_id", "_b")
    low = F.row_number().over(own.orderBy("ele", "idx")) == 1
    high = F.row_number().over(own.orderBy(F.desc("ele"), "idx")) == 1
    end = (F.col("idx") == 0) | (F.col("idx") == F.col("_n") - 1)
    return cut.withColumn("_keep", low | high | end).where("_keep").drop("_b", "_n", "_keep")


def resample_targets(points: DataFrame, samples: int, dist: str = "dist") -> DataFrame:
    """``(trail_id, k, idx)``: the first row that reaches each of ``samples`` evenly spaced distances (WIN17).

    Each row serves the targets between its predecessor's distance and its own, so one ordered pass does it.
    """
    w, whole = _along(), Window.partitionBy("trail_id")
    step = (F.max(dist).over(whole)) / float(samples - 1)
    rows = points.select("trail_id", "idx", F.col(dist).alias("d"), F.lag(dist).over(w).alias("p"), step.alias("step"))
    first = F.when(F.col("p").isNull(), F.lit(0)).otherwise(F.floor(F.col("p") / F.col("step")) + 1)
    last = F.least(F.lit(samples - 1), F.floor(F.col("d") / F.col("step")))
    rows = rows.where("step > 0").withColumn("a", first.cast("int")).withColumn("b", last.cast("int")).where("a <= b")
    return rows.select("trail_id", F.explode(F.sequence("a", "b")).alias("k"), "idx")


def interpolate_nulls(rows: DataFrame, value: str, dist: str) -> DataFrame:
    """Adds ``filled``: missing values drawn by distance between known neighbours, held beyond the ends (WIN18)."""
    w = _along()
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(dist).alias("d"), F.col(value).alias("v")))
    out = rows.withColumn("_p", F.last(known, True).over(w)).withColumn("_n", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    t = (F.col(dist) - F.col("_p.d")) / F.nullif(F.col("_n.d") - F.col("_p.d"), F.lit(0.0))
    drawn = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.coalesce(t, F.lit(0.0))
    return out.withColumn("filled", F.coalesce(drawn, "_p.v", "_n.v")).drop("_p", "_n")


def reverse_track(points: DataFrame) -> DataFrame:
    """The track walked the other way: distances mirrored, climb and descent swapped (WIN20, WIN21, WIN33)."""
    whole = Window.partitionBy("trail_id")
    last, total = F.max("idx").over(whole), F.max("dist").over(whole)
    up, down = F.max("cum_ascent").over(whole), F.max("cum_descent").over(whole)
    return points.select(
        "trail_id", (last - F.col("idx")).alias("idx"), "lat", "lon", "ele", (total - F.col("dist")).alias("dist"),
        (down - F.col("cum_descent")).alias("cum_ascent"), (up - F.col("cum_ascent")).alias("cum_descent"),
    )


def truncate_ends(points: DataFrame, start_m: float, end_m: float) -> DataFrame:
    """The track without its first and last metres, cut at the first row that reaches them; two rows are always left (SIM15)."""
    whole = Window.partitionBy("trail_id")
    total, n = F.max("dist").over(whole), F.count("*").over(whole)
    flagged = points.withColumn("_total", total).withColumn("_n", n)
    a, b = F.col("dist") * 1000 >= start_m, (F.col("_total") - F.col("dist")) * 1000 >= end_m
    flagged = flagged.withColumn("_keep", a & b)
    kept = F.sum(F.col("_keep").cast("int")).over(whole)
    flagged = flagged.withColumn("_kept", kept)
    return flagged.where((F.col("_keep") & (F.col("_kept") >= 2)) | ((F.col("_kept") < 2) & (F.col("idx") < 2))).drop("_total", "_n", "_keep", "_kept")


def route_stats(points: DataFrame) -> DataFrame:
    """Distance, climb, bounds and ends of each trail (AGG16, AGG19, AGG33)."""
    measured = cumulative_climb(cumulative_km(points))
    return measured.groupBy("trail_id").agg(
        F.count("*").alias("n"), js_round(F.max("dist"), 3).alias("km"), js_round(F.max("cum_ascent"), 2).alias("ascent"), js_round(F.max("cum_descent"), 2).alias("descent"),
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"),
        F.min_by("lat", "idx").alias("start_lat"), F.max_by("lat", "idx").alias("end_lat"),
    )


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, median, n)``: the element at floor(n / 2) of the sorted values, not interpolated (AGG17)."""
    w = Window.partitionBy(key).orderBy(value)
    ranked = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("v"), F.row_number().over(w).alias("r"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    return ranked.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select(key, F.col("v").alias("median"), "n")


def km_range_in_bounds(points: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """``(trail_id, from_km, to_km)``: the run of rows within the box around the one nearest its centre (FLT15)."""
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    w = _along()
    runs = points.withColumn("_in", inside).withColumn("_grp", F.col("idx") - F.sum(F.col("_in").cast("int")).over(w)).where("_in")
    d = haversine_m(F.col("lat"), F.col("lon"), F.lit((south + north) / 2), F.lit((west + east) / 2))
    near = runs.groupBy("trail_id").agg(F.min_by("_grp", F.struct(d, F.col("idx"))).alias("_grp"))
    return runs.join(near, ["trail_id", "_grp"]).groupBy("trail_id").agg(F.min("dist").alias("from_km"), F.max("dist").alias("to_km"))


def with_elevation(points: DataFrame, elevation_at: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds ``ele`` from the caller's sampler of two columns, latitude and longitude (UDF02); what it cannot tell stays null."""
    return points.withColumn("ele", elevation_at(F.col("lat"), F.col("lon")))


def recompute_elevation(points: DataFrame, elevation_at: Callable[[Column, Column], Column]) -> DataFrame:
    """All columns that hang on height anew, after a backfill (WIN32): heights of the sampler where it has one, else those
    known, gaps drawn by distance, and the running climb."""
    filled = with_elevation(points.withColumnRenamed("ele", "_old"), elevation_at).withColumn("ele", F.coalesce("ele", "_old")).drop("_old")
    filled = interpolate_nulls(filled, "ele", "dist").withColumn("ele", F.coalesce("filled", F.lit(0.0))).drop("filled")
    return cumulative_climb(filled.drop("cum_ascent", "cum_descent"))


def build_trail(points: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A measured track, with the caller's own steps taken in turn before it is measured (UDF01)."""
    for step in steps:
        points = points.transform(step)
    return cumulative_climb(cumulative_km(points))


def contour_index(elevation: Column, step: int) -> Column:
    """1 for the contours that are drawn heavier, else 0 (SIM19)."""
    return F.when(elevation % step == 0, 1).otherwise(0)


def batch_stats(points: DataFrame, content: str) -> DataFrame:
    """``(trail_id, n, ascent, bytes)`` of a batch and of what it is written as (AGG27)."""
    return cumulative_climb(points).groupBy("trail_id").agg(F.count("*").alias("n"), js_round(F.max("cum_ascent"), 3).alias("ascent"), F.sum(F.octet_length(content)).alias("bytes"))


def reverse_trail(points: DataFrame) -> DataFrame:
    """A whole track the other way, with its breaks: the first row behind a break walked one way is the last one before it
    walked the other (WIN22)."""
    last = F.max("idx").over(Window.partitionBy("trail_id"))
    breaks = points.withColumn("_n", last + 1).where(_broken() & (F.col("idx") > 0)).select("trail_id", (F.col("_n") - F.col("idx")).alias("idx"), F.lit(True).alias("is_break"))
    return reverse_track(points).join(breaks, ["trail_id", "idx"], "left").withColumn("is_break", _broken())
