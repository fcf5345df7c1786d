"""Walks along a track from where someone is to the places on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.hiking import hiking_hours, hiking_time
from trekframe.functions.rounding import js_round
from trekframe.operators.ordered import asof


def at_km(rows: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """Adds ``name``, the running climb ``(up, down)`` at the track row nearest to each row's ``km``, the earlier in a tie (WIN25).

    ``points`` are ``(trail_id, idx, dist, cum_ascent, cum_descent)``; of rows at one distance, as those at a break and those
    that do not move, the first counts. Two ordered passes; no row meets a whole track.
    """
    row = F.struct("dist", F.col("cum_ascent").alias("up"), F.col("cum_descent").alias("down"))
    line = points.groupBy("trail_id", F.col("dist").alias("km")).agg(F.min_by(row, "idx").alias("s"))
    both = asof(asof(rows, line, "trail_id", "km", F.col("s"), "_b"), line, "trail_id", "km", F.col("s"), "_a", forward=True)
    nearer = F.col("_b").isNull() | (F.col("_a.dist") - F.col("km") < F.col("km") - F.col("_b.dist"))
    return both.withColumn(name, F.when(F.coalesce(nearer, F.lit(False)), F.col("_a")).otherwise(F.col("_b"))).drop("_a", "_b")


def _metres(first: str, last: str, what: str):
    return js_round(js_round(F.col(f"{last}.{what}") - F.col(f"{first}.{what}"), 6))


def trips(here: DataFrame, places: DataFrame, points: DataFrame, kmh: float = 4.0, behind: bool = False) -> DataFrame:
    """``(trail_id, here_id, place_id, ahead, km, ascent_m, descent_m, eta_min)`` from where each walker ``(trail_id, here_id, km)``
    is to every place ``(trail_id, place_id, km)`` ahead of them (JON54); with ``behind``, to those they have passed as
    well, where climb and descent change places (JON55). Breaks are not climbed, as ``points`` does not count them."""
    a = at_km(here, points, "_h").withColumnRenamed("km", "_from")
    b = at_km(places, points, "_p").withColumnRenamed("km", "_to")
    met = a.join(b, "trail_id")
    met = met if behind else met.where(F.col("_to") > F.col("_from"))
    ahead = F.col("_to") >= F.col("_from")
    gain, loss = (F.when(ahead, _metres("_h", "_p", w)).otherwise(_metres("_p", "_h", w)) for w in ("up", "down"))
    rows = met.select(
        "trail_id", "here_id", "place_id", ahead.alias("ahead"), F.abs(F.col("_to") - F.col("_from")).alias("km"), F.when(ahead, gain).otherwise(loss).alias("ascent_m"), F.when(ahead, loss).otherwise(gain).alias("descent_m"),
    )
    return rows.withColumn("eta_min", js_round(hiking_time(F.col("km"), F.col("ascent_m"), F.col("descent_m"), kmh) * 60))


def day_metrics(stops: DataFrame, points: DataFrame, kmh: float = 4.0) -> DataFrame:
    """``(trail_id, stop_id, from_km, km, ascent_m, descent_m, hours)`` of the days between successive stops ``(trail_id, stop_id,
    km)``, hours unrounded (MTH19)."""
    w = Window.partitionBy("trail_id").orderBy("km", "stop_id")
    rows = at_km(stops, points, "_z").withColumns({"_a": F.lag("_z").over(w), "from_km": F.lag("km").over(w)}).where("from_km is not null")
    rows = rows.select("trail_id", "stop_id", "from_km", (F.col("km") - F.col("from_km")).alias("km"), _metres("_a", "_z", "up").alias("ascent_m"), _metres("_a", "_z", "down").alias("descent_m"))
    return rows.withColumn("hours", hiking_hours(F.col("km"), F.col("ascent_m"), F.col("descent_m"), kmh))
