"""Where a track walks back over its own ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.functions.geo import haversine_m
from trekframe.operators.ordered import asof, coalesce_intervals
from trekframe.operators.spatial import radius_pairs
from trekframe.storage import materialize


def self_retraces(points: DataFrame, near_m: float = 150.0, least_km: float = 1.0, end_km: float = 0.5) -> DataFrame:
    """``(trail_id, start_idx, turn_idx, end_idx, start_km, turn_km, end_km, length_km, terminal)`` of the stretches that a
    track walks out and back (WIN15).

    ``points`` are ``(trail_id, idx, lat, lon, dist)``. Rows meet the rows of their own track within ``near_m`` through
    cells; for each row the earliest that lies at least twice ``least_km`` behind it along the track is its pass before. The
    end of a loop, which comes back to its start, is none. Overlapping passes are one stretch, which turns at the row
    farthest from where it starts; of the ways out and back the shorter is its length. ``terminal`` are stretches at an end
    of the track.
    """
    here = points.select("trail_id", F.col("idx").alias("j"), F.col("dist").alias("j_km"), "lat", "lon")
    there = points.select("trail_id", F.col("idx").alias("i"), F.col("dist").alias("i_km"), "lat", "lon")
    met = radius_pairs(here, there, near_m, ("trail_id",)).where((F.col("i") < F.col("j")) & (F.col("j_km") - F.col("i_km") >= 2 * least_km))
    passes = met.groupBy("trail_id", "j").agg(F.min(F.struct("i", "i_km")).alias("b"), F.first("j_km").alias("j_km"))
    total = points.groupBy("trail_id").agg(F.max("dist").alias("total"))
    passes = passes.join(total, "trail_id").where(~((F.col("b.i_km") <= end_km) & (F.col("total") - F.col("j_km") <= end_km)))
    found = coalesce_intervals(passes.select("trail_id", F.col("b.i").alias("from_km"), F.col("j").alias("to_km")))
    found = materialize(found.select("trail_id", F.col("from_km").alias("start_idx"), F.col("to_km").alias("end_idx")), "retraces")

    starts = found.join(points.select("trail_id", F.col("idx").alias("start_idx"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("dist").alias("start_km")), ["trail_id", "start_idx"])
    starts = starts.select("trail_id", F.col("start_idx").alias("idx"), F.struct("start_idx", "end_idx", "a_lat", "a_lon", "start_km").alias("e"))
    inside = asof(points.select("trail_id", "idx", "lat", "lon", "dist"), starts, "trail_id", "idx", F.col("e"), "e").where(F.col("idx") <= F.col("e.end_idx"))
    far = F.struct(haversine_m(F.col("e.a_lat"), F.col("e.a_lon"), F.col("lat"), F.col("lon")), -F.col("idx"))
    per = inside.groupBy("trail_id", F.col("e.start_idx").alias("start_idx"), F.col("e.end_idx").alias("end_idx"), F.col("e.start_km").alias("start_km")).agg(F.max_by(F.struct("idx", "dist"), far).alias("t"), F.max_by("dist", "idx").alias("end_km"))
    length = F.least(F.col("t.dist") - F.col("start_km"), F.col("end_km") - F.col("t.dist"))
    per = per.join(total, "trail_id").withColumn("length_km", length).where(F.col("length_km") >= least_km)
    return per.select(
        "trail_id", "start_idx", F.col("t.idx").alias("turn_idx"), "end_idx", "start_km", F.col("t.dist").alias("turn_km"), "end_km", "length_km",
        ((F.col("start_km") <= end_km) | (F.col("total") - F.col("end_km") <= end_km)).alias("terminal"),
    )
