"""Walking times, food, units and thresholds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trekframe.functions.rounding import js_round

# Metres of climb a walker makes in an hour, the descent that costs no time, and unit factors.
CLIMB_PER_HOUR = 600.0
FREE_DESCENT = 300.0
KM_PER_MILE = 1.609344
FEET_PER_METRE = 3.280839895


def hiking_hours(km: Column, ascent: Column, descent: Column, kmh: float | Column = 4.0) -> Column:
    """Hours for a stretch, unrounded (MTH04)."""
    speed = F.lit(kmh) if isinstance(kmh, (int, float)) else kmh
    return km / speed + ascent / CLIMB_PER_HOUR + F.greatest(F.lit(0.0), (descent - FREE_DESCENT) / CLIMB_PER_HOUR)


def hiking_time(km: Column, ascent: Column, descent: Column, kmh: float | Column = 4.0) -> Column:
    """Hours for a stretch, to a tenth (MTH05)."""
    return js_round(hiking_hours(km, ascent, descent, kmh), 1)


def food_weight_kg(days: Column, grams_per_day: float) -> Column:
    """(MTH07)"""
    return days * grams_per_day / 1000.0


def convert_distance(km: Column, unit: str) -> Column:
    return km / KM_PER_MILE if unit == "mi" else km


def convert_elevation(m: Column, unit: str) -> Column:
    return m * FEET_PER_METRE if unit == "mi" else m


def length_band(km: Column) -> Column:
    """(MTH09)"""
    return F.when(km < 30, "short").when(km <= 300, "medium").otherwise("long")


def clamp(x: Column, low: float, high: float, default: float) -> Column:
    """Into the bounds; what is no number gives the default (MTH10)."""
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), x)))


def backoff_ms(attempts: Column, base_ms: int = 30_000, most_ms: int = 3_600_000) -> Column:
    """Doubling waits up to a limit (MTH11)."""
    return F.least(F.pow(F.lit(2.0), attempts) * base_ms, F.lit(float(most_ms))).cast("long")


def fetch_backoff_ms(failures: Column) -> Column:
    """The wait after so many failures in a row: an hour after none or one, doubled with each more, two days at most (MTH12)."""
    return backoff_ms(F.least(F.greatest(failures - 1, F.lit(0)), F.lit(30)), 3_600_000, 172_800_000)


def nice_step(span: Column, max_ticks: int) -> Column:
    """The least of 1, 2, 5 times a power of ten that gives at most so many ticks (MTH13)."""
    raw = span / max_ticks
    unit = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    times = raw / unit
    return F.when(times <= 1, unit).when(times <= 2, 2 * unit).when(times <= 5, 5 * unit).otherwise(10 * unit)


def plan_window_hours(hours: Column) -> Column:
    """How far a suggested day may miss its target (MTH22)."""
    return F.least(F.lit(2.5), F.greatest(F.lit(0.75), hours * 0.35))


def plan_floor_hours(hours: Column) -> Column:
    return F.greatest(F.lit(0.75), hours * 0.25)


def active_km(km: Column, direction: Column, total: Column) -> Column:
    """Kilometres in the walked direction (MTH21)."""
    return F.when(direction == "SOBO", total - km).otherwise(km)


def day_cost(hours: Column, target: float, scale: float, limit: float, final: Column) -> Column:
    """Squared miss of the target; none where the day is too long; a last day may be short for free (MTH18)."""
    miss = (hours - target) / scale
    return F.when(hours > limit, F.lit(None).cast("double")).when(final & (hours <= target), F.lit(0.0)).otherwise(miss * miss)


def option_access(km_off: Column, mode: Column, routed: Column, most_walk_km: float = 5.0) -> Column:
    """How a place off the trail is reached: walked if routed, said to be, on the trail, or near; else ridden (MTH20)."""
    walk = routed | (mode == "foot") | (F.coalesce(km_off, F.lit(0.0)) == 0) | (mode.isNull() & (km_off <= most_walk_km))
    return F.when(F.coalesce(walk, F.lit(False)), "walk").otherwise("ride")


def add_walks(km: Column, ascent: Column, descent: Column, out: Column, into: Column) -> Column:
    """A leg with the walk back from the place it starts at and the one to the place it ends at (MTH17).

    Walks are structs ``(km, ascent, descent)`` from the trail to the place, null for none; the way back climbs what the
    way there came down.
    """
    part = lambda walk, name: F.coalesce(walk[name], F.lit(0))
    return F.struct(
        (km + part(out, "km") + part(into, "km")).alias("km"), (ascent + part(out, "descent") + part(into, "ascent")).alias("ascent"),
        (descent + part(out, "ascent") + part(into, "descent")).alias("descent"),
    )
