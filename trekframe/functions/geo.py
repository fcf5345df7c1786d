"""Distances and map geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEGREE = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres (MTH01, MTH02)."""
    half_lat, half_lon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_3d_m(lat1: Column, lon1: Column, ele1: Column, lat2: Column, lon2: Column, ele2: Column) -> Column:
    """Metres along the slope (MTH03)."""
    flat = haversine_m(lat1, lon1, lat2, lon2)
    return F.sqrt(flat * flat + (ele2 - ele1) * (ele2 - ele1))


def wrap_lon(d: Column) -> Column:
    """A longitude difference within ±180 (MTH15)."""
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180) / 360 * float(1 << zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    """Row of a slippy-map tile (MTH14)."""
    rad = F.radians(lat)
    return F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / 3.141592653589793) / 2 * float(1 << zoom)).cast("long")


def projected_epsg(lon: Column, lat: Column) -> Column:
    """A metric projection for a place: a national grid zone within Australia, else UTM by hemisphere (MTH16)."""
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6) + 1)
    australia = lon.between(112, 154) & lat.between(-44, -10)
    return F.when(australia, 28300 + zone).when(lat >= 0, 32600 + zone).otherwise(32700 + zone).cast("long")


def segment_fraction(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Where a place projects on a segment, 0 to 1, on the plane that is true at the segment's start."""
    k = F.cos(F.radians(lat1))
    dx, dy = wrap_lon(lon2 - lon1) * k, lat2 - lat1
    px, py = wrap_lon(lon - lon1) * k, lat - lat1
    square = dx * dx + dy * dy
    return F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (px * dx + py * dy) / square)))


def segment_distance_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a place to the nearest point of a segment."""
    t = segment_fraction(lat, lon, lat1, lon1, lat2, lon2)
    return haversine_m(lat, lon, lat1 + (lat2 - lat1) * t, lon1 + wrap_lon(lon2 - lon1) * t)


METRES_PER_DEGREE = 111_320.0


def plane_distance_m(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres from a place to the nearest point of a segment, on the plane that is true at the place."""
    k = METRES_PER_DEGREE * F.cos(F.radians(lat))
    ax, ay = wrap_lon(lon1 - lon) * k, (lat1 - lat) * METRES_PER_DEGREE
    dx, dy = wrap_lon(lon2 - lon1) * k, (lat2 - lat1) * METRES_PER_DEGREE
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / square)))
    return F.hypot(ax + t * dx, ay + t * dy)
