"""The ground around a route: map tiles within reach of it, and what to ask a map server for along it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.geo import EARTH_M, wrap_lon
from trekframe.functions.rounding import js_round
from trekframe.operators.sequential import corridor_chunks, pack_in_order

DEGREE_M = 111_320  # metres of a degree of latitude
MAX_LAT = 85.05112878  # where the square map ends
BYTES_PER_KM = (500, 15_000)  # answers for a remote trail, and through towns


def _clamped(lat: Column) -> Column:
    return F.least(F.lit(MAX_LAT), F.greatest(F.lit(-MAX_LAT), lat))


def _row(lat: Column, n: int) -> Column:
    rad = F.radians(_clamped(lat))
    return F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n)


def route_tiles(points: DataFrame, buffer_m: float, min_zoom: int, max_zoom: int) -> DataFrame:
    """``(trail_id, z, x, y)``: the tiles within ``buffer_m`` of tracks ``(trail_id, idx, lat, lon)``, at every zoom (SIM13).

    Every step is sampled at half a tile's width on its narrower end, so that no tile between two far points is left out,
    the short way round where it crosses the antimeridian. A sample takes all tiles that its box of the buffer meets:
    columns go around the globe, rows end at the map's edges. A tile above is there if one below it is. Samples are
    exploded from their step and made distinct, map-side first; nothing is gathered by trail.
    """
    n = 1 << max_zoom
    w = Window.partitionBy("trail_id").orderBy("idx")
    rows = points.select("trail_id", "idx", "lat", "lon", F.lag("lat").over(w).alias("lat0"), F.lag("lon").over(w).alias("lon0"))
    turn, rise = wrap_lon(F.col("lon") - F.col("lon0")), F.col("lat") - F.col("lat0")
    long = F.hypot(rise * DEGREE_M, turn * DEGREE_M * F.cos(F.radians(_clamped((F.col("lat") + F.col("lat0")) / 2))))
    width = 2 * math.pi * EARTH_M / n * F.least(F.cos(F.radians(_clamped(F.col("lat")))), F.cos(F.radians(_clamped(F.col("lat0")))))
    steps = F.greatest(F.lit(1), F.ceil(long / F.greatest(F.lit(1.0), width / 2)))
    part = rows.withColumns({"n": F.coalesce(steps, F.lit(1)), "turn": turn, "rise": rise}).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))))
    share = F.col("k") / F.col("n")
    spots = part.select("trail_id", F.when(F.col("k") == F.col("n"), F.col("lat")).otherwise(F.col("lat0") + F.col("rise") * share).alias("lat"), F.when(F.col("k") == F.col("n"), F.col("lon")).otherwise(F.col("lon0") + F.col("turn") * share).alias("lon"))
    d_lat = buffer_m / DEGREE_M
    d_lon = buffer_m / (DEGREE_M * F.greatest(F.lit(0.01), F.cos(F.radians(_clamped(F.col("lat"))))))
    x0, x1 = (F.floor((F.col("lon") + s * d_lon + 180) / 360 * n) for s in (-1, 1))
    y0, y1 = F.greatest(F.lit(0), _row(F.col("lat") + d_lat, n)), F.least(F.lit(n - 1), _row(F.col("lat") - d_lat, n))
    boxes = spots.select("trail_id", x0.alias("x0"), F.least(x1, x0 + n - 1).alias("x1"), y0.alias("y0"), y1.alias("y1")).distinct()
    tiles = boxes.withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    tiles = tiles.select("trail_id", F.pmod("x", F.lit(n)).alias("x"), "y").distinct()
    up = tiles.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(max_zoom - min_zoom))))
    return up.select("trail_id", (max_zoom - F.col("up")).alias("z"), F.expr("shiftright(x, up)").alias("x"), F.expr("shiftright(y, up)").alias("y")).distinct()


def selectors(catalog: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """``(category, selector)`` of what the rules ``(category, key, value)`` ask for: rules of one key are one pattern."""
    found: dict[tuple[str, str], set[str]] = {}
    for category, key, value in catalog:
        found.setdefault((category, key), set()).add(value)
    test = lambda v: f'="{v[0]}"' if len(v) == 1 else f'~"^({"|".join(v)})$"'
    return sorted((category, f'nwr["{key}"{test(sorted(values))}]') for (category, key), values in found.items())


def box_queries(boxes: DataFrame, catalog: list[tuple[str, str, str]], pad_km: float = 0.0) -> DataFrame:
    """``(trail_id, category, text)``: what to ask a map server for in each trail's box ``(trail_id, south, north, west, east)``
    with a margin of ``pad_km`` (UDF05)."""
    lat = pad_km * 1000 / DEGREE_M
    lon = lat / F.greatest(F.lit(0.01), F.cos(F.radians((F.col("south") + F.col("north")) / 2)))
    edges = (F.col("south") - lat, F.col("west") - lon, F.col("north") + lat, F.col("east") + lon)
    box = F.format_string("(%.5f,%.5f,%.5f,%.5f)", *edges)
    own = selectors(catalog)
    kinds = F.array(*[F.struct(F.lit(c).alias("category"), F.array(*[F.lit(s) for k, s in own if k == c]).alias("own")) for c in dict.fromkeys(c for c, _ in own)])
    rows = boxes.select("trail_id", box.alias("box"), F.inline(kinds))
    lines = F.array_join(F.transform("own", lambda s: F.concat(s, F.col("box"), F.lit(";"))), "")
    return rows.select("trail_id", "category", F.concat(F.lit("[out:json];("), lines, F.lit(");out center;")).alias("text"))


def search_queries(points: DataFrame, radius_m: float, catalog: list[tuple[str, str, str]], most_rows: int = 150, most_bytes: float = 8_000.0, timeout_s: int = 25) -> DataFrame:
    """``(trail_id, query, chunks, text)``: the queries that a search along each route sends (SIM20).

    ``points`` are ``(trail_id, idx, stretch, lat, lon)``. Routes are simplified and cut into chunks of at most ``most_rows``
    rows (SIM04), and chunks packed in order into queries whose lines have at most ``most_bytes`` together (SIM05).
    """
    rows = corridor_chunks(points, radius_m, most_rows).join(points.select("trail_id", "idx", "lat", "lon"), ["trail_id", "idx"])
    spot = F.struct("idx", F.format_string("%.5f,%.5f", "lat", "lon").alias("at"))
    lines = rows.groupBy("trail_id", "line", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(spot)), lambda s: s["at"]), ",").alias("path"))
    lines = lines.withColumn("seq", F.row_number().over(Window.partitionBy("trail_id").orderBy("line", "chunk")))
    packed = pack_in_order(lines.select("trail_id", "seq", F.length("path").cast("double").alias("size")), most_bytes)
    packed = packed.select("trail_id", F.posexplode("batches").alias("pos", "query")).select("trail_id", (F.col("pos") + 1).alias("seq"), "query")
    per = lines.join(packed, ["trail_id", "seq"]).groupBy("trail_id", "query").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "path"))), lambda s: s["path"]).alias("paths"))
    asks = F.array(*[F.lit(s) for s in dict.fromkeys(s for _, s in selectors(catalog))])
    around = F.lit(f"(around:{radius_m:g},")
    lines_of = F.flatten(F.transform(asks, lambda s: F.transform("paths", lambda p: F.concat(s, around, p, F.lit(");")))))
    text = F.concat(F.lit(f"[out:json][timeout:{timeout_s}];("), F.array_join(lines_of, ""), F.lit(");out center;"))
    return per.select("trail_id", "query", F.size("paths").alias("chunks"), text.alias("text"))


def form_length(text: Column) -> Column:
    """Bytes of a text as the field of a form, with the characters left plain that a browser leaves plain."""
    coded = F.url_encode(text)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(code), F.lit(plain))
    return F.length(coded) + len("data=")


def search_estimate(queries: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(trail_id, queries, route_km, upload_bytes, low_bytes, high_bytes)``: what a search would send and, from the route's
    length ``(trail_id, route_km)``, receive (SIM20). A trail without usable points asks nothing."""
    sent = queries.groupBy("trail_id").agg(F.count("*").alias("queries"), F.sum(form_length(F.col("text"))).alias("upload_bytes"))
    low, high = (js_round(F.col("route_km") * b).cast("long") for b in BYTES_PER_KM)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return lengths.join(sent, "trail_id", "left").select("trail_id", zero("queries"), "route_km", zero("upload_bytes"), low.alias("low_bytes"), high.alias("high_bytes"))
