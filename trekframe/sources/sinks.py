"""Writers: GPX, CSV, GeoJSON, and a catalog written last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.pois import slim_tags
from trekframe.functions.rounding import js_round
from trekframe.functions.text import csv_quote, escape_xml
from trekframe.operators.sequential import simplify


EXTENSIONS = [("off_trail_km", "offTrailKm"), ("access_mode", "accessMode")]


def gpx_documents(points: DataFrame, waypoints: DataFrame | None = None) -> DataFrame:
    """``(trail_id, gpx)``: one document a trail, points in order within tracks (SNK01, SNK02).

    ``points`` are ``(trail_id, track, idx, lat, lon, ele)``, ``waypoints`` ``(trail_id, seq, name, type, lat, lon)`` and
    perhaps ``off_trail_km`` and ``access_mode``, which are written as extensions where they are known.
    """
    place = F.format_string('<trkpt lat="%.6f" lon="%.6f"><ele>%.1f</ele></trkpt>', "lat", "lon", "ele")
    tracks = points.select("trail_id", "track", "idx", place.alias("x")).groupBy("trail_id", "track")
    tracks = tracks.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda p: p["x"]), "").alias("body"), F.min("idx").alias("first"))
    one = F.concat(F.lit("<trk><name>"), escape_xml(F.col("track")), F.lit("</name><trkseg>"), "body", F.lit("</trkseg></trk>"))
    out = tracks.groupBy("trail_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", one.alias("x")))), lambda t: t["x"]), "").alias("tracks"))
    if waypoints is not None:
        w = F.concat(F.format_string('<wpt lat="%.6f" lon="%.6f"><name>', "lat", "lon"), escape_xml(F.col("name")), F.lit("</name><type>"), escape_xml(F.coalesce("type", F.lit("waypoint"))), F.lit("</type>"))
        known = [(c, tag) for c, tag in EXTENSIONS if c in waypoints.columns]
        inner = F.concat(*(F.coalesce(F.concat(F.lit(f"<tn:{tag}>"), escape_xml(F.col(c).cast("string")), F.lit(f"</tn:{tag}>")), F.lit("")) for c, tag in known), F.lit(""))
        w = F.concat(w, F.when(inner != "", F.concat(F.lit("<extensions>"), inner, F.lit("</extensions>"))).otherwise(""), F.lit("</wpt>"))
        marks = waypoints.groupBy("trail_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", w.alias("x")))), lambda t: t["x"]), "").alias("marks"))
        out = out.join(marks, "trail_id", "left")
    else:
        out = out.withColumn("marks", F.lit(""))
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="trekframe" xmlns="http://www.topografix.com/GPX/1/1" xmlns:tn="urn:trekframe:waypoint">'
    return out.select("trail_id", F.concat(F.lit(head), F.coalesce("marks", F.lit("")), "tracks", F.lit("</gpx>")).alias("gpx"))


def _number(x) -> Column:
    """A number as short as it can be written: no decimals where there are none."""
    return F.regexp_replace(F.col(x).cast("string"), r"\.0$", "")


def _in_order(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """``(*keys, body)``: the values of a group in their order, as one text."""
    return rows.select(*keys, F.struct(*order, value.alias("x")).alias("p")).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), "").alias("body"))


def trail_page_gpx(trails: DataFrame, points: DataFrame, waypoints: DataFrame, variants: DataFrame) -> DataFrame:
    """``(trail_id, gpx)``: a trail's page as one GPX 1.1 document (SNK04).

    ``trails`` are ``(trail_id, name, region, km)``; ``points`` ``(trail_id, stretch, idx, lat, lon, ele)``, one segment of
    the track for each stretch between breaks; ``waypoints`` ``(trail_id, seq, off_trail, lat, lon, ele, name, type,
    description)``, those on the trail first and only they with a height; ``variants`` ``(trail_id, seq, name, type, idx,
    lat, lon, ele)``, a typed track each. A missing name is 'Waypoint' or 'Unnamed', other missing parts are left out. A
    trail without points still has its empty track.
    """
    tag = lambda name, text: F.coalesce(F.concat(F.lit(f"<{name}>"), escape_xml(text), F.lit(f"</{name}>")), F.lit(""))
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    named = lambda other: F.coalesce(given("name"), F.lit(other))
    where = lambda kind: F.concat(F.lit(f'<{kind} lat="'), _number("lat"), F.lit('" lon="'), _number("lon"), F.lit('">'))
    spot = F.concat(where("trkpt"), tag("ele", _number("ele")), F.lit("</trkpt>"))
    segment = F.concat(F.lit("<trkseg>"), F.col("body"), F.lit("</trkseg>"))
    line = _in_order(_in_order(points, ["trail_id", "stretch"], ["idx"], spot), ["trail_id"], ["stretch"], segment).withColumnRenamed("body", "line")
    mark = F.concat(where("wpt"), F.when(F.col("off_trail"), F.lit("")).otherwise(tag("ele", _number("ele"))), tag("name", named("Waypoint")), tag("type", given("type")), tag("desc", given("description")), F.lit("</wpt>"))
    marks = _in_order(waypoints, ["trail_id"], ["off_trail", "seq"], mark).withColumnRenamed("body", "marks")
    track = F.concat(F.lit("<trk>"), tag("name", named("Unnamed")), tag("type", F.coalesce("type", F.lit(""))), segment, F.lit("</trk>"))
    others = _in_order(_in_order(variants, ["trail_id", "seq", "name", "type"], ["idx"], spot), ["trail_id"], ["seq"], track).withColumnRenamed("body", "others")
    met = trails.join(line, "trail_id", "left").join(marks, "trail_id", "left").join(others, "trail_id", "left")
    about = F.concat(F.lit("<metadata>"), tag("name", F.col("name")), F.lit("<desc>"), escape_xml(F.col("region")), F.format_string(" - %.1f km</desc></metadata>", "km"))
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="trekframe" xmlns="http://www.topografix.com/GPX/1/1">'
    main = F.concat(F.lit("<trk>"), tag("name", F.col("name")), part("line"), F.lit("</trk>"))
    return met.select("trail_id", F.concat(F.lit(head), about, part("marks"), main, part("others"), F.lit("</gpx>")).alias("gpx"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """One quoted CSV line a row (SNK03)."""
    return rows.select(F.concat_ws(",", *(F.coalesce(csv_quote(F.col(c)), F.lit("")) for c in rows.columns)).alias("value"))


def line_features(points: DataFrame) -> DataFrame:
    """``(trail_id, geometry)``: a GeoJSON line per trail, in parts where it breaks; parts of one point go (SNK14)."""
    pair = F.struct("idx", F.array("lon", "lat").alias("c"))
    parts = points.groupBy("trail_id", "stretch").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p["c"]).alias("line"), F.min("idx").alias("first")).where(F.size("line") >= 2)
    lines = parts.groupBy("trail_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "line"))), lambda p: p["line"]).alias("coordinates"))
    return lines.select("trail_id", F.to_json(F.struct(F.lit("MultiLineString").alias("type"), "coordinates")).alias("geometry"))


def point_features(rows: DataFrame, properties: list[str]) -> DataFrame:
    """(SNK15, SNK16)"""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def catalog(files: DataFrame) -> DataFrame:
    """``(id, md5, sha256, bytes, key)`` of contents ``(id, content)``; written after the contents, it is the commit (SNK09, SNK12)."""
    return files.select("id", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"), F.concat_ws("/", "id", F.md5("content")).alias("key"))


def publish(files: DataFrame, path: str) -> DataFrame:
    """Writes contents and then their catalog under ``path``; refuses an empty catalog."""
    files.write.mode("overwrite").parquet(f"{path}/files")
    listed = catalog(files.sparkSession.read.parquet(f"{path}/files"))
    if listed.isEmpty():
        raise ValueError("nothing to publish")
    listed.orderBy("id").write.mode("overwrite").json(f"{path}/catalog")
    return listed


def trail_documents(points: DataFrame, waypoints: DataFrame) -> DataFrame:
    """``(trail_id, doc)``: one JSON document a trail with its points and waypoints in order (SNK05, SNK10).

    ``points`` are ``(trail_id, idx, lat, lon, ele, dist, cum_ascent)``, ``waypoints`` ``(trail_id, seq, name, km)``.
    """
    rows = points.groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct("idx", "lat", "lon", "ele", "dist", "cum_ascent"))).alias("points"))
    marks = waypoints.groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct("seq", "name", "km"))).alias("waypoints"))
    met = rows.join(marks, "trail_id", "left")
    return met.select("trail_id", F.to_json(F.struct("trail_id", "points", F.coalesce("waypoints", F.array().cast(marks.schema["waypoints"].dataType)).alias("waypoints"))).alias("doc"))


def _short(columns: dict[str, int]) -> list[Column]:
    return [js_round(c, digits).alias(c) for c, digits in columns.items()]


def _lists(rows: DataFrame, order: str, fields: list, name: str) -> DataFrame:
    """``(trail_id, name)``: a trail's rows as an array in their order."""
    return rows.groupBy("trail_id").agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias(name))


def mobile_documents(trails: DataFrame, points: DataFrame, waypoints: DataFrame, variants: DataFrame, pois: DataFrame, target: int = 5000, variant_target: int = 1000) -> DataFrame:
    """``(trail_id, doc)``: one JSON document a trail, thinned for a phone (SNK06).

    ``trails`` are ``(trail_id, name, enriched)``; ``points`` ``(trail_id, stretch, idx, lat, lon, ele, dist, cum_ascent,
    cum_descent)`` with the climbs of the full track, which the kept points carry on; ``waypoints`` ``(trail_id, seq, name,
    lat, lon, ele, km)``; ``variants`` ``(trail_id, seq, name, type, idx, lat, lon, ele)``; ``pois`` ``(trail_id, place_id,
    name, lat, lon, along, tags)``.

    Each stretch is simplified to its share of ``target`` by its number of points, two at least, and a break's index is
    that of its stretch's first kept point. Variants are simplified to ``variant_target``. Numbers are short, places keep
    the tags that are shown. A trail that was never enriched has no ``pois``, one with none found an empty list; a trail
    without points gives no document.
    """
    sizes = points.groupBy("trail_id", "stretch").agg(F.count("*").alias("_n"))
    share = sizes.join(points.groupBy("trail_id").agg(F.count("*").alias("_all")), "trail_id")
    share = share.select("trail_id", "stretch", F.greatest(F.lit(2), F.floor(F.lit(float(target)) * F.col("_n") / F.col("_all") + 0.5)).alias("_most"))
    kept = points.join(simplify(points.join(share, ["trail_id", "stretch"]), target="_most"), ["trail_id", "idx"], "left_semi")
    fields = [*_short({"lat": 6, "lon": 6, "ele": 1, "dist": 1}), *(js_round(js_round(c, 6)).alias(c) for c in ("cum_ascent", "cum_descent"))]
    thin = _lists(kept, "idx", fields, "points")
    total = points.groupBy("trail_id").agg(*(js_round(F.max(c), n).alias(c) for c, n in (("dist", 1), ("cum_ascent", 0), ("cum_descent", 0))))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("trail_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.min("stretch").over(Window.partitionBy("trail_id"))
    cuts = kept.groupBy("trail_id", "stretch").agg(F.count("*").alias("n")).withColumns({"at": before, "first": first}).where("stretch > first")
    breaks = cuts.groupBy("trail_id").agg(F.array_sort(F.collect_list("at")).alias("breaks"))
    marks = _lists(waypoints, "seq", ["name", *_short({"lat": 6, "lon": 6, "ele": 1, "km": 1})], "waypoints")
    numbered = variants.withColumn("row", F.row_number().over(Window.partitionBy("trail_id").orderBy("seq", "idx")))
    lines = simplify(numbered.select("trail_id", F.col("seq").alias("stretch"), F.col("row").alias("idx"), "lat", "lon"), target=variant_target)
    lines = numbered.join(lines.withColumnRenamed("idx", "row"), ["trail_id", "row"], "left_semi")
    lines = lines.groupBy("trail_id", "seq", "name", "type").agg(F.array_sort(F.collect_list(F.struct("idx", *_short({"lat": 6, "lon": 6, "ele": 1})))).alias("points"))
    others = _lists(lines, "seq", ["name", "type", "points"], "variants")
    spots = pois.withColumn("tags", F.to_json(slim_tags(F.col("tags"))))  # maps cannot be ordered in an array
    spots = _lists(spots, "place_id", ["name", *_short({"lat": 6, "lon": 6, "along": 1}), "tags"], "pois")
    met = trails.join(thin, "trail_id").join(total, "trail_id")
    for part in (breaks, marks, others, spots):
        met = met.join(part, "trail_id", "left")
    listed = [F.coalesce(c, F.array().cast(met.schema[c].dataType)).alias(c) for c in ("breaks", "waypoints", "variants")]
    found = F.when(F.col("enriched"), F.coalesce("pois", F.array().cast(met.schema["pois"].dataType))).alias("pois")
    return met.select("trail_id", F.to_json(F.struct("trail_id", "name", "dist", "cum_ascent", "cum_descent", "points", *listed, found)).alias("doc"))


def poi_file(existing: DataFrame, pois: DataFrame) -> DataFrame:
    """``(trail_id, pois, rejected, duplicates)``: newly found places in order of km and key, with what was curated by hand
    kept from the file before (SNK07)."""
    order = F.array_sort(F.collect_list(F.struct("km", "key")))
    found = pois.groupBy("trail_id").agg(F.transform(order, lambda p: p["key"]).alias("pois"))
    kept = existing.select("trail_id", "rejected", "duplicates")
    none = F.array().cast("array<string>")
    return found.join(kept, "trail_id", "full_outer").select("trail_id", F.coalesce("pois", none).alias("pois"), F.coalesce("rejected", none).alias("rejected"), F.coalesce("duplicates", F.create_map().cast("map<string,string>")).alias("duplicates"))


def registry_lines(ids: DataFrame) -> DataFrame:
    """``(trail_id, line)``: a JSON line a trail with its ids in order (SNK13)."""
    return ids.groupBy("trail_id").agg(F.to_json(F.array_sort(F.collect_set("id"))).alias("line"))


def tile_rows(tiles: DataFrame) -> DataFrame:
    """Tiles ``(z, x, y, seq, data)`` as an archive keeps them: the last of each place, rows counted from below (SNK08)."""
    last = tiles.groupBy("z", "x", "y").agg(F.max_by("data", "seq").alias("data"))
    return last.withColumn("y", F.expr("cast(shiftleft(1L, cast(z as int)) - 1 - y as bigint)"))
