"""Readers of the planner's files, all with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "struct<_lat: string, _lon: string, ele: string, time: string>"
GPX_TRACK = f"name string, trkseg array<struct<trkpt: array<{_POINT}>>>"
GPX_ROUTE = f"name string, rtept array<{_POINT}>"
GPX_WAYPOINT = "_lat string, _lon string, ele string, name string, desc string, type string, extensions struct<`tn:offTrailKm`: string, `tn:accessMode`: string, `tn:acceptsBoxes`: string, `tn:store`: string, `tn:offTrailAscentM`: string, `tn:offTrailDescentM`: string>"
POI_FILE = "trailId string, pois array<struct<id: bigint, type: string, category: string, lat: double, lon: double, name: string, tags: map<string,string>, distanceAlongTrail: double, distanceFromTrail: double>>, rejected array<string>"
CLIMATE_FILE = "location string, daily struct<time: array<string>, temperature_2m_max: array<double>, temperature_2m_min: array<double>, precipitation_sum: array<double>>"
OVERPASS_FILE = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string,string>>>"
TRAIL_CONFIG = "id string, name string, shortName string, region string, country string, states array<string>, lengthKm double, gpxFile string"
GEOJSON_FILE = "features array<struct<id: string, geometry: struct<type: string, coordinates: array<double>>, properties: struct<class: string, title: string, folderId: string, description: string>>>"
ACCESS_FILE = "trailId string, places map<string, struct<name: string, method: string, reason: string, store: string, junction: array<double>, offTrailKm: double, ascentM: double, descentM: double>>"
DESCRIPTION_FILE = "trailId string, descriptions array<struct<id: string, description: string>>"
ACCESS_MODES = ("foot", "on-trail", "hitch", "shuttle", "boat")


def coordinate(value: Column, most: float) -> Column:
    """A coordinate, or null if it is absent, no number or out of range (SRC03)."""
    x = value.try_cast("double")
    return F.when(x.between(-most, most), x)


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("trail_id", F.element_at(F.split(F.input_file_name(), "/"), -1))


def _places(p: str) -> list[Column]:
    return [
        coordinate(F.col(f"{p}._lat"), 90).alias("lat"), coordinate(F.col(f"{p}._lon"), 180).alias("lon"),
        F.coalesce(F.col(f"{p}.ele").try_cast("double"), F.lit(0.0)).alias("ele"), F.nullif(F.trim(f"{p}.time"), F.lit("")).alias("time"),
    ]


def read_gpx_points(spark: SparkSession, path: str) -> DataFrame:
    """``(trail_id, track, segment, seq, lat, lon, ele, time)`` of tracks; routes stand in for files without any (SRC01, SRC20).

    A missing height is 0, an empty time null; a place out of range has null coordinates, for ``bad_points``.
    """
    tracks = _xml(spark, path, "trk", GPX_TRACK).select("trail_id", F.col("name").alias("track"), F.posexplode("trkseg").alias("segment", "s"))
    tracks = tracks.select("trail_id", "track", "segment", F.posexplode("s.trkpt").alias("seq", "p")).select("trail_id", "track", "segment", "seq", *_places("p"))
    routes = _xml(spark, path, "rte", GPX_ROUTE).select("trail_id", F.col("name").alias("track"), F.lit(0).alias("segment"), F.posexplode("rtept").alias("seq", "p"))
    routes = routes.select("trail_id", "track", "segment", "seq", *_places("p")).join(tracks.select("trail_id").distinct(), "trail_id", "left_anti")
    return tracks.unionByName(routes)


def bad_points(points: DataFrame) -> DataFrame:
    return points.where("lat is null or lon is null")


def read_gpx_waypoints(spark: SparkSession, path: str) -> DataFrame:
    """Waypoints with their access fields; unreadable ones are absent, never a default (SRC01, SRC02)."""
    rows = _xml(spark, path, "wpt", GPX_WAYPOINT)
    ext = lambda n: F.col(f"extensions.`tn:{n}`")
    number = lambda n: F.when(ext(n).try_cast("double") >= 0, ext(n).try_cast("double"))
    return rows.select(
        "trail_id", "name", F.col("desc").alias("description"), F.lower(F.trim("type")).alias("type"), coordinate(F.col("_lat"), 90).alias("lat"), coordinate(F.col("_lon"), 180).alias("lon"),
        F.coalesce(F.col("ele").try_cast("double"), F.lit(0.0)).alias("ele"), number("offTrailKm").alias("off_trail_km"), F.when(ext("accessMode").isin(*ACCESS_MODES), ext("accessMode")).alias("access_mode"),
        ext("acceptsBoxes").try_cast("boolean").alias("accepts_boxes"), ext("store").alias("store"), number("offTrailAscentM").alias("off_trail_ascent_m"), number("offTrailDescentM").alias("off_trail_descent_m"),
    )


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON files of one document each, or of one document a line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_pois(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Places of interest that are whole and not rejected (SRC07, FLT10)."""
    rows = _json(spark, path, POI_FILE, lines).select(F.col("trailId").alias("trail_id"), F.coalesce("rejected", F.array().cast("array<string>")).alias("rejected"), F.explode("pois").alias("p"))
    rows = rows.select("trail_id", "rejected", "p.*").withColumn("key", F.concat_ws("/", "type", F.col("id").cast("string")))
    return rows.where("lat is not null and lon is not null and key rlike '^(node|way|relation)/[0-9]+$' and not array_contains(rejected, key)").drop("rejected")


def read_overpass(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Elements with a place of their own or a centre (SRC10)."""
    e = _json(spark, path, OVERPASS_FILE, lines).select(F.explode("elements").alias("e"))
    rows = e.select("e.type", "e.id", F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"), "e.tags")
    return rows.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")


def read_daily_climate(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(location, day, t_max, t_min, rain)`` from parallel arrays (SRC11)."""
    d = _json(spark, path, CLIMATE_FILE, lines).select("location", F.explode(F.arrays_zip("daily.time", "daily.temperature_2m_max", "daily.temperature_2m_min", "daily.precipitation_sum")).alias("d"))
    return d.select("location", F.to_date("d.time").alias("day"), F.col("d.temperature_2m_max").alias("t_max"), F.col("d.temperature_2m_min").alias("t_min"), F.col("d.precipitation_sum").alias("rain"))


def read_trail_configs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(SRC06)"""
    return _json(spark, path, TRAIL_CONFIG, lines)


def read_markers(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Map markers with the name of their folder (SRC05)."""
    f = _json(spark, path, GEOJSON_FILE, lines).select(F.explode("features").alias("f")).select("f.id", "f.properties.*", F.col("f.geometry.coordinates").alias("c"))
    folders = f.where("class = 'Folder'").select(F.col("id").alias("folderId"), F.col("title").alias("folder"))
    markers = f.where("class = 'Marker'").join(folders, "folderId", "left")
    return markers.select("id", F.trim("title").alias("name"), "folder", "description", F.get("c", F.lit(1)).alias("lat"), F.get("c", F.lit(0)).alias("lon"))


def read_access(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Ways to places, with whether each is complete for its method (SRC08)."""
    p = _json(spark, path, ACCESS_FILE, lines).select(F.col("trailId").alias("trail_id"), F.explode("places").alias("waypoint_id", "p")).select("trail_id", "waypoint_id", "p.*")
    routed = F.col("junction").isNotNull() & (F.size("junction") == 2) & (F.col("offTrailKm") >= 0)
    valid = F.when(F.col("method").isNull(), F.col("store").isNotNull()).when(F.col("method") == "none", F.length(F.trim("reason")) > 0).when(F.col("method").isin("osm", "manual"), routed)
    return p.withColumn("valid", F.coalesce(valid, F.lit(False)))


def read_descriptions(spark: SparkSession, path: str, trail_id: str, most: int = 2000, lines: bool = False) -> DataFrame:
    """Trimmed texts of one trail, each with a reason if it has to be refused (SRC09)."""
    from pyspark.sql import Window

    d = _json(spark, path, DESCRIPTION_FILE, lines).select("trailId", F.explode("descriptions").alias("d")).select("trailId", F.col("d.id").alias("waypoint_id"), F.trim("d.description").alias("description"))
    n = F.count("*").over(Window.partitionBy("waypoint_id"))
    why = F.when(F.col("trailId") != trail_id, "trail").when(F.coalesce("waypoint_id", F.lit("")) == "", "id").when(n > 1, "repeated").when(F.coalesce("description", F.lit("")) == "", "empty").when(F.length("description") > most, "long")
    return d.withColumn("refused", why).drop("trailId")


def read_waypoint_csv(spark: SparkSession, path: str) -> DataFrame:
    """(SRC22)"""
    rows = spark.read.option("header", True).option("escape", '"').schema("name string, lat string, lon string, type string, description string").csv(path)
    rows = rows.withColumn("lat", coordinate(F.col("lat"), 90)).withColumn("lon", coordinate(F.col("lon"), 180))
    return rows.where("name is not null and lat is not null and lon is not null").withColumn("type", F.coalesce("type", F.lit("waypoint")))


def decode_rings(rings: DataFrame, scale: float = 1e5) -> DataFrame:
    """``(region, ring, k, lat, lon)`` from delta-coded integer rings: a running sum in order (SRC18)."""
    from pyspark.sql import Window

    d = rings.select("region", "ring", F.posexplode("deltas").alias("k", "d"))
    w = Window.partitionBy("region", "ring").orderBy("k")
    return d.select("region", "ring", "k", (F.sum(F.get("d", F.lit(0))).over(w) / scale).alias("lat"), (F.sum(F.get("d", F.lit(1))).over(w) / scale).alias("lon"))


def read_handoff(texts: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of untrusted JSON that read by the schema, and those that do not (SRC17, SRC21)."""
    parsed = texts.withColumn("_t", F.from_json(column, f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("_t").isNull() | F.col("_t._corrupt").isNotNull()
    return parsed.where(~bad).select("_t.*").drop("_corrupt"), parsed.where(bad).drop("_t")


def sample_grid(places: DataFrame, cells: DataFrame, step: float) -> DataFrame:
    """Adds ``ele`` to places ``(place_id, lat, lon)``: heights drawn between the four cells around them (SRC12).

    ``cells`` are ``(y, x, ele)`` of a raster with ``step`` degrees between its rows and columns; where one of the four is
    missing or has no height, the place has none. A place goes to four keys, so this is one equi-join.
    """
    y, x = F.col("lat") / step, F.col("lon") / step
    corner = F.explode(F.array(*(F.struct((F.floor(y) + i).alias("y"), (F.floor(x) + j).alias("x"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    rows = places.select("place_id", (y - F.floor(y)).alias("fy"), (x - F.floor(x)).alias("fx"), corner.alias("c")).select("place_id", "fy", "fx", "c.*")
    share = F.when(F.col("i") == 1, F.col("fy")).otherwise(1 - F.col("fy")) * F.when(F.col("j") == 1, F.col("fx")).otherwise(1 - F.col("fx"))
    met = rows.join(cells.where("ele is not null"), ["y", "x"]).groupBy("place_id").agg(F.sum(share * F.col("ele")).alias("ele"), F.count("*").alias("n")).where("n = 4")
    return places.join(met.select("place_id", "ele"), "place_id", "left")
