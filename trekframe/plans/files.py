"""Queries that write the driver's rows as the planner's files into the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.functions.rounding import js_round
from trekframe.operators import track
from trekframe.plans.pois import places
from trekframe.plans.registry import register
from trekframe.plans.tables import CUST, PTS, cust, pts, rnd, table
from trekframe.plans.tracks import DIST, measured
from trekframe.sources import files, sinks
from trekframe.storage import materialize, scratch_path


def _written(docs: DataFrame, column: str, label: str) -> str:
    """The folder that the documents of a column were written to: one a line, or one a file for GPX."""
    path = scratch_path(docs.sparkSession, label)
    docs.select(F.col(column).alias("value")).write.option("maxRecordsPerFile", 1 if label == "gpx" else 0).text(path)
    return path


def _tracks(spark, sf_dir):
    return pts(spark, sf_dir).select("trail_id", F.concat(F.lit("trail "), "trail_id").alias("track"), "idx", "lat", "lon", F.floor("ele").cast("double").alias("ele"))


@register("src01_gpx_tracks", f"WITH {PTS} SELECT 'trail ' || trail_id AS track, CAST(idx AS INT) AS seq, lat, lon, floor(ele) AS ele FROM pts")
def src01(spark, sf_dir):
    """Tracks written as GPX and read back (SRC01, SRC19, SRC20, SNK01)."""
    back = files.read_gpx_points(spark, _written(sinks.gpx_documents(_tracks(spark, sf_dir)), "gpx", "gpx"))
    return back.select("track", "seq", js_round("lat", 6).alias("lat"), js_round("lon", 6).alias("lon"), "ele")




def _waypoints(spark, sf_dir):
    k = F.col("place_id")
    return cust(spark, sf_dir).select(
        (k % 20).alias("trail_id"), k.alias("seq"), F.concat("c_name", F.lit(" & <co>")).alias("name"), F.col("c_mktsegment").alias("type"), "lat", "lon",
        F.when(k % 3 > 0, k % 3 * 1.5).alias("off_trail_km"), F.when(k % 4 == 0, "foot").when(k % 4 == 1, "rocket").alias("access_mode"),
    )


@register(
    "src02_gpx_waypoints",
    f"""WITH {CUST} SELECT c_name || ' & <co>' AS name, lower(c_mktsegment) AS type, {rnd('lat', 6)} AS lat, {rnd('lon', 6)} AS lon, CAST(CASE WHEN place_id % 3 > 0 THEN place_id % 3 * 1.5 END AS DOUBLE) AS off_trail_km, CASE WHEN place_id % 4 = 0 THEN 'foot' END AS access_mode FROM cust""",
)
def src02(spark, sf_dir):
    """Waypoints with access fields as extensions; a mode that does not exist is absent (SRC02, SNK04)."""
    w = _waypoints(spark, sf_dir)
    line = w.groupBy("trail_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")).select("trail_id", F.lit("t").alias("track"), F.lit(0).alias("idx"), "lat", "lon", F.lit(0.0).alias("ele"))
    back = files.read_gpx_waypoints(spark, _written(sinks.gpx_documents(line, w), "gpx", "gpx"))
    return back.select("name", "type", js_round("lat", 6).alias("lat"), js_round("lon", 6).alias("lon"), "off_trail_km", "access_mode")


@register("src03_coordinates", "SELECT event_id, CASE WHEN event_id % 5 < 3 AND event_id % 300 - 150 BETWEEN -90 AND 90 THEN event_id % 300 - 150.0 END AS lat FROM events")
def src03(spark, sf_dir):
    k = F.col("event_id")
    raw = F.when(k % 5 < 3, (k % 300 - 150).cast("string")).when(k % 5 == 3, "north")
    return table(spark, sf_dir, "events").select("event_id", files.coordinate(raw, 90).alias("lat"))


@register("src05_map_markers", f"WITH {CUST} SELECT CAST(place_id AS VARCHAR) AS id, c_name AS name, CASE WHEN place_id % 6 > 0 THEN 'Folder ' || place_id % 6 END AS folder, lat, lon FROM cust")
def src05(spark, sf_dir):
    """Markers of a map file with the names of their folders; one folder is missing."""
    k = F.col("place_id")
    point = lambda lon, lat: F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    marker = F.struct(k.cast("string").alias("id"), point(F.col("lon"), F.col("lat")).alias("geometry"), F.struct(F.lit("Marker").alias("class"), F.concat(F.lit(" "), "c_name").alias("title"), F.concat(F.lit("f"), k % 6).alias("folderId")).alias("properties"))
    docs = cust(spark, sf_dir).groupBy((k % 40).alias("doc")).agg(F.collect_list(marker).alias("features"))
    folders = spark.range(1, 6).select(F.struct(F.concat(F.lit("f"), "id").alias("id"), F.struct(F.lit("Folder").alias("class"), F.concat(F.lit("Folder "), "id").alias("title")).alias("properties")).alias("f")).agg(F.collect_list("f").alias("features"))
    lines = docs.select(F.to_json(F.struct("features")).alias("d")).unionByName(folders.select(F.to_json(F.struct("features")).alias("d")))
    return files.read_markers(spark, _written(lines, "d", "map"), lines=True).select("id", "name", "folder", "lat", "lon")


@register("src06_trail_configs", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS region, c_acctbal AS \"lengthKm\", 's' || c_nationkey AS state FROM customer")
def src06(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    doc = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("region"), F.array(F.concat(F.lit("s"), "c_nationkey")).alias("states"), F.col("c_acctbal").alias("lengthKm")))
    back = files.read_trail_configs(spark, _written(c.select(doc.alias("d")), "d", "config"), lines=True)
    return back.select("id", "name", "region", "lengthKm", F.col("states")[0].alias("state"))


@register(
    "src07_poi_files",
    f"WITH {CUST} SELECT 't' || place_id % 30 AS trail_id, CASE WHEN place_id % 7 = 0 THEN 'node' ELSE 'way' END || '/' || place_id AS key, lat, c_name AS shop FROM cust WHERE place_id % 5 > 0 AND place_id % 11 > 0",
)
def src07(spark, sf_dir):
    """Places of interest without those rejected or without a place (SRC07, FLT10)."""
    k = F.col("place_id")
    kind = F.when(k % 7 == 0, "node").otherwise("way")
    poi = F.struct(k.alias("id"), kind.alias("type"), F.when(k % 11 > 0, F.col("lat")).alias("lat"), "lon", F.create_map(F.lit("shop"), F.col("c_name")).alias("tags"))
    docs = cust(spark, sf_dir).groupBy((k % 30).alias("t")).agg(F.collect_list(poi).alias("pois"), F.collect_list(F.when(k % 5 == 0, F.concat_ws("/", kind, k))).alias("rejected"))
    doc = F.to_json(F.struct(F.concat(F.lit("t"), "t").alias("trailId"), "pois", "rejected"))
    back = files.read_pois(spark, _written(docs.select(doc.alias("d")), "d", "pois"), lines=True)
    return back.select("trail_id", "key", "lat", F.col("tags")["shop"].alias("shop"))


@register(
    "src08_access_files",
    "SELECT 't' || c_custkey % 30 AS trail_id, 'w' || c_custkey AS waypoint_id, CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN c_custkey % 3 > 0 WHEN 2 THEN c_acctbal >= 0 ELSE true END AS valid FROM customer",
)
def src08(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    method = F.when(k % 4 == 1, "none").when(k % 4 == 2, "osm")
    place = F.struct(method.alias("method"), F.when(k % 3 > 0, "far").otherwise(" ").alias("reason"), F.when(k % 4 == 3, "store").otherwise(none).alias("store"), F.when(k % 4 == 2, F.array(F.lit(1.0), F.lit(2.0))).alias("junction"), F.col("c_acctbal").alias("offTrailKm"))
    docs = table(spark, sf_dir, "customer").groupBy((k % 30).alias("t")).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("w"), k), place))).alias("places"))
    doc = F.to_json(F.struct(F.concat(F.lit("t"), "t").alias("trailId"), "places"))
    return files.read_access(spark, _written(docs.select(doc.alias("d")), "d", "access"), lines=True).select("trail_id", "waypoint_id", "valid")


@register(
    "src09_description_files",
    """WITH d AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 30 = 4 THEN 'other' ELSE 't' END AS trail, CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 17 = 0 THEN 'twice' ELSE 'w' || c_custkey END AS id, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 2001) ELSE c_name END AS t FROM customer)
SELECT id AS waypoint_id, t AS description, CASE WHEN trail <> 't' THEN 'trail' WHEN id = '' THEN 'id' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated' WHEN t = '' THEN 'empty' WHEN length(t) > 2000 THEN 'long' END AS refused FROM d""",
)
def src09(spark, sf_dir):
    k = F.col("c_custkey")
    wid = F.when(k % 13 == 0, "").when(k % 17 == 0, "twice").otherwise(F.concat(F.lit("w"), k))
    said = F.when(k % 5 == 0, "  ").when(k % 5 == 1, F.repeat(F.lit("x"), 2001)).otherwise(F.concat(F.lit(" "), "c_name"))
    docs = table(spark, sf_dir, "customer").groupBy((k % 30).alias("t")).agg(F.collect_list(F.struct(wid.alias("id"), said.alias("description"))).alias("descriptions"))
    doc = F.to_json(F.struct(F.when(F.col("t") == 4, "other").otherwise("t").alias("trailId"), "descriptions"))
    return files.read_descriptions(spark, _written(docs.select(doc.alias("d")), "d", "said"), "t", lines=True)


@register("src10_overpass_elements", f"WITH {CUST} SELECT place_id AS id, CASE WHEN place_id % 2 = 0 THEN 'node' ELSE 'way' END AS type, lat, lon FROM cust WHERE place_id % 9 > 0")
def src10(spark, sf_dir):
    k = F.col("place_id")
    own = lambda c: F.when((k % 2 == 0) & (k % 9 > 0), F.col(c)).alias(c)
    element = F.struct(F.when(k % 2 == 0, "node").otherwise("way").alias("type"), k.alias("id"), own("lat"), own("lon"), F.when((k % 2 == 1) & (k % 9 > 0), F.struct("lat", "lon")).alias("center"))
    docs = cust(spark, sf_dir).groupBy((k % 25).alias("t")).agg(F.collect_list(element).alias("elements"))
    return files.read_overpass(spark, _written(docs.select(F.to_json("elements").alias("x"), F.to_json(F.struct("elements")).alias("d")), "d", "osm"), lines=True).select("id", "type", "lat", "lon")


@register("src11_daily_climate", "SELECT 'u' || user_id AS location, DATE '2020-01-01' + CAST(event_id % 900 AS INT) AS day, value AS t_max, value - 7 AS t_min, CASE WHEN event_id % 4 > 0 THEN value / 8 END AS rain FROM events")
def src11(spark, sf_dir):
    k, v = F.col("event_id"), F.col("value")
    row = F.struct(F.date_add(F.lit("2020-01-01").cast("date"), (k % 900).cast("int")).cast("string").alias("t"), v.alias("hi"), (v - 7).alias("lo"), F.when(k % 4 > 0, v / 8).alias("rain"))
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(row).alias("r"))
    daily = F.struct(F.col("r.t").alias("time"), F.col("r.hi").alias("temperature_2m_max"), F.col("r.lo").alias("temperature_2m_min"), F.col("r.rain").alias("precipitation_sum"))
    doc = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("location"), daily.alias("daily")), {"ignoreNullFields": "false"})
    return files.read_daily_climate(spark, _written(docs.select(doc.alias("d")), "d", "climate"), lines=True)


@register(
    "src12_sampled_raster",
    f"""WITH {CUST}, p AS (SELECT place_id, lat / 0.5 AS y, lon / 0.5 AS x FROM cust), g AS (SELECT place_id, y - floor(y) AS fy, x - floor(x) AS fx, CAST(floor(y) AS BIGINT) AS y, CAST(floor(x) AS BIGINT) AS x FROM p)
SELECT place_id, CASE WHEN NOT list_contains(list_transform([[0, 0], [0, 1], [1, 0], [1, 1]], lambda c: (((y + c[1]) * 7 + (x + c[2]) * 3) % 23 + 23) % 23 = 5), true) THEN
{rnd('(1 - fy) * (1 - fx) * ((y * y + x * 2) % 97) + (1 - fy) * fx * ((y * y + (x + 1) * 2) % 97) + fy * (1 - fx) * (((y + 1) * (y + 1) + x * 2) % 97) + fy * fx * (((y + 1) * (y + 1) + (x + 1) * 2) % 97)', 4)} END AS ele FROM g""",
)
def src12(spark, sf_dir):
    """Heights of places from a raster with holes, drawn between four cells."""
    y = spark.range(-90, 0).withColumnRenamed("id", "y").withColumn("x", F.explode(F.sequence(F.lit(270).cast("long"), F.lit(320).cast("long"))))
    hole = F.pmod(F.col("y") * 7 + F.col("x") * 3, F.lit(23)) == 5
    cells = y.select("y", "x", F.when(~hole, ((F.col("y") * F.col("y") + F.col("x") * 2) % 97).cast("double")).alias("ele"))
    return files.sample_grid(cust(spark, sf_dir).select("place_id", "lat", "lon"), cells, 0.5).select("place_id", js_round("ele", 4).alias("ele"))


@register("src16_bound_parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 150000.5 AND o_orderdate < TIMESTAMP '1997-06-01'")
def src16(spark, sf_dir):
    """A statement with named parameters over a table."""
    import datetime

    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_orderstatus = :status AND o_totalprice > :least AND o_orderdate < :until", args={"status": "O", "least": 150000.5, "until": datetime.datetime(1997, 6, 1)}, orders=table(spark, sf_dir, "orders"))


_GOOD = "good AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS km FROM orders WHERE o_orderkey % 5 > 0)"


def _handoffs(spark, sf_dir):
    k = F.col("o_orderkey")
    fine = F.to_json(F.struct(k.alias("id"), F.when(k % 6 > 0, F.col("o_totalprice")).alias("km")))
    broken = F.when(k % 10 == 0, F.concat(F.lit('{"id": '), k, F.lit(', "km": "far"}'))).otherwise(F.concat(F.lit('{"id": '), k))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 5 > 0, fine).otherwise(broken).alias("text"))


@register("src17_handoff_rows", f"WITH {_GOOD} SELECT * FROM good")
def src17(spark, sf_dir):
    return files.read_handoff(_handoffs(spark, sf_dir), "text", "id long, km double")[0].select("id", "km")


@register("src21_refused_handoffs", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 = 0")
def src21(spark, sf_dir):
    return files.read_handoff(_handoffs(spark, sf_dir), "text", "id long, km double")[1].select("k")


@register(
    "src18_region_rings",
    f"WITH d AS (SELECT c_nationkey AS region, CAST(row_number() OVER w - 1 AS INT) AS k, c_custkey % 40 - 20 AS a, c_custkey % 30 - 15 AS b FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)) SELECT region, k, {rnd('sum(a) OVER w / 1e5', 7)} AS lat, {rnd('sum(b) OVER w / 1e5', 7)} AS lon FROM d WINDOW w AS (PARTITION BY region ORDER BY k)",
)
def src18(spark, sf_dir):
    k = F.col("c_custkey")
    steps = F.array_sort(F.collect_list(F.struct(k.alias("k"), F.array(k % 40 - 20, k % 30 - 15).alias("d"))))
    rings = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("region")).agg(F.transform(steps, lambda s: s["d"]).alias("deltas")).withColumn("ring", F.lit(0))
    return files.decode_rings(rings).select("region", "k", js_round("lat", 7).alias("lat"), js_round("lon", 7).alias("lon"))


@register("src22_csv_waypoints", f"WITH {CUST} SELECT c_name || ', \"the\" one' AS name, lat, lon, CASE WHEN place_id % 4 = 0 THEN 'waypoint' ELSE c_mktsegment END AS type FROM cust WHERE place_id % 6 > 0")
def src22(spark, sf_dir):
    """Waypoints in CSV with quotes in their names; rows without a place go, a missing type is 'waypoint' (SRC22, SNK03)."""
    k = F.col("place_id")
    rows = cust(spark, sf_dir).select(F.concat("c_name", F.lit(', "the" one')).alias("name"), F.when(k % 6 > 0, F.col("lat").cast("string")).otherwise("?").alias("lat"), "lon", F.when(k % 4 > 0, F.col("c_mktsegment")).alias("type"), F.lit("a").alias("description"))
    path = scratch_path(spark, "csv")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return files.read_waypoint_csv(spark, path).select("name", "lat", "lon", "type")


@register("snk02_simplified_gpx", f"WITH {PTS} SELECT 'trail ' || trail_id AS track, count(*) AS n, min(lat) AS south, max(lat) AS north FROM pts WHERE idx % 2 = 0 GROUP BY trail_id")
def snk02(spark, sf_dir):
    """Thinned tracks written as GPX and read back."""
    back = files.read_gpx_points(spark, _written(sinks.gpx_documents(_tracks(spark, sf_dir).where("idx % 2 = 0")), "gpx", "gpx"))
    return back.groupBy("track").agg(F.count("*").alias("n"), js_round(F.min("lat"), 6).alias("south"), js_round(F.max("lat"), 6).alias("north"))


def _num(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


_TRKPT = f"""'<trkpt lat="' || {_num('lat')} || '" lon="' || {_num('lon')} || '"><ele>' || {_num('ele')} || '</ele></trkpt>'"""


@register(
    "snk04_page_gpx",
    f"""WITH {DIST}, s AS (SELECT *, sum(CAST(is_break AND idx > 0 AS INT)) OVER (PARTITION BY trail_id ORDER BY idx) AS stretch FROM m),
seg AS (SELECT trail_id, stretch, string_agg({_TRKPT}, '' ORDER BY idx) AS body FROM s GROUP BY trail_id, stretch), line AS (SELECT trail_id, string_agg('<trkseg>' || body || '</trkseg>', '' ORDER BY stretch) AS line FROM seg GROUP BY trail_id),
w AS (SELECT trail_id, string_agg('<wpt lat="' || {_num('lat')} || '" lon="' || {_num('lon')} || '">' || CASE WHEN idx % 4 = 0 THEN '' ELSE '<ele>' || {_num('ele')} || '</ele>' END || '<name>' || CASE WHEN idx % 3 = 0 THEN 'Waypoint' ELSE 'Food &amp; ' || event_id END || '</name>' || CASE WHEN idx % 5 = 0 THEN '' ELSE '<type>purchase</type>' END || '</wpt>', '' ORDER BY CAST(idx % 4 = 0 AS INT), idx) AS marks FROM m WHERE event_type = 'purchase' GROUP BY trail_id),
v AS (SELECT trail_id, idx // 10 AS seq, string_agg({_TRKPT}, '' ORDER BY idx) AS body FROM (SELECT trail_id, idx, lat + 0.001 AS lat, lon, ele FROM m WHERE (idx // 10) % 2 = 1) x GROUP BY ALL),
o AS (SELECT trail_id, string_agg('<trk><name>' || CASE WHEN seq % 4 = 3 THEN 'Unnamed' ELSE 'variant ' || seq END || '</name><type>' || CASE WHEN seq % 3 = 0 THEN 'side-trip' ELSE 'alternate' END || '</type><trkseg>' || body || '</trkseg></trk>', '' ORDER BY seq) AS others FROM v GROUP BY trail_id),
t AS (SELECT trail_id, max(dist) AS km FROM m GROUP BY trail_id)
SELECT trail_id, octet_length(encode(gpx)) AS bytes, md5(gpx) AS md5 FROM (SELECT trail_id, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="trekframe" xmlns="http://www.topografix.com/GPX/1/1"><metadata><name>trail ' || trail_id || '</name><desc>north &lt;' || trail_id % 5 || '&gt; - ' || printf('%.1f', km) || ' km</desc></metadata>' ||
  coalesce(marks, '') || '<trk><name>trail ' || trail_id || '</name>' || line || '</trk>' || coalesce(others, '') || '</gpx>' AS gpx FROM t JOIN line USING (trail_id) LEFT JOIN w USING (trail_id) LEFT JOIN o USING (trail_id)) d""",
)
def snk04(spark, sf_dir):
    """Every trail's page, with its stretches, waypoints and variants, by length and digest."""
    m = measured(spark, sf_dir)
    k, idx = F.col("trail_id"), F.col("idx")
    trails = m.groupBy("trail_id").agg(F.max("dist").alias("km")).select("trail_id", F.concat(F.lit("trail "), k).alias("name"), F.concat(F.lit("north <"), k % 5, F.lit(">")).alias("region"), "km")
    marks = m.where("event_type = 'purchase'").select(
        "trail_id", idx.alias("seq"), (idx % 4 == 0).alias("off_trail"), "lat", "lon", "ele", F.when(idx % 3 > 0, F.concat(F.lit("Food & "), "event_id")).alias("name"),
        F.when(idx % 5 > 0, F.col("event_type")).alias("type"), F.lit(None).cast("string").alias("description"),
    )
    seq = F.floor(idx / 10)
    variants = m.where(seq % 2 == 1).select(
        "trail_id", seq.alias("seq"), F.when(seq % 4 != 3, F.concat(F.lit("variant "), seq)).alias("name"), F.when(seq % 3 == 0, "side-trip").otherwise("alternate").alias("type"),
        "idx", (F.col("lat") + 0.001).alias("lat"), "lon", "ele",
    )
    pages = sinks.trail_page_gpx(trails, track.split_at_breaks(m), marks, variants)
    return pages.select("trail_id", F.octet_length("gpx").cast("long").alias("bytes"), F.md5("gpx").alias("md5"))


@register("snk03_csv_lines", """SELECT p_partkey || ',"a ""' || p_name || '"", b",' || p_size || ',' AS value FROM part""")
def snk03(spark, sf_dir):
    said = F.concat(F.lit('a "'), "p_name", F.lit('", b'))
    return sinks.csv_lines(table(spark, sf_dir, "part").select("p_partkey", said.alias("s"), "p_size", F.lit(None).cast("string").alias("none")))


_DOC = "trail_id long, points array<struct<idx: long, lat: double, lon: double, ele: double, dist: double, cum_ascent: double>>, waypoints array<struct<seq: long, name: string, km: double>>"


def _marks(spark, sf_dir):
    return pts(spark, sf_dir).where("event_type = 'purchase'").select("trail_id", F.col("idx").alias("seq"), F.col("event_type").alias("name"), "km")


@register(
    "snk05_trail_json",
    f"WITH {DIST} SELECT trail_id, count(*) AS points, count(*) FILTER (WHERE event_type = 'purchase') AS waypoints, {rnd('max(dist)', 4)} AS km, {rnd('max(cum_ascent)', 3)} AS ascent, arg_max(ele, idx) AS last_ele FROM m GROUP BY trail_id",
)
def snk05(spark, sf_dir):
    """Built trails written as JSON, one a line, and read back (SNK05, SNK10)."""
    path = _written(sinks.trail_documents(measured(spark, sf_dir), _marks(spark, sf_dir)), "doc", "trails")
    back = spark.read.schema(_DOC).json(path)
    top = lambda name: F.array_max(F.transform("points", lambda p: p[name]))
    return back.select("trail_id", F.size("points").cast("long").alias("points"), F.size("waypoints").cast("long").alias("waypoints"), js_round(top("dist"), 4).alias("km"), js_round(top("cum_ascent"), 3).alias("ascent"), F.element_at("points", -1)["ele"].alias("last_ele"))


_POINT = "lat: double, lon: double, ele: double"
_MOBILE = f"""trail_id long, name string, dist double, cum_ascent double, cum_descent double, points array<struct<idx: long, {_POINT}, dist: double, cum_ascent: double, cum_descent: double>>, breaks array<long>,
waypoints array<struct<seq: long, name: string, {_POINT}, km: double>>, variants array<struct<seq: long, name: string, type: string, points: array<struct<idx: long, {_POINT}>>>>,
pois array<struct<place_id: long, name: string, lat: double, lon: double, along: double, tags: string>>"""


@register("snk06_mobile_json")
def snk06(spark, sf_dir):
    """Every trail thinned to about 20 points by its stretches, variants to 6, with waypoints and places; see the tests."""
    m = track.split_at_breaks(measured(spark, sf_dir))
    trails = m.select("trail_id").distinct().select("trail_id", F.concat(F.lit("trail "), "trail_id").alias("name"), (F.col("trail_id") % 5 > 0).alias("enriched"))
    marks = m.where("event_type = 'purchase'").select("trail_id", F.col("idx").alias("seq"), F.col("event_type").alias("name"), "lat", "lon", "ele", "km")
    seq = F.floor(F.col("idx") / 10)
    variants = m.where(seq % 2 == 1).select("trail_id", seq.alias("seq"), F.concat(F.lit("variant "), seq).alias("name"), F.lit("alternate").alias("type"), "idx", (F.col("lat") + 0.001).alias("lat"), "lon", "ele")
    spots = places(spark, sf_dir).where("user_id % 3 > 0").select(F.col("user_id").alias("trail_id"), F.col("event_id").alias("place_id"), F.lit("spot").alias("name"), F.col("value").alias("lat"), F.col("value").alias("lon"), (F.col("value") / 3).alias("along"), "tags")
    docs = sinks.mobile_documents(trails, m, marks, variants, spots, target=20, variant_target=6)
    back = docs.select(F.from_json("doc", _MOBILE).alias("d")).select("d.*")
    return back.select(
        "trail_id", F.array_join(F.transform("points", lambda p: p["idx"]), ",").alias("points"), F.array_join("breaks", ",").alias("breaks"), "dist", "cum_ascent", "cum_descent", F.element_at("points", -1)["cum_ascent"].alias("last_ascent"),
        F.size("waypoints").alias("waypoints"), F.array_join(F.transform("variants", lambda v: F.array_join(F.transform(v["points"], lambda p: p["idx"]), ",")), ";").alias("variants"),
        F.when(F.col("pois").isNotNull(), F.size("pois")).alias("pois"), F.aggregate(F.coalesce("pois", F.array().cast("array<struct<place_id: long, name: string, lat: double, lon: double, along: double, tags: string>>")), F.lit(0.0), lambda a, p: a + p["along"]).alias("along"),
    )


@register(
    "snk07_poi_files",
    """WITH p AS (SELECT o_custkey AS trail_id, string_agg('node/' || o_orderkey, ',' ORDER BY o_totalprice, 'node/' || o_orderkey) AS pois FROM orders GROUP BY o_custkey), e AS (SELECT c_custkey AS trail_id, CASE WHEN c_custkey % 2 = 0 THEN 'node/1' ELSE '' END AS rejected, 'w' || c_custkey AS dup FROM customer WHERE c_custkey % 3 > 0)
SELECT trail_id, coalesce(pois, '') AS pois, coalesce(rejected, '') AS rejected, dup FROM p FULL JOIN e USING (trail_id)""",
)
def snk07(spark, sf_dir):
    k = F.col("c_custkey")
    existing = table(spark, sf_dir, "customer").where(k % 3 > 0).select(k.alias("trail_id"), F.when(k % 2 == 0, F.array(F.lit("node/1"))).otherwise(F.array().cast("array<string>")).alias("rejected"), F.create_map(F.lit("way/2"), F.concat(F.lit("w"), k)).alias("duplicates"))
    pois = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trail_id"), F.col("o_totalprice").alias("km"), F.concat(F.lit("node/"), "o_orderkey").alias("key"))
    out = sinks.poi_file(existing, pois)
    return out.select("trail_id", F.array_join("pois", ",").alias("pois"), F.array_join("rejected", ",").alias("rejected"), F.try_element_at("duplicates", F.lit("way/2")).alias("dup"))


@register("snk08_tile_rows", "SELECT 6 AS z, x, 63 - y AS y, arg_max(event_id, event_id) AS data FROM (SELECT event_id % 40 AS x, user_id % 60 AS y, event_id FROM events) t GROUP BY x, y")
def snk08(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return sinks.tile_rows(e.select(F.lit(6).alias("z"), (F.col("event_id") % 40).alias("x"), (F.col("user_id") % 60).alias("y"), F.col("event_id").alias("seq"), F.col("event_id").alias("data")))


@register("snk09_catalog", "SELECT 'doc' || p_partkey AS id, md5(p_name) AS md5, octet_length(encode(p_name)) AS bytes, 'doc' || p_partkey || '/' || md5(p_name) AS key FROM part")
def snk09(spark, sf_dir):
    """Contents written, then their catalog, which is what readers go by."""
    content = table(spark, sf_dir, "part").select(F.concat(F.lit("doc"), "p_partkey").alias("id"), F.col("p_name").alias("content"))
    return sinks.publish(content, scratch_path(spark, "catalog")).select("id", "md5", F.col("bytes").cast("long").alias("bytes"), "key")


@register("snk10_handoff", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def snk10(spark, sf_dir):
    """Rows as JSON handed over in one column, and taken back by schema."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    lines = materialize(rows.select(F.to_json(F.struct("*")).alias("text")), "handoff")
    return files.read_handoff(lines, "text", "c_custkey long, c_name string, c_acctbal double")[0]


@register("snk13_registry", "SELECT o_custkey AS trail_id, '[' || string_agg('\"w' || o_orderkey || '\"', ',' ORDER BY 'w' || o_orderkey) || ']' AS line FROM orders GROUP BY o_custkey")
def snk13(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trail_id"), F.concat(F.lit("w"), "o_orderkey").alias("id"))
    return sinks.registry_lines(ids.unionByName(ids))


_FEATURE = "geometry struct<type: string, coordinates: array<double>>, properties struct<name: string, type: string, favourite: boolean, planned: boolean>"


@register("snk15_waypoint_features", f"WITH {CUST} SELECT c_name AS name, lon, lat, place_id % 3 = 0 AS favourite, place_id % 4 = 0 AS planned FROM cust")
def snk15(spark, sf_dir):
    k = F.col("place_id")
    w = cust(spark, sf_dir)
    marks = w.where(k % 3 == 0).select("place_id", F.lit(True).alias("f")).join(w.where(k % 4 == 0).select("place_id", F.lit(True).alias("p")), "place_id", "full_outer")
    rows = w.join(marks, "place_id", "left").select("lat", "lon", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.coalesce("f", F.lit(False)).alias("favourite"), F.coalesce("p", F.lit(False)).alias("planned"))
    back = sinks.point_features(rows, ["name", "type", "favourite", "planned"]).select(F.from_json("value", _FEATURE).alias("f"))
    return back.select("f.properties.name", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.favourite", "f.properties.planned")


@register("snk16_poi_features", f"WITH {CUST} SELECT 'Point' AS type, 'node/' || place_id AS key, lat FROM cust")
def snk16(spark, sf_dir):
    rows = cust(spark, sf_dir).select("lat", "lon", F.concat(F.lit("node/"), "place_id").alias("key"))
    back = sinks.point_features(rows, ["key"]).select(F.from_json("value", "geometry struct<type: string, coordinates: array<double>>, properties struct<key: string>").alias("f"))
    return back.select("f.geometry.type", "f.properties.key", F.col("f.geometry.coordinates")[1].alias("lat"))
