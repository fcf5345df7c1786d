"""Queries on places: nearest, radius, regions, linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.functions import geo
from trekframe.functions.rounding import js_round
from trekframe.operators import linkage, spatial
from trekframe.plans.registry import register
from trekframe.plans.tables import CUST, PTS, SUPP, cust, hav, pts, rnd, supp, table

_D = hav("c.lat", "c.lon", "s.lat", "s.lon")


@register("jon12_nearest_within", f"WITH {CUST}, {SUPP}, d AS (SELECT place_id, spot_id, {_D} AS m FROM cust c, supp s WHERE {_D} <= 60000), b AS (SELECT place_id, min({{'m': m, 'i': spot_id}}) AS b FROM d GROUP BY place_id) SELECT place_id, b.i AS spot_id, {rnd('b.m', 2)} AS metres FROM b")
def jon12(spark, sf_dir):
    return spatial.nearest_within(cust(spark, sf_dir), supp(spark, sf_dir), "place_id", "spot_id", 60_000).withColumn("metres", js_round("metres", 2))


@register("jon17_nearest_place", f"WITH {CUST}, {SUPP}, d AS (SELECT place_id, spot_id, {_D} AS m FROM cust c, supp s), b AS (SELECT place_id, min({{'m': m, 'i': spot_id}}) AS b FROM d GROUP BY place_id) SELECT place_id, b.i AS spot_id, {rnd('b.m', 2)} AS metres FROM b")
def jon17(spark, sf_dir):
    return spatial.nearest_place(cust(spark, sf_dir), supp(spark, sf_dir), "place_id", "spot_id", 40_000).withColumn("metres", js_round("metres", 2))


@register("jon18_radius_pairs", f"WITH {CUST}, {SUPP} SELECT place_id, spot_id, {rnd(_D, 2)} AS metres FROM cust c, supp s WHERE {_D} <= 30000")
def jon18(spark, sf_dir):
    met = spatial.radius_pairs(cust(spark, sf_dir), supp(spark, sf_dir), 30_000)
    return met.select("place_id", "spot_id", js_round("metres", 2).alias("metres"))


@register("jon19_near_rows", f"WITH {CUST}, {SUPP} SELECT place_id FROM cust c WHERE EXISTS (SELECT 1 FROM supp s WHERE {_D} < 25000)")
def jon19(spark, sf_dir):
    return spatial.near_rows(cust(spark, sf_dir), supp(spark, sf_dir), "place_id", 25_000).select("place_id")


_T = "least(1.0, greatest(0.0, ((c.lon - lon1) * cos(radians(lat1)) * (lon2 - lon1) * cos(radians(lat1)) + (c.lat - lat1) * (lat2 - lat1)) / nullif(pow((lon2 - lon1) * cos(radians(lat1)), 2) + pow(lat2 - lat1, 2), 0)))"


_PLANE_T = "least(1.0, greatest(0.0, -(ax * dx + ay * dy) / nullif(dx * dx + dy * dy, 0)))"
_K = "(111320.0 * cos(radians(p.lat)))"


def _nation_routes(spark, sf_dir):
    """All suppliers as points of one trail a nation, with breaks."""
    from pyspark.sql import Window

    from trekframe.operators.track import cumulative_km

    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot_id"), F.col("s_nationkey").alias("trail_id"))
    rows = supp(spark, sf_dir).join(nation, "spot_id")
    rows = rows.withColumn("idx", (F.row_number().over(Window.partitionBy("trail_id").orderBy("lon", "spot_id")) - 1).cast("long"))
    return cumulative_km(rows.withColumn("is_break", F.col("idx") % 7 == 3))


@register(
    "jon44_distance_to_line",
    f"""WITH {CUST}, {SUPP}, route AS (SELECT s_nationkey AS trail_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY lon, spot_id) - 1 AS BIGINT) AS idx, lat, lon FROM supp JOIN supplier ON s_suppkey = spot_id),
g AS (SELECT trail_id, idx, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM route WINDOW w AS (PARTITION BY trail_id ORDER BY idx)),
t AS (SELECT place_id, c.lat, c.lon, g.*, coalesce({_T}, 0.0) AS t FROM cust c, g WHERE lat2 IS NOT NULL AND idx % 7 <> 2), d AS (SELECT place_id, lat, lon, trail_id, idx, t, {hav('lat', 'lon', 'lat1 + (lat2 - lat1) * t', 'lon1 + (lon2 - lon1) * t')} AS m FROM t),
p AS (SELECT place_id, lat, lon, b.m AS m, b.t AS trail_id, b.i + b.f AS idx FROM (SELECT place_id, any_value(lat) AS lat, any_value(lon) AS lon, min({{'m': m, 't': trail_id, 'i': idx, 'f': CASE WHEN t >= 1 THEN 1 ELSE 0 END}}) AS b FROM d WHERE m <= 20000 GROUP BY place_id) x),
v AS (SELECT place_id, (lon1 - p.lon) * {_K} AS ax, (lat1 - p.lat) * 111320.0 AS ay, (lon2 - lon1) * {_K} AS dx, (lat2 - lat1) * 111320.0 AS dy FROM p JOIN g ON g.trail_id = p.trail_id AND g.idx BETWEEN p.idx - 2 AND p.idx + 1 WHERE lat2 IS NOT NULL),
l AS (SELECT place_id, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS line FROM (SELECT *, coalesce({_PLANE_T}, 0.0) AS t FROM v) y GROUP BY place_id)
SELECT place_id, trail_id, idx, {rnd('m', 2)} AS metres, {rnd('least(m, line)', 2)} AS line_m FROM p JOIN l USING (place_id)""",
)
def jon44(spark, sf_dir):
    """Customers against the routes of all suppliers, breaks included: the snap, and the second measure around it."""
    out = spatial.distance_to_line(cust(spark, sf_dir), _nation_routes(spark, sf_dir), 20_000)
    return out.select("place_id", "trail_id", "idx", js_round("metres", 2).alias("metres"), js_round("line_m", 2).alias("line_m"))


@register(
    "jon14_snap_to_track",
    f"""WITH {CUST}, {SUPP}, route AS (SELECT s_nationkey AS trail_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY lon, spot_id) - 1 AS BIGINT) AS idx, lat, lon FROM supp JOIN supplier ON s_suppkey = spot_id),
g AS (SELECT trail_id, idx, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM route WINDOW w AS (PARTITION BY trail_id ORDER BY idx)),
t AS (SELECT place_id, c.lat, c.lon, g.*, coalesce({_T}, 0.0) AS t FROM cust c, g WHERE lat2 IS NOT NULL), d AS (SELECT place_id, trail_id, idx, {hav('lat', 'lon', 'lat1 + (lat2 - lat1) * t', 'lon1 + (lon2 - lon1) * t')} AS m FROM t),
b AS (SELECT place_id, min({{'m': m, 't': trail_id, 'i': idx}}) AS b FROM d WHERE m <= 20000 GROUP BY place_id) SELECT place_id, b.t AS trail_id, b.i AS idx, {rnd('b.m', 2)} AS metres FROM b""",
)
def jon14_trails(spark, sf_dir):
    """All suppliers as points of one trail a nation."""
    from pyspark.sql import Window

    from trekframe.operators.track import cumulative_km

    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot_id"), F.col("s_nationkey").alias("trail_id"))
    rows = supp(spark, sf_dir).join(nation, "spot_id")
    rows = rows.withColumn("idx", (F.row_number().over(Window.partitionBy("trail_id").orderBy("lon", "spot_id")) - 1).cast("long"))
    snapped = spatial.snap_to_track(cust(spark, sf_dir), cumulative_km(rows.withColumn("is_break", F.lit(False))), 20_000)
    return snapped.select("place_id", "trail_id", "idx", js_round("metres", 2).alias("metres"))


@register(
    "jon13_visits",
    f"""WITH {PTS}, pl AS (SELECT DISTINCT c_custkey AS place_id, -35 + (c_custkey * 37 % 1000) / 10000.0 AS lat, 148 + (c_custkey * 53 % 1000) / 10000.0 AS lon FROM customer),
d AS (SELECT place_id, trail_id, idx, {hav('pl.lat', 'pl.lon', 'pts.lat', 'pts.lon')} AS m FROM pl, pts), n AS (SELECT * FROM d WHERE m <= 2400),
r AS (SELECT *, idx - row_number() OVER (PARTITION BY place_id, trail_id ORDER BY idx) AS run FROM n),
b AS (SELECT place_id, trail_id, min({{'m': m, 'i': idx}}) AS b FROM r GROUP BY place_id, trail_id, run HAVING min(m) <= 800)
SELECT place_id, trail_id, CAST(row_number() OVER (PARTITION BY place_id, trail_id ORDER BY b.i) AS INT) AS visit, b.i AS idx, {rnd('b.m', 2)} AS metres FROM b""",
)
def jon13_all(spark, sf_dir):
    """Visits of the tracks to all customers."""
    k = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(k.alias("place_id"), (-35 + (k * 37 % 1000) / 10000.0).alias("lat"), (148 + (k * 53 % 1000) / 10000.0).alias("lon"))
    return spatial.visits(places, pts(spark, sf_dir), 800).withColumn("metres", js_round("metres", 2))


# Three triangles as regions; the first two overlap.
REGIONS = [("west", 0, [(-39.0, 144.0), (-30.0, 144.0), (-34.0, 149.0)]), ("south", 1, [(-39.0, 144.0), (-39.0, 153.0), (-34.0, 148.0)]), ("east", 2, [(-38.0, 153.0), (-30.0, 153.0), (-33.0, 148.0)])]
_EDGES = [(name, rank, *ring[k], *ring[(k + 1) % len(ring)]) for name, rank, ring in REGIONS for k in range(len(ring))]
EDGE_SQL = "edges(region, rank, lat1, lon1, lat2, lon2) AS (VALUES " + ", ".join(f"('{n}', {r}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, r, a, b, c, d in _EDGES) + ")"


@register(
    "jon32_region_of",
    f"""WITH {CUST}, {EDGE_SQL}, x AS (SELECT place_id, region, rank, count(*) FILTER (WHERE (lat1 > lat) <> (lat2 > lat) AND lon < lon1 + (lat - lat1) / nullif(lat2 - lat1, 0) * (lon2 - lon1)) % 2 AS odd FROM cust, edges GROUP BY ALL)
SELECT place_id, arg_min(region, rank) AS region FROM x WHERE odd = 1 GROUP BY place_id""",
)
def jon32(spark, sf_dir):
    return spatial.region_of(cust(spark, sf_dir), region_edges(spark))


def region_edges(spark):
    return spark.createDataFrame(_EDGES, "region string, rank int, lat1 double, lon1 double, lat2 double, lon2 double")


@register(
    "agg25_majority_region",
    f"""WITH {CUST}, {EDGE_SQL}, x AS (SELECT place_id, region, rank, count(*) FILTER (WHERE (lat1 > lat) <> (lat2 > lat) AND lon < lon1 + (lat - lat1) / nullif(lat2 - lat1, 0) * (lon2 - lon1)) % 2 AS odd FROM cust, edges GROUP BY ALL),
p AS (SELECT place_id, arg_min(region, rank) AS region FROM x WHERE odd = 1 GROUP BY place_id), v AS (SELECT c_mktsegment, region, count(*) AS n, min(place_id) AS first FROM p JOIN cust USING (place_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n DESC, first) AS r FROM v) SELECT c_mktsegment, region, n FROM r WHERE r = 1""",
)
def agg25(spark, sf_dir):
    from pyspark.sql import Window

    votes = jon32(spark, sf_dir).join(cust(spark, sf_dir).select("place_id", "c_mktsegment"), "place_id").groupBy("c_mktsegment", "region").agg(F.count("*").alias("n"), F.min("place_id").alias("first"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("n"), "first")
    return votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("c_mktsegment", "region", "n")


_ROUTES = f"""routes AS (SELECT place_id AS id, lat AS start_lat, lon AS start_lon, lat + 0.01 * (place_id % 3) AS end_lat, lon AS end_lon, 10.0 + place_id % 4 AS km FROM cust)"""


@register(
    "jon39_near_duplicate_routes",
    f"""WITH {CUST}, {_ROUTES} SELECT a.id AS a, b.id AS b FROM routes a JOIN routes b ON a.id < b.id WHERE {hav('a.start_lat', 'a.start_lon', 'b.start_lat', 'b.start_lon')} <= 9000
  AND {hav('a.end_lat', 'a.end_lon', 'b.end_lat', 'b.end_lon')} <= 9000 AND abs(a.km - b.km) <= 0.05 * greatest(a.km, b.km)""",
)
def jon39(spark, sf_dir):
    c = cust(spark, sf_dir)
    k = F.col("place_id")
    routes = c.select(k.alias("id"), F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"), (F.col("lat") + 0.01 * (k % 3)).alias("end_lat"), F.col("lon").alias("end_lon"), (10.0 + k % 4).alias("km"))
    return spatial.near_duplicate_routes(routes, 9000, 0.05)


_PARTS = """wp AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_size, -35 + (p_partkey * 37 % 499) / 10000.0 AS lat, 148 + (p_partkey * 53 % 499) / 10000.0 AS lon FROM part)"""


def _wp(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), "p_size", (-35 + (k * 37 % 499) / 10000.0).alias("lat"), (148 + (k * 53 % 499) / 10000.0).alias("lon"))


# Input: parts as places and waypoints, with names that end in what names of places end in.
_ENDS = ["", " Camp", " Upper", " 2", " Hut"]
_KINDS, _TYPES = ["camping", "water", "resupply", "transport"], ["hut", "spring", "shop", "poi", "campsite", "water"]
_NAMED = f"""named AS (SELECT id, lat, lon, [{", ".join(f"'{k}'" for k in _KINDS)}][1 + (id // 2) % {len(_KINDS)}] AS category, [{", ".join(f"'{k}'" for k in _TYPES)}][1 + (id // 2) % {len(_TYPES)}] AS type,
  CASE WHEN id % 10 = 0 THEN 'Campsite' ELSE name || [{", ".join(f"'{k}'" for k in _ENDS)}][1 + (id // 3) % {len(_ENDS)}] END AS name FROM wp),
tok AS (SELECT *, string_split(lower(name), ' ') AS w FROM named), fin AS (SELECT *, list_distinct(list_filter(w, lambda x: x NOT IN ('camp', 'hut', 'campsite'))) AS t, list_filter(w, lambda x: x NOT IN ('camp', 'hut', 'campsite')) AS u,
  list_distinct(list_transform(w, lambda x: CASE WHEN x = 'campsite' THEN 'camp' ELSE x END)) AS k FROM tok)"""


def _score(x: str, y: str) -> str:
    i = f"len(list_intersect({x}.t, {y}.t))"
    same = f"{i} >= 2 OR len({x}.t) = len({y}.t) OR ({x}.u[1] = {y}.u[1] AND len(list_intersect({x}.k, {y}.k)) >= 2)"
    return f"CASE WHEN len({x}.t) = 0 OR len({y}.t) = 0 THEN 0.0 WHEN {i} = least(len({x}.t), len({y}.t)) AND ({same}) THEN 1.0 ELSE {i} / len(list_distinct(list_concat({x}.t, {y}.t))) END"


_ALLOWED = "(values ('camping', 'hut'), ('camping', 'campsite'), ('water', 'spring'), ('water', 'water'), ('resupply', 'shop')) ok(c, y)"


def _named(spark, sf_dir):
    k = F.col("id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values) + 1).cast("int"))
    name = F.when(k % 10 == 0, "Campsite").otherwise(F.concat("name", pick(_ENDS, 3)))
    rows = _wp(spark, sf_dir).select("id", "lat", "lon", pick(_KINDS, 2).alias("category"), pick(_TYPES, 2).alias("type"), name.alias("name"))
    places = rows.where(k % 2 == 0).select(k.alias("place_id"), "category", "name", "lat", "lon")
    return places, rows.where(k % 2 == 1).select(k.alias("waypoint_id"), "type", F.col("name").alias("wp_name"), "lat", "lon")


@register(
    "jon20_mark_duplicates",
    f"""WITH {_PARTS}, {_NAMED}, a AS (SELECT * FROM fin WHERE id % 2 = 0), b AS (SELECT * FROM fin WHERE id % 2 = 1),
m AS (SELECT a.id AS place_id, b.id AS waypoint_id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS metres, {_score('a', 'b')} AS score, list_sort(a.t) = list_sort(b.t) AS exact, a.category, b.type,
  list_contains(a.w, 'upper') <> list_contains(b.w, 'upper') AS apart FROM a, b WHERE len(a.t) > 0 AND len(b.t) > 0 AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 250),
f AS (SELECT * FROM m WHERE NOT apart AND score >= CASE WHEN metres <= 25 THEN 0.85 ELSE 0.9 END AND (EXISTS (SELECT 1 FROM {_ALLOWED} WHERE c = category AND y = type) OR (metres <= 10 AND score = 1 AND category <> 'transport' AND type = 'poi'))),
r AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, exact DESC, metres, waypoint_id) AS r FROM f),
h AS (SELECT a.id AS place_id, b.id AS waypoint_id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS metres FROM a, b WHERE len(a.t) = 0 AND a.category = 'camping' AND b.type IN ('hut', 'campsite') AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 60),
n AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY metres, waypoint_id) AS r FROM h), lone AS (SELECT * FROM n WHERE r = 1 AND metres <= 30)
SELECT place_id, waypoint_id, score, {rnd('metres', 2)} AS metres FROM r WHERE r = 1 UNION ALL SELECT place_id, waypoint_id, NULL, {rnd('metres', 2)} FROM lone
WHERE NOT EXISTS (SELECT 1 FROM n JOIN b x ON x.id = lone.waypoint_id JOIN b y ON y.id = n.waypoint_id WHERE n.place_id = lone.place_id AND n.r > 1 AND n.metres - lone.metres <= 30 AND {_score('x', 'y')} < 0.9)""",
)
def jon20(spark, sf_dir):
    """Names compared by their words alone, which SQL can do too."""
    return linkage.mark_duplicates(*_named(spark, sf_dir), exact_lcs=False).withColumn("metres", js_round("metres", 2))


@register("jon20_mark_duplicates_by_letters")
def jon20_letters(spark, sf_dir):
    """As above with the letters' order counted too; the longest common subsequence is beyond SQL, see the tests."""
    return linkage.mark_duplicates(*_named(spark, sf_dir))


@register(
    "jon21_lone_host",
    f"""WITH {CUST}, {SUPP}, d AS (SELECT place_id, spot_id, {_D} AS m FROM cust c, supp s WHERE {_D} <= 40000), r AS (SELECT *, row_number() OVER w AS r, lead(m) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY place_id ORDER BY m, spot_id))
SELECT place_id, spot_id AS waypoint_id FROM r WHERE r = 1 AND m <= 30000 AND (nxt IS NULL OR nxt - m > 10000)""",
)
def jon21(spark, sf_dir):
    return linkage.lone_host(cust(spark, sf_dir), supp(spark, sf_dir).withColumnRenamed("spot_id", "waypoint_id"), 30_000, 10_000)


@register(
    "set07_merge_near_copies",
    f"""WITH RECURSIVE {_PARTS}, e AS (SELECT a.id AS x, b.id AS y FROM wp a JOIN wp b ON a.name = b.name AND a.type = b.type AND a.id <> b.id WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 900),
r AS (SELECT id AS node, id AS label FROM wp UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.node AND r.label < e.y), c AS (SELECT node, min(label) AS component FROM r GROUP BY node),
m AS (SELECT wp.*, component FROM wp JOIN c ON c.node = wp.id), k AS (SELECT component, min({{'p': NOT (p_size > 25), 'i': id}}) AS s, list_sort(list(id)) AS ids, count(*) AS n FROM m GROUP BY component HAVING count(*) > 1)
SELECT s.i AS survivor, array_to_string(ids, ',') AS merged_ids FROM k""",
)
def set07(spark, sf_dir):
    wp = _wp(spark, sf_dir).withColumnRenamed("id", "waypoint_id").withColumns({"preferred": F.col("p_size") > 25, "km": F.lit(0.0), "description": F.col("type")})
    return linkage.merge_near_copies(wp, 900).select("survivor", F.array_join("merged_ids", ",").alias("merged_ids"))


@register("set10_unique_ids", "WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS id FROM r")
def set10(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("id"), F.col("p_partkey").alias("seq"))
    return linkage.unique_ids(rows).select("p_partkey", "id")


@register(
    "set06_union_first_wins",
    """WITH u AS (SELECT p_name AS id, p_partkey AS seq, 0 AS part FROM part WHERE p_size > 25 UNION ALL SELECT CASE WHEN p_partkey % 5 > 0 THEN p_name END, p_partkey, 1 FROM part WHERE p_size <= 25),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, seq) AS n FROM u) SELECT id, seq FROM r WHERE n = 1 OR id IS NULL""",
)
def set06(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.where("p_size > 25").select(F.col("p_name").alias("id"), F.col("p_partkey").alias("seq"))
    b = p.where("p_size <= 25").select(F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).alias("id"), F.col("p_partkey").alias("seq"))
    return linkage.union_first_wins(a, b)


@register(
    "jon22_apply_overrides",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 1000 + s_suppkey ELSE s_nationkey END AS target FROM supplier""",
)
def jon22(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("target"))
    changes = rows.where("s_suppkey % 3 = 0").select("s_suppkey", (1000 + F.col("s_suppkey")).alias("target"))
    return linkage.apply_overrides(rows, changes, "s_suppkey", "target")[0]


@register(
    "mth01_distances",
    f"""WITH {CUST} SELECT place_id, {rnd(hav('lat', 'lon', '-35.0', '148.0'), 2)} AS metres, {rnd('sqrt(pow(' + hav('lat', 'lon', '-35.0', '148.0') + ', 2) + 250000.0)', 2)} AS metres_3d,
  CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS tile_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793) / 2 * 4096) AS BIGINT) AS tile_y,
  CAST(28300 + floor((lon + 180) / 6) + 1 AS BIGINT) AS epsg, CASE WHEN lon * 2 - 100 > 180 THEN lon * 2 - 460 ELSE lon * 2 - 100 END AS wrapped FROM cust""",
)
def mth01(spark, sf_dir):
    lat, lon, a, b = F.col("lat"), F.col("lon"), F.lit(-35.0), F.lit(148.0)
    return cust(spark, sf_dir).select(
        "place_id", js_round(geo.haversine_m(lat, lon, a, b), 2).alias("metres"), js_round(geo.haversine_3d_m(lat, lon, F.lit(0.0), a, b, F.lit(500.0)), 2).alias("metres_3d"),
        geo.tile_x(lon, 12).alias("tile_x"), geo.tile_y(lat, 12).alias("tile_y"), geo.projected_epsg(lon, lat).alias("epsg"), geo.wrap_lon(lon * 2 - 100).alias("wrapped"),
    )


@register(
    "sim13_tile_cover",
    f"""WITH {CUST}, t AS (SELECT CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793) / 2 * 1024) AS BIGINT) AS y FROM cust),
b AS (SELECT DISTINCT x + i AS x, y + j AS y FROM t, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)),
z AS (SELECT 10 AS z, x, y FROM b UNION SELECT 9, x // 2, y // 2 FROM b UNION SELECT 8, x // 4, y // 4 FROM b) SELECT z, x, y FROM z""",
)
def sim13(spark, sf_dir):
    t = cust(spark, sf_dir).select(geo.tile_x(F.col("lon"), 10).alias("x"), geo.tile_y(F.col("lat"), 10).alias("y"))
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    base = t.select(near("x"), "y").select("x", near("y")).distinct()
    levels = F.explode(F.sequence(F.lit(0), F.lit(2)))
    return base.select(levels.alias("up"), "x", "y").select((10 - F.col("up")).alias("z"), F.floor(F.col("x") / F.pow(F.lit(2), F.col("up"))).alias("x"), F.floor(F.col("y") / F.pow(F.lit(2), F.col("up"))).alias("y")).distinct()
