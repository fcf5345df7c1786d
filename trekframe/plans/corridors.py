"""Queries on the ground around routes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trekframe.functions import pois
from trekframe.functions.rounding import js_round
from trekframe.operators import corridor, spatial, sync, trips
from trekframe.plans.places import EDGE_SQL, region_edges
from trekframe.plans.registry import register
from trekframe.plans.tables import CUST, PTS, cust, hav, pts, rnd, table
from trekframe.plans.tracks import DIST, measured

_TURNED = "CASE WHEN trail_id % 5 = 0 THEN lon + 31.95 - CASE WHEN lon + 31.95 > 180 THEN 360 ELSE 0 END ELSE lon END"
_CLAMP = lambda lat: f"least({corridor.MAX_LAT}, greatest(-{corridor.MAX_LAT}, {lat}))"
_Y = lambda lat, n: f"CAST(floor((1 - ln(tan(radians({_CLAMP(lat)})) + 1 / cos(radians({_CLAMP(lat)}))) / pi()) / 2 * {n}) AS BIGINT)"


@register(
    "sim13_route_tiles",
    f"""WITH {PTS}, l AS (SELECT trail_id, idx, lat, {_TURNED} AS lon FROM pts), s AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM l WINDOW w AS (PARTITION BY trail_id ORDER BY idx)),
t AS (SELECT *, CASE WHEN lon - lon0 > 180 THEN lon - lon0 - 360 WHEN lon - lon0 < -180 THEN lon - lon0 + 360 ELSE lon - lon0 END AS turn FROM s),
n AS (SELECT *, CAST(coalesce(greatest(1, ceil(sqrt(pow((lat - lat0) * 111320, 2) + pow(turn * 111320 * cos(radians((lat + lat0) / 2)), 2)) / greatest(1.0, 2 * pi() * 6371000.0 / 4096 * least(cos(radians(lat)), cos(radians(lat0))) / 2))), 1) AS BIGINT) AS n FROM t),
k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n), p AS (SELECT trail_id, CASE WHEN k = n THEN lat ELSE lat0 + (lat - lat0) * (k / n) END AS lat, CASE WHEN k = n THEN lon ELSE lon0 + turn * (k / n) END AS lon FROM k),
d AS (SELECT *, 1500 / (111320 * greatest(0.01, cos(radians(lat)))) AS dl FROM p),
b AS (SELECT DISTINCT trail_id, CAST(floor((lon - dl + 180) / 360 * 4096) AS BIGINT) AS x0, CAST(floor((lon + dl + 180) / 360 * 4096) AS BIGINT) AS x1, {_Y('lat + 1500 / 111320.0', 4096)} AS y0, {_Y('lat - 1500 / 111320.0', 4096)} AS y1 FROM d),
y AS (SELECT trail_id, x0, x1, unnest(range(y0, y1 + 1)) AS y FROM b), x AS (SELECT DISTINCT trail_id, (q + 4096) % 4096 AS x, y FROM (SELECT trail_id, y, unnest(range(x0, x1 + 1)) AS q FROM y))
SELECT DISTINCT trail_id, 12 - u AS z, x >> u AS x, y >> u AS y FROM x, (SELECT CAST(unnest(range(0, 5)) AS INT) AS u)""",
)
def sim13_routes(spark, sf_dir):
    """Tiles of all trails with a margin of 1,500 m; every fifth trail lies across the antimeridian."""
    east = F.col("lon") + 31.95
    lon = F.when(F.col("trail_id") % 5 == 0, F.when(east > 180, east - 360).otherwise(east)).otherwise(F.col("lon"))
    return corridor.route_tiles(pts(spark, sf_dir).withColumn("lon", lon), 1500.0, 8, 12)


_SELECTORS = list(dict.fromkeys(s for _, s in corridor.selectors(pois.CATALOG)))
_ENCODED = "url_encode(text)"
for _code, _plain in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
    _ENCODED = f"replace({_ENCODED}, '{_code}', '{_plain}')"


@register(
    "sim20_search_plan",
    f"""WITH RECURSIVE {DIST}, g AS (SELECT trail_id, idx, lat, lon, idx // 2 AS s, lag(idx // 2) OVER w AS b, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS gap FROM pts WINDOW w AS (PARTITION BY trail_id ORDER BY idx)),
l AS (SELECT trail_id, idx, lat, lon, sum(CASE WHEN coalesce(b <> s AND gap > 8000, false) THEN 1 ELSE 0 END) OVER (PARTITION BY trail_id ORDER BY idx) AS line FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY trail_id, line ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY trail_id, line) AS n FROM l),
c AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((n - 1) / 4.0) AS BIGINT)))) AS c FROM k), h AS (SELECT trail_id, line, c, string_agg(printf('%.5f,%.5f', lat, lon), ',' ORDER BY idx) AS path FROM c WHERE n <= 5 OR k BETWEEN c * 4 AND c * 4 + 4 GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY line, c) AS seq, length(path) AS size FROM h),
r AS (SELECT trail_id, seq, size AS used, 0 AS query FROM q WHERE seq = 1 UNION ALL SELECT q.trail_id, q.seq, CASE WHEN r.used + q.size <= 400 OR r.used = 0 THEN r.used + q.size ELSE q.size END, r.query + CASE WHEN r.used + q.size <= 400 OR r.used = 0 THEN 0 ELSE 1 END FROM r JOIN q ON q.trail_id = r.trail_id AND q.seq = r.seq + 1),
o AS (SELECT trail_id, query, seq, path FROM r JOIN q USING (trail_id, seq)), a AS (SELECT unnest(range({len(_SELECTORS)})) AS i, unnest([{', '.join("'" + s.replace("'", "''") + "'" for s in _SELECTORS)}]) AS ask),
t AS (SELECT trail_id, query, '[out:json][timeout:25];(' || string_agg(ask || '(around:4000,' || path || ');', '' ORDER BY i, seq) || ');out center;' AS text FROM o, a GROUP BY ALL),
u AS (SELECT trail_id, count(*) AS queries, CAST(sum(length({_ENCODED}) + 5) AS BIGINT) AS upload_bytes FROM t GROUP BY trail_id), m2 AS (SELECT trail_id, {rnd('max(dist)', 3)} AS route_km FROM m GROUP BY trail_id)
SELECT trail_id, queries, route_km, upload_bytes, CAST({rnd('route_km * 500', 0)} AS BIGINT) AS low_bytes, CAST({rnd('route_km * 15000', 0)} AS BIGINT) AS high_bytes FROM m2 JOIN u USING (trail_id)""",
)
def sim20(spark, sf_dir):
    """What a search along every trail would send and receive."""
    rows = pts(spark, sf_dir).withColumn("stretch", F.floor(F.col("idx") / 2))
    lengths = measured(spark, sf_dir).groupBy("trail_id").agg(js_round(F.max("dist"), 3).alias("route_km"))
    return corridor.search_estimate(corridor.search_queries(rows, 4000.0, pois.CATALOG, most_rows=5, most_bytes=400.0), lengths)


_BOXED = {c: [s for k, s in corridor.selectors(pois.CATALOG + pois.FALLBACKS) if k == c] for c, _ in corridor.selectors(pois.CATALOG + pois.FALLBACKS)}


@register(
    "udf05_map_queries",
    f"""WITH {PTS}, b AS (SELECT trail_id, min(lat) - 2000 / 111320.0 AS s, max(lat) + 2000 / 111320.0 AS n, min(lon) - 2000 / 111320.0 / cos(radians((min(lat) + max(lat)) / 2)) AS w, max(lon) + 2000 / 111320.0 / cos(radians((min(lat) + max(lat)) / 2)) AS e FROM pts GROUP BY trail_id),
x AS (SELECT trail_id, printf('(%.5f,%.5f,%.5f,%.5f)', s, w, n, e) AS box FROM b), k AS (SELECT unnest([{', '.join(f"{{'category': '{c}', 'own': [{', '.join(chr(39) + s + chr(39) for s in own)}]}}" for c, own in _BOXED.items())}]) AS k)
SELECT trail_id, k.category AS category, '[out:json];(' || array_to_string(list_transform(k.own, lambda s: s || box || ';'), '') || ');out center;' AS text FROM x, k""",
)
def udf05(spark, sf_dir):
    """What to ask for around every trail, by category, with a margin of 2 km."""
    return corridor.box_queries(spatial.bounds(pts(spark, sf_dir)), pois.CATALOG + pois.FALLBACKS, 2.0)


_SHARDS = [("west", -90.0, -30.0, -180.0, 148.0), ("south", -90.0, -35.0, 140.0, 180.0), ("north", -35.0, 90.0, 140.0, 180.0)]


@register(
    "sim14_world_cells",
    f"""WITH {CUST}, n AS (SELECT CAST(floor(lat / 2) * 2 AS INT) AS lat, CAST(floor(lon / 2) * 2 AS INT) AS lon, count(*) AS n FROM cust GROUP BY ALL)
SELECT lat, lon, CASE {" ".join(f"WHEN lat + 1 >= {s} AND lat + 1 < {n} AND lon + 1 >= {w} AND lon + 1 < {e} THEN '{name}'" for name, s, n, w, e in _SHARDS)} END AS shard, n FROM n""",
)
def sim14(spark, sf_dir):
    """The cells of the world that hold customers, with the shard that each belongs to."""
    return spatial.cells_of(cust(spark, sf_dir), 2, _SHARDS)


@register("srt17_page_sizes", "SELECT event_id, CASE WHEN TRY_CAST(raw AS INT) IS NULL OR TRY_CAST(raw AS INT) < 1 THEN 20 ELSE least(TRY_CAST(raw AS INT), 100) END AS size FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x' || event_id WHEN 1 THEN NULL WHEN 2 THEN CAST(event_id % 300 AS VARCHAR) WHEN 3 THEN CAST(-event_id AS VARCHAR) ELSE ' ' END AS raw FROM events)")
def srt17(spark, sf_dir):
    """Page sizes that requests ask for, one an event."""
    k = F.col("event_id")
    raw = F.when(k % 5 == 0, F.concat(F.lit("x"), k)).when(k % 5 == 2, (k % 300).cast("string")).when(k % 5 == 3, (-k).cast("string")).when(k % 5 == 4, " ")
    return table(spark, sf_dir, "events").select("event_id", sync.page_sizes(raw).alias("size"))


_NEAR = lambda km: f"(SELECT arg_min({{'up': cum_ascent, 'down': cum_descent}}, {{'d': abs(m.dist - {km}), 'i': m.idx}}) FROM m WHERE m.trail_id = x.trail_id)"
_METRES = lambda a, b, w: rnd(rnd(f"{b}.{w} - {a}.{w}", 6), 0)
_TRIP = f"""here AS (SELECT trail_id, idx AS here_id, dist + 0.3 AS km FROM m WHERE idx % 16 = 5), spots AS (SELECT trail_id, event_id AS place_id, dist + 0.1 AS km FROM m WHERE event_type = 'purchase'),
h AS (SELECT x.*, {_NEAR('x.km')} AS s FROM here x), p AS (SELECT x.*, {_NEAR('x.km')} AS s FROM spots x),
t AS (SELECT h.trail_id, here_id, place_id, p.km >= h.km AS ahead, abs(p.km - h.km) AS km, CASE WHEN p.km >= h.km THEN {_METRES('h.s', 'p.s', 'up')} ELSE {_METRES('p.s', 'h.s', 'down')} END AS ascent_m, CASE WHEN p.km >= h.km THEN {_METRES('h.s', 'p.s', 'down')} ELSE {_METRES('p.s', 'h.s', 'up')} END AS descent_m, p.km > h.km AS strictly FROM h JOIN p USING (trail_id))
SELECT trail_id, here_id, place_id, ahead, {rnd('km', 4)} AS km, ascent_m, descent_m, {rnd(rnd('km / 4.0 + ascent_m / 600.0 + greatest(0.0, (descent_m - 300) / 600.0)', 1) + ' * 60', 0)} AS eta_min FROM t"""


def _trips(spark, sf_dir, behind):
    m = measured(spark, sf_dir)
    here = m.where("idx % 16 = 5").select("trail_id", F.col("idx").alias("here_id"), (F.col("dist") + 0.3).alias("km"))
    spots = m.where("event_type = 'purchase'").select("trail_id", F.col("event_id").alias("place_id"), (F.col("dist") + 0.1).alias("km"))
    return trips.trips(here, spots, m, behind=behind).withColumn("km", js_round("km", 4))


@register("jon54_trips_ahead", f"WITH {DIST}, {_TRIP} WHERE strictly")
def jon54(spark, sf_dir):
    """Distance, climb and time from every sixteenth row of every trail to the places ahead."""
    return _trips(spark, sf_dir, False)


@register("jon55_trips_both_ways", f"WITH {DIST}, {_TRIP}")
def jon55(spark, sf_dir):
    return _trips(spark, sf_dir, True)


@register(
    "mth19_day_metrics",
    f"""WITH {DIST}, x AS (SELECT trail_id, event_id AS stop_id, dist AS km FROM m WHERE event_type = 'click'), s AS (SELECT x.*, {_NEAR('x.km')} AS z FROM x),
d AS (SELECT trail_id, stop_id, z, km, lag(km) OVER w AS from_km, lag(z) OVER w AS a FROM s WINDOW w AS (PARTITION BY trail_id ORDER BY km, stop_id)),
e AS (SELECT trail_id, stop_id, km - from_km AS km, {_METRES('a', 'z', 'up')} AS ascent_m, {_METRES('a', 'z', 'down')} AS descent_m FROM d WHERE from_km IS NOT NULL)
SELECT trail_id, stop_id, {rnd('km', 4)} AS km, ascent_m, descent_m, {rnd('km / 4.0 + ascent_m / 600.0 + greatest(0.0, (descent_m - 300) / 600.0)', 5)} AS hours FROM e""",
)
def mth19(spark, sf_dir):
    """The days between the clicks of every trail."""
    m = measured(spark, sf_dir)
    stops = m.where("event_type = 'click'").select("trail_id", F.col("event_id").alias("stop_id"), F.col("dist").alias("km"))
    return trips.day_metrics(stops, m).select("trail_id", "stop_id", js_round("km", 4).alias("km"), "ascent_m", "descent_m", js_round("hours", 5).alias("hours"))


@register(
    "agg25_route_region",
    f"""WITH {CUST}, {EDGE_SQL}, r AS (SELECT c_mktsegment AS trail_id, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY place_id) - 1 AS BIGINT) AS idx, lat, lon FROM cust), z AS (SELECT trail_id, max(idx) AS last FROM r GROUP BY trail_id),
k AS (SELECT DISTINCT trail_id, CAST(floor(k * last / 255.0 + 0.5) AS BIGINT) AS idx FROM z, range(256) t(k) WHERE last >= 256 UNION SELECT trail_id, idx FROM r JOIN z USING (trail_id) WHERE last < 256),
x AS (SELECT trail_id, idx, region, rank, count(*) FILTER (WHERE (lat1 > lat) <> (lat2 > lat) AND lon < lon1 + (lat - lat1) / nullif(lat2 - lat1, 0) * (lon2 - lon1)) % 2 AS odd FROM r JOIN k USING (trail_id, idx), edges GROUP BY ALL),
h AS (SELECT trail_id, idx, arg_min(region, rank) AS region FROM x WHERE odd = 1 GROUP BY ALL), v AS (SELECT trail_id, CASE WHEN region = 'south' THEN 'S' ELSE 'N' END AS country, region, count(*) AS n, min(idx) AS first FROM h GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY trail_id) AS total, sum(n) OVER (PARTITION BY trail_id, country) AS own, min(first) OVER (PARTITION BY trail_id, country) AS reached FROM v),
b AS (SELECT *, rank() OVER (PARTITION BY trail_id ORDER BY own DESC, reached) AS r FROM w)
SELECT trail_id, country, coalesce(string_agg(region, ',' ORDER BY first) FILTER (WHERE n >= greatest(1, ceil(0.02 * total))), '') AS states, arg_max(region, {{'n': n, 'f': -first}}) FILTER (WHERE n >= greatest(1, ceil(0.02 * total))) AS state FROM b WHERE r = 1 GROUP BY trail_id, country""",
)
def agg25_route(spark, sf_dir):
    """All customers of a segment as a track: the country most of its samples lie in, and its states."""
    c = cust(spark, sf_dir)
    rows = c.select(F.col("c_mktsegment").alias("trail_id"), (F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("place_id")) - 1).cast("long").alias("idx"), "lat", "lon")
    edges = region_edges(spark).withColumn("country", F.when(F.col("region") == "south", "S").otherwise("N"))
    return spatial.majority_region(rows, edges).select("trail_id", "country", F.array_join("states", ",").alias("states"), "state")
