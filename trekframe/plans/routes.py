"""Queries on routes with variants, and on supplies along them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trekframe.functions.rounding import js_round
from trekframe.operators import resupply, routes
from trekframe.plans.registry import register
from trekframe.plans.tables import ENDS, PTS, ends, hav, pts, rnd, table
from trekframe.plans.tracks import DIST, measured

_STEP = hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")


@register(
    "win27_concatenated_stretches",
    f"""WITH {PTS}, g AS (SELECT *, idx // 6 AS track_no, {_STEP} AS gap, lag(idx // 6) OVER w AS before FROM pts WINDOW w AS (PARTITION BY trail_id ORDER BY idx))
SELECT trail_id, idx, coalesce(before <> track_no AND gap >= 4000, false) AS is_break FROM g""",
)
def win27(spark, sf_dir):
    rows = pts(spark, sf_dir).select("trail_id", F.floor(F.col("idx") / 6).alias("track_no"), F.col("idx").alias("seq"), "lat", "lon", "ele")
    return routes.concatenate_stretches(rows, 4000.0).select("trail_id", "idx", "is_break")


# Input: each trail's rows 10 to 14 and 20 to 24, moved a little, as variants 1 and 2; the second is not attached.
_VAR = f"v AS (SELECT trail_id, idx // 10 AS variant, idx % 10 AS idx, lat + 0.001 AS lat, lon, ele FROM pts WHERE idx // 10 IN (1, 2) AND idx % 10 < 5)"


def _variants(spark, sf_dir):
    p = pts(spark, sf_dir).where("floor(idx / 10) in (1, 2) and idx % 10 < 5")
    return p.select("trail_id", F.floor(F.col("idx") / 10).alias("variant"), (F.col("idx") % 10).alias("idx"), (F.col("lat") + 0.001).alias("lat"), "lon", "ele")


@register(
    "jon48_route_scale",
    f"""WITH {DIST}, {_VAR}, a AS (SELECT *, sum(coalesce(s, 0.0)) OVER (PARTITION BY trail_id, variant ORDER BY idx) / 1000 AS along FROM (SELECT *, {_STEP} AS s FROM v WINDOW w AS (PARTITION BY trail_id, variant ORDER BY idx))),
n AS (SELECT a.trail_id, a.idx, min({{'m': {hav('a.lat', 'a.lon', 'm.lat', 'm.lon')}, 'i': m.idx, 'd': m.dist}}) AS b FROM a JOIN m USING (trail_id) WHERE variant = 2 GROUP BY a.trail_id, a.idx)
SELECT trail_id, 0 AS part, idx, {rnd('dist', 3)} AS km FROM m UNION ALL SELECT trail_id, variant, idx, {rnd('5.0 + along', 3)} FROM a WHERE variant = 1 UNION ALL SELECT trail_id, 2, idx, {rnd('b.d', 3)} FROM n WHERE b.m <= 20000""",
)
def jon48(spark, sf_dir):
    v = _variants(spark, sf_dir)
    heads = v.select("trail_id", "variant").distinct().withColumn("start_km", F.when(F.col("variant") == 1, 5.0))
    return routes.route_scale(measured(spark, sf_dir), heads, v).select("trail_id", F.col("part").cast("int").alias("part"), "idx", js_round("km", 3).alias("km"))


@register(
    "flt23_clipped_scale",
    f"""WITH {PTS}, f AS (SELECT trail_id, idx, ele BETWEEN 20 AND 60 AS inside, coalesce(lag(ele BETWEEN 20 AND 60) OVER w, false) AS was FROM pts WINDOW w AS (PARTITION BY trail_id ORDER BY idx)),
r AS (SELECT *, count(*) FILTER (WHERE inside AND NOT was) OVER (PARTITION BY trail_id ORDER BY idx) AS run FROM f) SELECT trail_id, idx, run FROM r WHERE inside""",
)
def flt23(spark, sf_dir):
    scale = pts(spark, sf_dir).select("trail_id", F.lit(0).alias("part"), "idx", F.col("ele").alias("km"))
    return routes.clip_scale(scale, 20.0, 60.0).select("trail_id", "idx", "run")


@register(
    "jon49_km_on_scale",
    f"""WITH {DIST}, s AS (SELECT trail_id, idx, dist AS a, lead(dist) OVER (PARTITION BY trail_id ORDER BY idx) AS b FROM m), q AS (SELECT event_id, trail_id, idx + 3 * (event_id % 2) AS idx, (event_id % 5) / 5.0 AS t, ele FROM pts)
SELECT event_id, {rnd('coalesce(CASE WHEN t <= 0 OR b IS NULL THEN a ELSE a + t * (b - a) END, ele)', 4)} AS km FROM q LEFT JOIN s USING (trail_id, idx)""",
)
def jon49(spark, sf_dir):
    k = F.col("event_id")
    places = pts(spark, sf_dir).select("event_id", "trail_id", F.lit(0).alias("part"), (F.col("idx") + 3 * (k % 2)).alias("idx"), ((k % 5) / 5.0).alias("t"), F.col("ele").alias("along_km"))
    scale = measured(spark, sf_dir).select("trail_id", F.lit(0).alias("part"), "idx", F.col("dist").alias("km"))
    return routes.km_on_scale(places, scale).select("event_id", js_round("km", 4).alias("km"))


@register(
    "agg20_segment_stats",
    f"""WITH {DIST} SELECT a.trail_id, a.idx AS span, {rnd('b.dist - a.dist', 4)} AS km, {rnd('b.cum_ascent - a.cum_ascent', 3)} AS ascent, {rnd('b.cum_descent - a.cum_descent', 3)} AS descent
FROM m a JOIN m b ON a.trail_id = b.trail_id AND b.idx = a.idx + 7 WHERE a.idx % 4 = 0""",
)
def agg20(spark, sf_dir):
    m = measured(spark, sf_dir)
    spans = m.where("idx % 4 = 0").select("trail_id", F.col("idx").alias("span"), F.col("idx").alias("from_idx"), (F.col("idx") + 7).alias("to_idx"))
    return routes.segment_stats(m, spans).select("trail_id", "span", js_round("km", 4).alias("km"), js_round("ascent", 3).alias("ascent"), js_round("descent", 3).alias("descent"))


@register(
    "win36_climb_of_spans",
    f"""WITH {DIST}, q AS (SELECT DISTINCT trail_id, unnest([1, 2]) AS span FROM m), r AS (SELECT *, CASE span WHEN 1 THEN 2.0 ELSE 15.0 END AS f, CASE span WHEN 1 THEN 30.0 ELSE 60.0 END AS t FROM q),
n AS (SELECT trail_id, span, arg_min(m.idx, {{'d': abs(m.dist - f), 'i': m.idx}}) AS i, arg_min(m.idx, {{'d': abs(m.dist - t), 'i': m.idx}}) AS j FROM r JOIN m USING (trail_id) GROUP BY trail_id, span)
SELECT n.trail_id, span, {rnd(rnd('y.cum_ascent - x.cum_ascent', 6), 0)} AS gain, {rnd(rnd('y.cum_descent - x.cum_descent', 6), 0)} AS loss FROM n JOIN m x ON x.trail_id = n.trail_id AND x.idx = i JOIN m y ON y.trail_id = n.trail_id AND y.idx = j""",
)
def win36(spark, sf_dir):
    """Climb between the rows nearest two distances (WIN36, MTH19, JON54, JON55)."""
    m = measured(spark, sf_dir)
    spans = m.select("trail_id").distinct().select("trail_id", F.inline(F.array(F.struct(F.lit(1).alias("span"), F.lit(2.0).alias("from_km"), F.lit(30.0).alias("to_km")), F.struct(F.lit(2).alias("span"), F.lit(15.0).alias("from_km"), F.lit(60.0).alias("to_km")))))
    return routes.between_km(m, spans)




@register(
    "jon34_variant_junctions",
    f"""WITH {DIST}, t AS (SELECT DISTINCT trail_id FROM m), h AS (SELECT trail_id, 1 AS variant, 'alternate' AS kind, 15 AS s, 3 AS e FROM t UNION ALL SELECT trail_id, 2, 'side-trip', 6, 8 FROM t UNION ALL SELECT trail_id, 3, 'side-trip', 2, 17 FROM t),
p AS (SELECT h.trail_id, variant, kind, a.lat + 0.001 AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon + 0.02 * (variant % 2) AS lon2 FROM h JOIN m a ON a.trail_id = h.trail_id AND a.idx = s JOIN m b ON b.trail_id = h.trail_id AND b.idx = e),
s1 AS (SELECT p.trail_id, variant, min({{'d': {hav('lat1', 'lon1', 'm.lat', 'm.lon')}, 'i': m.idx, 'k': m.dist}}) AS b FROM p JOIN m USING (trail_id) GROUP BY p.trail_id, variant),
e1 AS (SELECT p.trail_id, variant, min({{'d': {hav('lat2', 'lon2', 'm.lat', 'm.lon')}, 'i': m.idx, 'k': m.dist}}) AS b FROM p JOIN m USING (trail_id) GROUP BY p.trail_id, variant),
j AS (SELECT p.trail_id, variant, kind, CASE WHEN s1.b.d <= 500 THEN s1.b END AS s, CASE WHEN e1.b.d <= 500 THEN e1.b END AS e FROM p JOIN s1 USING (trail_id, variant) JOIN e1 USING (trail_id, variant)),
c AS (SELECT trail_id, variant, s.i AS si, {rnd('s.k', 2)} AS sk, CASE WHEN kind = 'alternate' OR s.i IS NULL OR abs(e.i - s.i) >= 10 THEN e.i END AS ei, CASE WHEN kind = 'alternate' OR s.i IS NULL OR abs(e.i - s.i) >= 10 THEN {rnd('e.k', 2)} END AS ek FROM j)
SELECT trail_id, variant, CASE WHEN coalesce(ei < si, false) THEN ei ELSE si END AS start_idx, CASE WHEN coalesce(ei < si, false) THEN ek ELSE sk END AS start_km,
  CASE WHEN coalesce(ei < si, false) THEN si ELSE ei END AS end_idx, CASE WHEN coalesce(ei < si, false) THEN sk ELSE ek END AS end_km FROM c""",
)
def jon34(spark, sf_dir):
    m = measured(spark, sf_dir)
    kinds = [(1, "alternate", 15, 3), (2, "side-trip", 6, 8), (3, "side-trip", 2, 17)]
    heads = m.select("trail_id").distinct().select("trail_id", F.inline(F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(k).alias("kind"), F.lit(s).alias("s"), F.lit(e).alias("e")) for v, k, s, e in kinds))))
    a = m.select("trail_id", F.col("idx").alias("s"), (F.col("lat") + 0.001).alias("start_lat"), F.col("lon").alias("start_lon"))
    b = m.select("trail_id", F.col("idx").alias("e"), F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))
    variants = heads.join(a, ["trail_id", "s"]).join(b, ["trail_id", "e"]).withColumn("end_lon", F.col("end_lon") + 0.02 * (F.col("variant") % 2))
    return routes.variant_junctions(variants, m)


@register(
    "jon35_parents_of_variants",
    """WITH RECURSIVE l AS (SELECT p_partkey AS variant, p_partkey - 1 AS other, p_size AS metres FROM part WHERE p_partkey % 7 <> 0 AND p_size > 12 UNION ALL SELECT p_partkey, p_partkey + 3, 60 - p_size FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT p_partkey AS v, 0 AS d FROM part WHERE p_partkey % 7 = 0 UNION SELECT l.variant, r.d + 1 FROM r JOIN l ON l.other = r.v WHERE r.d < 20), f AS (SELECT v, min(d) AS d FROM r GROUP BY v)
SELECT f.v AS variant, arg_min(l.other, {'m': l.metres, 'o': l.other}) AS parent, f.d AS depth FROM f LEFT JOIN (SELECT l.*, g.d AS od FROM l JOIN f g ON g.v = l.other) l ON l.variant = f.v AND l.od = f.d - 1 GROUP BY f.v, f.d""",
)
def jon35(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    loose = p.where(k % 7 != 0)
    links = loose.where("p_size > 12").select(k.alias("variant"), (k - 1).alias("other"), F.col("p_size").alias("metres")).unionByName(loose.select(k.alias("variant"), (k + 3).alias("other"), (60 - F.col("p_size")).alias("metres")))
    return routes.attach_to_parents(p.select(k.alias("variant"), (k % 7 == 0).alias("attached")), links)


@register(
    "win34_reversed_variants",
    f"""WITH {PTS}, {ENDS}, v AS (SELECT trail_id, event_id AS variant, end_km, km AS s, CASE WHEN idx % 3 = 0 THEN NULL ELSE km + 1 END AS e, CASE WHEN idx % 2 = 0 THEN 'alternate' ELSE 'side-trip' END AS kind FROM pts JOIN ends USING (trail_id) WHERE event_type = 'purchase')
SELECT trail_id, variant, {rnd("end_km - CASE WHEN kind = 'alternate' AND e IS NOT NULL THEN e ELSE s END", 2)} AS start_km, {rnd("end_km - CASE WHEN kind = 'alternate' AND e IS NOT NULL THEN s ELSE e END", 2)} AS end_km FROM v""",
)
def win34(spark, sf_dir):
    rows = pts(spark, sf_dir).where("event_type = 'purchase'").join(ends(spark, sf_dir), "trail_id")
    v = rows.select("trail_id", F.col("event_id").alias("variant"), F.col("end_km").alias("total_km"), F.col("km").alias("start_km"), F.when(F.col("idx") % 3 != 0, F.col("km") + 1).alias("end_km"), F.when(F.col("idx") % 2 == 0, "alternate").otherwise("side-trip").alias("kind"))
    return routes.reverse_variants(v).select("trail_id", "variant", "start_km", "end_km")


@register(
    "win20_reversed_datasheet",
    f"""WITH {PTS}, {ENDS}, w AS (SELECT trail_id, idx, end_km - km AS k, event_id % 50 AS up, event_id % 30 AS down FROM pts JOIN ends USING (trail_id) WHERE event_type <> 'view'),
r AS (SELECT *, lag(k) OVER w AS p, coalesce(lag(down) OVER w, 7) AS a, coalesce(lag(up) OVER w, 3) AS d FROM w WINDOW w AS (PARTITION BY trail_id ORDER BY idx DESC))
SELECT trail_id, CAST(row_number() OVER w AS INT) AS place, idx AS seq, {rnd('k', 4)} AS km, {rnd('abs(k - coalesce(p, 0))', 4)} AS leg, a AS ascent, d AS descent, CAST(sum(a) OVER w AS BIGINT) AS total_ascent, CAST(sum(d) OVER w AS BIGINT) AS total_descent
FROM r WINDOW w AS (PARTITION BY trail_id ORDER BY idx DESC)""",
)
def win20(spark, sf_dir):
    rows = pts(spark, sf_dir).where("event_type <> 'view'").join(ends(spark, sf_dir), "trail_id")
    k = F.col("event_id")
    w = rows.select("trail_id", F.col("idx").alias("seq"), F.col("end_km").alias("total_km"), "km", (k % 50).alias("ascent"), (k % 30).alias("descent"), F.lit(7).cast("long").alias("first_ascent"), F.lit(3).cast("long").alias("first_descent"))
    return routes.reverse_waypoints(w).withColumns({"km": js_round("km", 4), "leg": js_round("leg", 4)})


@register(
    "win33_reversed_breaks",
    f"""WITH {PTS}, {ENDS}, n AS (SELECT trail_id, count(*) AS n FROM pts GROUP BY trail_id) SELECT trail_id, n - idx AS idx, {rnd('end_km - km', 4)} AS km, 'b' || idx AS from_track, 'a' || idx AS to_track FROM pts JOIN ends USING (trail_id) JOIN n USING (trail_id) WHERE is_break""",
)
def win33(spark, sf_dir):
    p = pts(spark, sf_dir)
    n = F.count("*").over(Window.partitionBy("trail_id"))
    rows = p.withColumn("n", n).where("is_break").join(ends(spark, sf_dir), "trail_id")
    rows = rows.select("trail_id", "idx", "km", "n", F.col("end_km").alias("total_km"), F.concat(F.lit("a"), "idx").alias("from_track"), F.concat(F.lit("b"), "idx").alias("to_track"))
    return routes.reverse_breaks(rows).withColumn("km", js_round("km", 4))


@register(
    "sim09_spurs",
    f"""WITH {DIST}, c AS (SELECT trail_id, CASE WHEN trail_id % 2 = 0 THEN 0.0 ELSE 10.0 END AS f, 40.0 AS t FROM (SELECT DISTINCT trail_id FROM m) x),
i AS (SELECT trail_id, arg_min(m.idx, {{'d': abs(m.dist - f), 'i': m.idx}}) AS a, arg_min(m.idx, {{'d': abs(m.dist - t), 'i': m.idx}}) AS b FROM c JOIN m USING (trail_id) GROUP BY trail_id)
SELECT trail_id, idx, 'main' AS line FROM m JOIN i USING (trail_id) WHERE b > a AND CASE WHEN a = 0 THEN idx >= b ELSE idx <= a OR idx > b END UNION ALL SELECT trail_id, idx, 'spur' FROM m JOIN i USING (trail_id) WHERE b > a AND idx BETWEEN a AND b""",
)
def sim09(spark, sf_dir):
    m = measured(spark, sf_dir)
    spurs = m.select("trail_id").distinct().select("trail_id", F.when(F.col("trail_id") % 2 == 0, 0.0).otherwise(10.0).alias("from_km"), F.lit(40.0).alias("to_km"))
    return routes.extract_spur(m, spurs)


# Input: each trail's purchases as taps of a route; every third one off the track.
_TAPS = "t AS (SELECT trail_id AS route_id, idx AS seq, lat, lon, CASE WHEN idx % 3 > 0 THEN dist * CASE WHEN idx % 2 = 0 THEN 1 ELSE 0.5 END END AS km FROM m WHERE event_type = 'purchase')"


def _taps(m):
    km = F.when(F.col("idx") % 3 > 0, F.col("dist") * F.when(F.col("idx") % 2 == 0, 1.0).otherwise(0.5))
    return m.where("event_type = 'purchase'").select(F.col("trail_id").alias("route_id"), F.col("idx").alias("seq"), "trail_id", "lat", "lon", km.alias("km"))


@register(
    "sim16_route_legs",
    f"""WITH {DIST}, {_TAPS}, l AS (SELECT route_id, seq, lat, lon, km AS b, lag(km) OVER w AS a, lag(lat) OVER w AS lat1, lag(lon) OVER w AS lon1 FROM t WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
s AS (SELECT *, a IS NULL OR b IS NULL AS straight FROM l WHERE lat1 IS NOT NULL),
n AS (SELECT route_id, seq, arg_min(m.idx, {{'d': abs(m.dist - least(a, b)), 'i': m.idx}}) AS i, arg_min(m.idx, {{'d': abs(m.dist - greatest(a, b)), 'i': m.idx}}) AS j FROM s JOIN m ON m.trail_id = s.route_id WHERE NOT straight GROUP BY route_id, seq),
c AS (SELECT n.route_id, n.seq, {rnd(rnd('y.cum_ascent - x.cum_ascent', 6), 0)} AS up, {rnd(rnd('y.cum_descent - x.cum_descent', 6), 0)} AS down FROM n JOIN m x ON x.trail_id = n.route_id AND x.idx = i JOIN m y ON y.trail_id = n.route_id AND y.idx = j)
SELECT route_id, seq, straight, {rnd("CASE WHEN straight THEN " + hav('lat1', 'lon1', 'lat', 'lon') + " / 1000 ELSE abs(b - a) END", 4)} AS km, CASE WHEN straight THEN 0.0 WHEN b >= a THEN up ELSE down END AS ascent, CASE WHEN straight THEN 0.0 WHEN b >= a THEN down ELSE up END AS descent,
  {rnd('CASE WHEN NOT straight THEN least(a, b) END', 4)} AS from_km, {rnd('CASE WHEN NOT straight THEN greatest(a, b) END', 4)} AS to_km FROM s LEFT JOIN c USING (route_id, seq)""",
)
def sim16(spark, sf_dir):
    m = measured(spark, sf_dir)
    legs = routes.route_legs(_taps(m), m)
    return legs.withColumns({c: js_round(c, 4) for c in ("km", "from_km", "to_km")})


@register(
    "win39_highlight_ranges",
    f"""WITH {DIST}, {_TAPS}, l AS (SELECT route_id, seq, km AS b, lag(km) OVER (PARTITION BY route_id ORDER BY seq) AS a FROM t) SELECT route_id, seq, {rnd('least(a, b)', 4)} AS from_km, {rnd('greatest(a, b)', 4)} AS to_km FROM l WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def win39(spark, sf_dir):
    return routes.highlight_ranges(_taps(measured(spark, sf_dir))).withColumns({c: js_round(c, 4) for c in ("from_km", "to_km")})


@register(
    "win29_spliced_route",
    f"""WITH {PTS}, {_VAR}, k AS (SELECT trail_id, idx AS spot, 0 AS source, 0 AS k, lat, lon, ele, is_break FROM pts WHERE NOT (idx > 9 AND idx < 18) UNION ALL SELECT trail_id, 9, 1, idx + 1, lat, lon, ele, false FROM v WHERE variant = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY spot, source, k) - 1 AS i FROM k), s AS (SELECT *, CASE WHEN is_break OR lag(lat) OVER w IS NULL THEN 0.0 ELSE {_STEP} END AS step, CASE WHEN is_break THEN 0.0 ELSE coalesce(ele - lag(ele) OVER w, 0.0) END AS rise FROM o WINDOW w AS (PARTITION BY trail_id ORDER BY i))
SELECT trail_id, CAST(i AS BIGINT) AS idx, source, {rnd('sum(step) OVER w / 1000', 4)} AS dist, {rnd('sum(greatest(rise, 0.0)) OVER w', 3)} AS cum_ascent FROM s WINDOW w AS (PARTITION BY trail_id ORDER BY i)""",
)
def win29(spark, sf_dir):
    p = pts(spark, sf_dir)
    taken = p.select("trail_id").distinct().select("trail_id", F.lit(1).cast("long").alias("variant"), F.lit(9).cast("long").alias("start_idx"), F.lit(18).cast("long").alias("end_idx"))
    return routes.splice_route(p, _variants(spark, sf_dir), taken).select("trail_id", "idx", "source", js_round("dist", 4).alias("dist"), js_round("cum_ascent", 3).alias("cum_ascent"))


@register(
    "sim23_alternate_markers",
    f"""WITH {PTS}, a AS (SELECT trail_id, event_id AS name, idx AS rank, event_type = 'purchase' AS taken, CASE WHEN idx % 5 > 0 THEN floor(km) END AS f, floor(km) + idx % 2 * 2 - 1 AS t FROM pts WHERE event_type IN ('purchase', 'click')),
c AS (SELECT trail_id, name, rank, 'branch' AS kind, least(f, t) AS km FROM a WHERE f IS NOT NULL UNION ALL SELECT trail_id, name, rank, 'rejoin', greatest(f, t) FROM a WHERE f IS NOT NULL AND taken)
SELECT trail_id, name, kind, km, CAST(row_number() OVER (PARTITION BY trail_id ORDER BY km, kind DESC, rank) AS INT) AS place FROM c""",
)
def sim23(spark, sf_dir):
    p = pts(spark, sf_dir).where("event_type in ('purchase', 'click')")
    km = F.floor("km").cast("double")
    return routes.alternate_markers(p.select("trail_id", F.col("event_id").alias("name"), F.col("idx").alias("rank"), (F.col("event_type") == "purchase").alias("taken"), F.when(F.col("idx") % 5 > 0, km).alias("from_km"), (km + F.col("idx") % 2 * 2 - 1).alias("to_km")))


@register(
    "sim10_walk_network",
    f"""WITH w AS (SELECT user_id AS way_id, event_id AS seq, -35 + (event_id * 37 % 40) / 10000.0 AS lat, 148 + (event_id * 53 % 40) / 10000.0 AS lon FROM events),
s AS (SELECT way_id, seq, lat AS a1, lon AS b1, lead(lat) OVER w AS a2, lead(lon) OVER w AS b2 FROM w WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
n AS (SELECT *, {hav('a1', 'b1', 'a2', 'b2')} AS len FROM s WHERE a2 IS NOT NULL AND printf('%.7f,%.7f', a1, b1) <> printf('%.7f,%.7f', a2, b2)), c AS (SELECT *, CAST(greatest(1, ceil(len / 100)) AS BIGINT) AS n FROM n),
k AS (SELECT *, unnest(range(0, n)) AS k FROM c)
SELECT CASE WHEN k = 0 THEN printf('%.7f,%.7f', a1, b1) ELSE way_id || ':' || seq || ':' || k END AS a, CASE WHEN k + 1 = n THEN printf('%.7f,%.7f', a2, b2) ELSE way_id || ':' || seq || ':' || (k + 1) END AS b, {rnd('len / n', 3)} AS metres FROM k""",
)
def sim10(spark, sf_dir):
    k = F.col("event_id")
    ways = table(spark, sf_dir, "events").select(F.col("user_id").alias("way_id"), k.alias("seq"), (-35 + (k * 37 % 40) / 10000.0).alias("lat"), (148 + (k * 53 % 40) / 10000.0).alias("lon"))
    return routes.walk_network(ways, 100.0).withColumn("metres", js_round("metres", 3))


# Input: orders as options of supply, in groups by customer.
_KIND = ["town", "town-access", "food", "resupply-access", "shop"]
_OPT = """o AS (SELECT o_custkey AS trail_id, o_orderkey // 40 AS grp, o_orderkey AS ord, 'w' || o_orderkey AS option_id, 'n' || o_orderkey % 7 AS name, (o_orderkey // 40) * 1.5 AS km, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 3 * 3.0 END AS off_km,
  CASE o_orderkey % 5 WHEN 0 THEN 'foot' WHEN 1 THEN 'hitch' WHEN 2 THEN 'shuttle' END AS mode, o_orderkey % 11 = 0 AS routed, ['town', 'town-access', 'food', 'resupply-access', 'shop'][1 + o_orderkey % 5] AS type FROM orders)"""


def _options(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("trail_id"), F.floor(k / 40).alias("group"), k.alias("ord"), F.concat(F.lit("w"), k).alias("option_id"), F.concat(F.lit("n"), k % 7).alias("name"), (F.floor(k / 40) * 1.5).alias("km"),
        F.when(k % 4 > 0, k % 3 * 3.0).alias("off_km"), F.when(k % 5 == 0, "foot").when(k % 5 == 1, "hitch").when(k % 5 == 2, "shuttle").alias("mode"), (k % 11 == 0).alias("routed"), F.element_at(F.array(*map(F.lit, _KIND)), (k % 5 + 1).cast("int")).alias("type"),
    )


@register(
    "jon50_resupply_stops",
    f"""WITH {_OPT}, p AS (SELECT *, CASE WHEN off_km > 0 THEN off_km ELSE 0.0 END AS off FROM o WHERE trail_id % 3 = 0 OR (trail_id % 3 = 1 AND ord % 2 = 0)), a AS (SELECT *, coalesce(routed OR mode = 'foot' OR off = 0 OR (mode IS NULL AND off <= 5), false) AS walked FROM p)
SELECT trail_id, grp AS "group", min(km) AS km, string_agg(name, ' / ' ORDER BY ord) AS name, string_agg(option_id, ',' ORDER BY ord) AS option_ids, max({{'w': CASE WHEN walked THEN off ELSE 0 END, 'r': CASE WHEN walked THEN 0 ELSE off END}}) FILTER (WHERE off > 0).w AS walk_km,
  max({{'w': CASE WHEN walked THEN off ELSE 0 END, 'r': CASE WHEN walked THEN 0 ELSE off END}}) FILTER (WHERE off > 0).r AS ride_km FROM a GROUP BY trail_id, grp""".replace(".w AS walk_km", ".w AS walk_km"),
)
def jon50(spark, sf_dir):
    """Trails by customer: one third of them chose nothing yet, one third the even orders, one third none at all."""
    o = _options(spark, sf_dir)
    even = o.where("trail_id % 3 = 1").groupBy("trail_id").agg(F.collect_list(F.when(F.col("ord") % 2 == 0, F.col("option_id"))).alias("chosen"))
    none = o.where("trail_id % 3 = 2").select("trail_id").distinct().select("trail_id", F.array().cast("array<string>").alias("chosen"))
    return resupply.selected_stops(o, even.unionByName(none)).withColumn("option_ids", F.array_join("option_ids", ","))


@register(
    "jon51_planned_ids",
    f"""WITH {_OPT}, f AS (SELECT *, CASE WHEN off_km > 0 THEN off_km ELSE 0.0 END AS off, type LIKE '%-access' AS acc FROM o), t AS (SELECT * FROM f WHERE ord % 3 = 0)
SELECT trail_id, option_id FROM t UNION SELECT f.trail_id, f.option_id FROM f JOIN t USING (trail_id, grp) WHERE f.option_id <> t.option_id AND f.acc AND (f.off = 0 OR (NOT t.acc AND f.off = t.off))""",
)
def jon51(spark, sf_dir):
    o = _options(spark, sf_dir)
    return resupply.planned_ids(o, o.where("ord % 3 = 0").select("trail_id", "option_id"))


@register(
    "srt15_next_stop",
    f"""WITH {PTS}, s AS (SELECT trail_id, km, event_id AS name FROM pts WHERE event_type = 'purchase') SELECT p.event_id, min(s.km) AS next_km, arg_min(s.name, s.km) AS next_name FROM pts p LEFT JOIN s ON s.trail_id = p.trail_id AND s.km > p.km GROUP BY p.event_id""",
)
def srt15(spark, sf_dir):
    p = pts(spark, sf_dir)
    stops = p.where("event_type = 'purchase'").select("trail_id", "km", F.col("event_id").alias("name"))
    return resupply.next_stop(p.select("event_id", "trail_id", "km"), stops).select("event_id", "next_km", "next_name")


@register(
    "agg22_plan_summary",
    f"""WITH {PTS}, l AS (SELECT trail_id, km AS f, lead(km) OVER w AS t, lag(km) OVER w IS NULL AS first, event_id AS k, ele FROM pts WINDOW w AS (PARTITION BY trail_id ORDER BY km)), e AS (SELECT trail_id, f AS stop FROM l WHERE NOT first UNION SELECT trail_id, t FROM l WHERE t IS NOT NULL),
n AS (SELECT trail_id, count(*) AS stops FROM e GROUP BY trail_id)
SELECT trail_id, coalesce(any_value(stops), 0) AS stops, max(ele) AS longest_km, max(k % 900) AS most_climb_m, max(k % 9) AS longest_days, {rnd('max(k % 9 * 777) / 100.0', 0)} / 10 AS heaviest_kg, {rnd('sum(ele) * 10', 0)} / 10 AS walking_km, CAST(sum(k % 9) + sum(k % 2) AS BIGINT) AS total_days, CAST(sum(k % 2) AS BIGINT) AS zero_days
FROM l LEFT JOIN n USING (trail_id) GROUP BY trail_id""",
)
def agg22(spark, sf_dir):
    w = Window.partitionBy("trail_id").orderBy("km")
    p, k = pts(spark, sf_dir), F.col("event_id")
    legs = p.select(
        "trail_id", F.col("km").alias("from_km"), F.coalesce(F.lead("km").over(w), F.lit(0.0)).alias("to_km"), F.when(F.lag("km").over(w).isNull(), "Trail Start").otherwise("s").alias("from_name"),
        F.when(F.lead("km").over(w).isNull(), "Trail End").otherwise("s").alias("to_name"), F.col("ele").alias("walked_km"), (k % 900).alias("ascent_m"), (k % 9).alias("days"), (k % 9 * 777).alias("food_g"), (k % 2).alias("zero_days"),
    )
    return resupply.plan_summary(legs)


@register(
    "win28_side_trip_climb",
    f"""WITH {PTS}, s AS (SELECT trail_id, idx, {_STEP} AS step, coalesce(ele - lag(ele) OVER w, 0) AS rise FROM pts WINDOW w AS (PARTITION BY trail_id ORDER BY idx)), b AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY trail_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s),
t AS (SELECT trail_id, sum(greatest(rise, 0)) AS ua, sum(greatest(-rise, 0)) AS da, coalesce(sum(greatest(rise, 0)) FILTER (WHERE before < 20000 OR before = 0), 0) AS u, coalesce(sum(greatest(-rise, 0)) FILTER (WHERE before < 20000 OR before = 0), 0) AS d FROM b GROUP BY trail_id)
SELECT trail_id AS trip_id, {rnd('CASE WHEN trail_id % 2 = 0 AND ua > 0 THEN u * 500.0 / ua ELSE u END', 0)} AS ascent_m, {rnd('CASE WHEN trail_id % 2 = 0 AND da > 0 THEN d * 300.0 / da ELSE d END', 0)} AS descent_m FROM t""",
)
def win28(spark, sf_dir):
    p = pts(spark, sf_dir).withColumnRenamed("trail_id", "trip_id")
    even = F.col("trip_id") % 2 == 0
    reach = p.select("trip_id").distinct().select("trip_id", F.lit(20.0).alias("along_km"), F.when(even, 500.0).alias("ascent"), F.when(even, 300.0).alias("descent"))
    return resupply.climb_along(p, reach)
