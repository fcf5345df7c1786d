"""Queries that put several operators together, and those on placements, days and corridors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trekframe.functions.rounding import js_round
from trekframe.operators import linkage, matching, ordered, sequential, spatial, sync, track
from trekframe.plans.places import _T
from trekframe.plans.registry import register
from trekframe.plans.tables import CUST, ENDS, PTS, SUPP, cust, ends, hav, pts, rnd, supp, table
from trekframe.plans.tracks import DIST, measured


def _suppliers_track(spark, sf_dir):
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot_id"), F.col("s_nationkey").alias("trail_id"))
    rows = supp(spark, sf_dir).join(nation, "spot_id")
    idx = (F.row_number().over(Window.partitionBy("trail_id").orderBy("lon", "spot_id")) - 1).cast("long")
    return track.cumulative_km(rows.withColumn("idx", idx).withColumn("is_break", F.lit(False)))


def _nearest_segment(most: str) -> str:
    return f"""WITH {CUST}, {SUPP}, route AS (SELECT s_nationkey AS trail_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY lon, spot_id) - 1 AS BIGINT) AS idx, lat, lon FROM supp JOIN supplier ON s_suppkey = spot_id),
g AS (SELECT trail_id, idx, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM route WINDOW w AS (PARTITION BY trail_id ORDER BY idx)),
t AS (SELECT place_id, c.lat, c.lon, g.*, coalesce({_T}, 0.0) AS t FROM cust c, g WHERE lat2 IS NOT NULL), d AS (SELECT place_id, trail_id, idx, {hav('lat', 'lon', 'lat1 + (lat2 - lat1) * t', 'lon1 + (lon2 - lon1) * t')} AS m FROM t),
b AS (SELECT place_id, min({{'m': m, 't': trail_id, 'i': idx}}) AS b FROM d {most} GROUP BY place_id) SELECT place_id, b.t AS trail_id, b.i AS idx, {rnd('b.m', 2)} AS metres FROM b"""


@register("jon15_bounded_nearest", _nearest_segment("WHERE m <= 60000"))
def jon15(spark, sf_dir):
    snapped = spatial.snap_to_track(cust(spark, sf_dir), _suppliers_track(spark, sf_dir), 60_000)
    return snapped.select("place_id", "trail_id", "idx", js_round("metres", 2).alias("metres"))


@register("jon16_exact_nearest", _nearest_segment(""))
def jon16(spark, sf_dir):
    """The nearest segment of any track, however far it is (JON16)."""
    found = spatial.nearest_on_route(cust(spark, sf_dir), _suppliers_track(spark, sf_dir), 30_000)
    return found.select("place_id", "trail_id", "idx", js_round("metres", 2).alias("metres"))


@register("jon47_straight_line_access", f"WITH n AS ({_nearest_segment('WHERE m <= 60000')}) SELECT c_custkey AS place_id, CASE WHEN c_custkey % 3 = 0 THEN 1.25 ELSE {rnd('metres / 1000', 2)} END AS off_km FROM customer LEFT JOIN n ON place_id = c_custkey")
def jon47(spark, sf_dir):
    from trekframe.operators.routes import straight_line_access

    rows = cust(spark, sf_dir).select("place_id", "lat", "lon", F.when(F.col("place_id") % 3 == 0, 1.25).alias("off_km"))
    return straight_line_access(rows, _suppliers_track(spark, sf_dir), 60_000).select("place_id", js_round("off_km", 2).alias("off_km"))


_PIECES = "pc AS (SELECT trail_id, 1 AS rank, 0.0 AS f, 30.0 AS t, 100.0 AS s FROM ends UNION ALL SELECT trail_id, 1, 40.0, 1e4, 140.0 FROM ends UNION ALL SELECT trail_id, 2, 25.0, 45.0, 500.0 FROM ends)"


@register("jon29_route_to_plan", f"WITH {PTS}, {ENDS}, {_PIECES}, b AS (SELECT event_id, any_value(km) AS km, min({{'r': rank, 's': s, 'f': f}}) AS b FROM pts LEFT JOIN pc ON pc.trail_id = pts.trail_id AND pts.km BETWEEN f AND t GROUP BY event_id) SELECT event_id, {rnd('b.s + km - b.f', 6)} AS route_km FROM b")
def jon29(spark, sf_dir):
    """Kilometres carried over by main pieces first and by an alternate where no main piece holds them (JON29)."""
    rows = [(1, 0.0, 30.0, 100.0), (1, 40.0, 1e4, 140.0), (2, 25.0, 45.0, 500.0)]
    piece = F.inline(F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(a).alias("from_km"), F.lit(b).alias("to_km"), F.lit(s).alias("route_start")) for r, a, b, s in rows)))
    pieces = ends(spark, sf_dir).select("trail_id", piece)
    return ordered.map_piecewise(pts(spark, sf_dir).select("trail_id", "event_id", "km"), pieces).select("event_id", js_round("route_km", 6).alias("route_km"))


@register(
    "jon30_alternate_axis",
    f"WITH {PTS} SELECT event_id, {rnd('CASE WHEN event_type IN (' + repr('click') + ', ' + repr('view') + ') AND ele BETWEEN 19.9 AND 40.1 THEN 7.0 + least(40.0, greatest(20.0, ele)) - 20.0 END', 6)} AS route_km FROM pts",
)
def jon30(spark, sf_dir):
    p = pts(spark, sf_dir)
    pieces = p.select("trail_id", F.explode(F.array(F.lit("click"), F.lit("view"))).alias("name")).distinct().withColumns({"from_km": F.lit(20.0), "to_km": F.lit(40.0), "route_start": F.lit(7.0)})
    out = ordered.alternate_km(p.select("event_id", "trail_id", F.col("event_type").alias("name"), F.col("ele").alias("km")), pieces)
    return out.select("event_id", js_round("route_km", 6).alias("route_km"))


@register(
    "jon36_placement_guards",
    f"""WITH {CUST}, w AS (SELECT place_id, lat, lon, place_id % 900 AS track_m, CASE WHEN place_id % 3 > 0 THEN lat + 0.005 * (place_id % 5) END AS jl, place_id % 80 AS jm FROM cust),
s AS (SELECT *, CASE WHEN jl IS NULL THEN 'unlisted' WHEN track_m > 500 AND NOT {hav('jl', 'lon', 'lat', 'lon')} <= 1.0 * 1000 + 100 THEN 'far' WHEN jm > 50 THEN 'stale' ELSE 'placed' END AS state FROM w)
SELECT place_id AS waypoint_id, state, {rnd("CASE WHEN state = 'placed' THEN jl ELSE lat END", 6)} AS lat FROM s""",
)
def jon36(spark, sf_dir):
    k = F.col("place_id")
    w = cust(spark, sf_dir)
    waypoints = w.select(k.alias("waypoint_id"), "lat", "lon", (k % 900).alias("track_m"))
    placements = w.where(k % 3 > 0).select(k.alias("waypoint_id"), (F.col("lat") + 0.005 * (k % 5)).alias("j_lat"), F.col("lon").alias("j_lon"), F.lit(1.0).alias("off_km"), (k % 80).alias("junction_m"))
    return linkage.placed_at_junctions(waypoints, placements, 500.0).select("waypoint_id", "state", js_round("lat", 6).alias("lat"))


@register("jon37_description_override", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'said ' || p_partkey ELSE p_name END AS description FROM part")
def jon37(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("description"))
    new = rows.where("p_partkey % 4 = 0").select("p_partkey", F.concat(F.lit("said "), "p_partkey").alias("description"))
    return linkage.apply_overrides(rows, new.unionByName(new.select((-F.col("p_partkey") - 1).alias("p_partkey"), "description")), "p_partkey", "description")[0]


@register("jon37_unmatched_overrides", "SELECT p_partkey FROM part WHERE p_partkey % 4 = 0")
def jon37_unmatched(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") + 10_000_000).alias("p_partkey"), F.col("p_name").alias("description"))
    new = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select("p_partkey", F.lit("x").alias("description"))
    return linkage.apply_overrides(rows, new, "p_partkey", "description")[1].select("p_partkey")


@register("jon40_known_retraces")
def jon40(spark, sf_dir):
    """Retraces paired with entries near their turn and of about their length, one to one by distance; held against brute
    force in the tests, as the greedy choice is beyond SQL."""
    p = pts(spark, sf_dir)
    a = p.where("event_type = 'purchase'").select("trail_id", F.col("event_id").alias("a"), F.col("km").alias("at"), F.col("ele").alias("long"))
    b = p.where("event_type = 'click'").select("trail_id", F.col("event_id").alias("b"), F.col("km").alias("bt"), F.col("ele").alias("b_long"))
    cell = lambda c, d: F.floor(F.col(c)) + d
    a = a.withColumn("cell", F.explode(F.array(cell("at", -1), cell("at", 0), cell("at", 1))))
    met = a.join(b.withColumn("cell", cell("bt", 0)), ["trail_id", "cell"])
    fit = (F.abs(F.col("at") - F.col("bt")) <= 1) & (F.abs(F.col("long") - F.col("b_long")) <= F.greatest(F.lit(0.5), 0.15 * F.col("long")))
    pairs = met.where(fit).select("trail_id", "a", "b", (F.abs(F.col("at") - F.col("bt")) * 1000).alias("metres"))
    return matching.greedy_matching(pairs, ["trail_id", "a"], ["trail_id", "b"], ["metres"]).select("trail_id", "a", "b")


@register("jon41_first_id_lookup", "SELECT o_orderkey, f.n FROM orders LEFT JOIN (SELECT user_id, arg_min(event_type, event_id) AS n FROM events GROUP BY user_id) f ON f.user_id = o_custkey")
def jon41(spark, sf_dir):
    named = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), "event_id", F.col("event_type").alias("n"))
    return linkage.first_lookup(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), named, "o_custkey", "event_id", "n").select("o_orderkey", "n")


@register(
    "jon42_resupply_candidates",
    """WITH u AS (SELECT p_name AS id, p_partkey AS seq, 0 AS src FROM part WHERE p_size > 30 UNION ALL SELECT p_name, p_partkey, 1 FROM part WHERE p_size BETWEEN 15 AND 30 UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name END, p_partkey, 2 FROM part WHERE p_size < 15),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY src, seq) AS n FROM u) SELECT id, seq FROM r WHERE n = 1 OR id IS NULL""",
)
def jon42(spark, sf_dir):
    """Main, side-trip and off-route places; of one id the first source counts, rows without id all do."""
    p = table(spark, sf_dir, "part")
    rows = lambda where, name: p.where(where).select(name.alias("id"), F.col("p_partkey").alias("seq"))
    n = F.col("p_name")
    return linkage.union_first_wins(rows("p_size > 30", n), rows("p_size between 15 and 30", n), rows("p_size < 15", F.when(F.col("p_partkey") % 2 == 0, n)))


@register(
    "jon43_placed_by_users",
    f"""WITH n AS ({_nearest_segment('WHERE m <= 30000')}), d AS (SELECT trail_id, idx AS spot, 0 AS kind, place_id FROM n UNION ALL SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY lon, spot_id) - 1, 1, spot_id FROM (SELECT s_suppkey AS spot_id, (s_suppkey * 3571 % 9000) / 1000.0 + 144 AS lon, s_nationkey FROM supplier) x)
SELECT trail_id, kind, place_id, CAST(row_number() OVER (PARTITION BY trail_id ORDER BY spot, kind DESC, place_id) AS INT) AS place FROM d""",
)
def jon43(spark, sf_dir):
    """Travellers' own places set on the track near them and sorted in among its rows (JON43)."""
    line = _suppliers_track(spark, sf_dir)
    own = spatial.snap_to_track(cust(spark, sf_dir), line, 30_000).select("trail_id", F.col("idx").alias("at"), F.lit(0).alias("kind"), "place_id")
    both = own.unionByName(line.select("trail_id", F.col("idx").alias("at"), F.lit(1).alias("kind"), F.col("spot_id").alias("place_id")))
    w = Window.partitionBy("trail_id").orderBy("at", F.desc("kind"), "place_id")
    return both.select("trail_id", "kind", "place_id", F.row_number().over(w).alias("place"))


@register(
    "jon45_variant_visits",
    f"""WITH {PTS}, v AS (SELECT trail_id * 10 + idx // 20 AS variant, idx, lat, lon FROM pts), pl AS (SELECT c_custkey AS place_id, -35 + (c_custkey * 37 % 1000) / 10000.0 AS lat, 148 + (c_custkey * 53 % 1000) / 10000.0 AS lon FROM customer),
d AS (SELECT place_id, variant, idx, {hav('pl.lat', 'pl.lon', 'v.lat', 'v.lon')} AS m FROM pl, v), n AS (SELECT * FROM d WHERE m <= 1500), r AS (SELECT *, idx - row_number() OVER (PARTITION BY place_id, variant ORDER BY idx) AS run FROM n)
SELECT place_id, variant, b.i AS idx, {rnd('3.0 * (variant % 10) + b.i', 2)} AS km FROM (SELECT place_id, variant, min({{'m': m, 'i': idx}}) AS b FROM r GROUP BY place_id, variant, run HAVING min(m) <= 500) y""",
)
def jon45(spark, sf_dir):
    """Visits of each variant on its own, with kilometres that go on from its junction (JON45)."""
    k = F.col("c_custkey")
    places = table(spark, sf_dir, "customer").select(k.alias("place_id"), (-35 + (k * 37 % 1000) / 10000.0).alias("lat"), (148 + (k * 53 % 1000) / 10000.0).alias("lon"))
    lines = pts(spark, sf_dir).select((F.col("trail_id") * 10 + F.floor(F.col("idx") / 20)).alias("trail_id"), "idx", "lat", "lon")
    met = spatial.visits(places, lines, 500)
    return met.select("place_id", F.col("trail_id").alias("variant"), "idx", js_round(3.0 * (F.col("trail_id") % 10) + F.col("idx"), 2).alias("km"))


@register(
    "jon52_stop_issues",
    "SELECT o_custkey AS plan, o_orderkey AS stop, CASE WHEN o_orderkey % 5 > 0 AND s_suppkey IS NULL THEN 'missing' WHEN o_orderkey % 90 > 60 THEN 'off-route' WHEN o_orderkey % 5 > 0 AND abs(s_suppkey * 2.0 - o_orderkey % 90) > 9 THEN 'moved' END AS issue FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 14 WHERE issue IS NOT NULL",
)
def jon52(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    stops = o.select(F.col("o_custkey").alias("plan"), k.alias("stop"), F.when(k % 5 > 0, k % 14).alias("waypoint_id"), (k % 90).alias("km"))
    places = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("waypoint_id"), (F.col("s_suppkey") * 2.0).alias("place_km"))
    return linkage.stop_issues(stops, places, o.select(F.col("o_custkey").alias("plan")).distinct().withColumn("total_km", F.lit(60.0)), 9.0)


@register(
    "prj04_index_entries",
    f"""WITH {PTS} SELECT c_custkey AS id, c_name AS name, c_mktsegment AS region, CASE WHEN c_custkey % 2 = 0 THEN 'AU' END AS country, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_nationkey ELSE '' END AS states, {rnd('lat', 5)} AS lat FROM customer LEFT JOIN pts ON trail_id = c_custkey AND idx = 0""",
)
def prj04(spark, sf_dir):
    k = F.col("c_custkey")
    configs = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("region"), F.when(k % 2 == 0, "au").alias("country"), F.when(k % 3 == 0, F.array(F.concat(F.lit("s"), "c_nationkey"))).alias("states"))
    out = linkage.index_entries(configs, pts(spark, sf_dir).withColumnRenamed("trail_id", "id"))
    return out.select("id", "name", "region", "country", F.array_join("states", ",").alias("states"), F.col("start.lat").alias("lat"))


@register(
    "srt25_guide_sections",
    """WITH s AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey = 7 THEN 0 WHEN n_nationkey % 3 = 0 THEN 1 WHEN n_nationkey % 3 = 1 THEN 2 ELSE 3 END AS section, CASE WHEN n_nationkey <> 7 AND n_nationkey % 3 = 0 THEN n_regionkey END AS c, lower(n_name) AS n FROM nation WHERE contains(lower(n_name), 'n') OR n_nationkey = 7)
SELECT id, section, CAST(row_number() OVER (ORDER BY section, c NULLS FIRST, n, id) AS INT) AS place FROM s""",
)
def srt25(spark, sf_dir):
    k = F.col("n_nationkey")
    source = F.when(k % 3 == 0, "curated").when(k % 3 == 1, "community").otherwise("imported")
    rows = table(spark, sf_dir, "nation").select(k.cast("string").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("country"), source.alias("source"))
    return linkage.sectioned(rows, " N ", "7").select(F.col("id").cast("long").alias("id"), "section", "place")


@register("agg12_status_by_waypoint", "WITH t AS (SELECT l_partkey AS waypoint_id, l_returnflag AS status, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY waypoint_id ORDER BY n DESC, status) AS r FROM t) SELECT waypoint_id, status, n FROM r WHERE r = 1")
def agg12(spark, sf_dir):
    """Reports grouped by waypoint; all of one day, so that each weighs the same."""
    reports = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("waypoint_id"), F.col("l_returnflag").alias("status"), F.lit(1_000_000_000).cast("long").alias("time_ms"))
    return ordered.decayed_vote(reports, 1_000_000_000).select("waypoint_id", "status", "n")


@register("agg19_route_totals", f"WITH {DIST} SELECT trail_id, {rnd('max(dist)', 3)} AS km, {rnd('max(cum_ascent)', 2)} AS ascent, {rnd('max(cum_descent)', 2)} AS descent FROM m GROUP BY trail_id")
def agg19(spark, sf_dir):
    return track.route_stats(pts(spark, sf_dir)).select("trail_id", "km", "ascent", "descent")


@register(
    "agg24_section_summary",
    f"""WITH {PTS}, {ENDS}, s AS (SELECT trail_id, least(end_km, 10.0) AS a, least(end_km, 60.0) AS b FROM ends), k AS (SELECT trail_id, km, min(CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 0.0 END) AS w FROM pts WHERE event_type = 'view' GROUP BY trail_id, km),
i AS (SELECT k.trail_id, km, w FROM k JOIN s USING (trail_id) WHERE km >= a AND km <= b), e AS (SELECT trail_id, unnest([a, b]) AS km FROM s), m AS (SELECT * FROM i UNION ALL SELECT trail_id, km, 0.0 FROM e WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.trail_id = e.trail_id AND i.km = e.km)),
l AS (SELECT *, lead(km) OVER x AS t, lead(w) OVER x AS w2 FROM m WINDOW x AS (PARTITION BY trail_id ORDER BY km)), g AS (SELECT trail_id, t - km + w + w2 AS gap FROM l WHERE t > km)
SELECT trail_id, {rnd('max(gap)', 4)} AS longest_km, count(*) FILTER (WHERE {rnd('gap', 6)} >= 1.5) AS n_dry, count(*) AS n_gaps FROM g GROUP BY trail_id""",
)
def agg24(spark, sf_dir):
    """Water gaps of one section of each trail (AGG24)."""
    p = pts(spark, sf_dir)
    sources = p.where("event_type = 'view'").select("trail_id", "km", F.when(F.col("event_id") % 4 == 0, 0.5).alias("walk_km"))
    part = ends(spark, sf_dir).select("trail_id", F.least("end_km", F.lit(10.0)).alias("start_km"), F.least("end_km", F.lit(60.0)).alias("end_km"))
    gaps = ordered.water_gaps(sources, part, 1.5).withColumn("dry", js_round("gap_km", 6) >= 1.5)
    return ordered.gap_summary(gaps).withColumn("longest_km", js_round("longest_km", 4))


@register("agg27_batch_stats", f"WITH {DIST} SELECT trail_id, count(*) AS n, {rnd('max(cum_ascent)', 3)} AS ascent, CAST(sum(octet_length(encode(event_type))) AS BIGINT) AS bytes FROM m GROUP BY trail_id")
def agg27(spark, sf_dir):
    return track.batch_stats(pts(spark, sf_dir), "event_type")


@register("agg31_recent_counts", "WITH t AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ms FROM events) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS n FROM t")
def agg31(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return ordered.count_in_window(rows, 86_400_000).select("event_id", "n")


@register(
    "agg32_climb_totals",
    f"""WITH RECURSIVE {PTS}, r AS (SELECT trail_id, idx, ele AS at, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss FROM pts WHERE idx = 0
UNION ALL SELECT p.trail_id, p.idx, CASE WHEN p.is_break OR abs(p.ele - r.at) >= 20 THEN p.ele ELSE r.at END, r.gain + CASE WHEN NOT p.is_break AND p.ele - r.at >= 20 THEN p.ele - r.at ELSE 0 END, r.loss + CASE WHEN NOT p.is_break AND r.at - p.ele >= 20 THEN r.at - p.ele ELSE 0 END
FROM r JOIN pts p ON p.trail_id = r.trail_id AND p.idx = r.idx + 1) SELECT trail_id, {rnd('max(gain)', 3)} AS gain, {rnd('max(loss)', 3)} AS loss FROM r GROUP BY trail_id""",
)
def agg32(spark, sf_dir):
    return track.hysteresis_climb(pts(spark, sf_dir), 20.0).select("trail_id", js_round("gain", 3).alias("gain"), js_round("loss", 3).alias("loss"))


@register("agg33_bounds", f"WITH {PTS} SELECT trail_id, {rnd('min(lat) - 0.01', 6)} AS south, {rnd('max(lat) + 0.01', 6)} AS north, {rnd('min(lon) - 0.01', 6)} AS west, {rnd('max(lon) + 0.01', 6)} AS east FROM pts GROUP BY trail_id")
def agg33(spark, sf_dir):
    return spatial.bounds(pts(spark, sf_dir), 0.01).select("trail_id", *(js_round(c, 6).alias(c) for c in ("south", "north", "west", "east")))


@register(
    "win22_reversed_trails",
    f"""WITH {DIST}, t AS (SELECT trail_id, max(idx) AS last, max(dist) AS total, max(cum_ascent) AS up, max(cum_descent) AS down FROM m GROUP BY trail_id), b AS (SELECT trail_id, last + 1 - idx AS idx FROM m JOIN t USING (trail_id) WHERE is_break AND idx > 0),
r AS (SELECT trail_id, last - idx AS idx, total - dist AS dist, down - cum_descent AS a FROM m JOIN t USING (trail_id)) SELECT r.trail_id, r.idx, {rnd('dist', 4)} AS dist, {rnd('a', 3)} AS cum_ascent, b.idx IS NOT NULL AS is_break FROM r LEFT JOIN b ON b.trail_id = r.trail_id AND b.idx = r.idx""",
)
def win22(spark, sf_dir):
    """Whole trails the other way: points, climb and breaks (WIN20-22, WIN33)."""
    out = track.reverse_trail(measured(spark, sf_dir))
    return out.select("trail_id", "idx", js_round("dist", 4).alias("dist"), js_round("cum_ascent", 3).alias("cum_ascent"), "is_break")


@register(
    "win32_recomputed_elevation",
    f"""WITH {DIST}, e AS (SELECT trail_id, idx, dist, is_break, CASE WHEN idx % 3 = 0 THEN abs(lat) * 20 + lon WHEN idx % 3 = 1 THEN ele END AS v FROM m),
n AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'d': dist, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY trail_id ORDER BY idx) AS p, first_value(CASE WHEN v IS NOT NULL THEN {{'d': dist, 'v': v}} END IGNORE NULLS) OVER (PARTITION BY trail_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM e),
f AS (SELECT trail_id, idx, is_break, coalesce(p.v + (q.v - p.v) * coalesce((dist - p.d) / nullif(q.d - p.d, 0), 0), p.v, q.v, 0.0) AS h FROM n),
g AS (SELECT *, CASE WHEN is_break THEN 0.0 ELSE coalesce(h - lag(h) OVER (PARTITION BY trail_id ORDER BY idx), 0.0) END AS rise FROM f)
SELECT trail_id, idx, {rnd('h', 3)} AS ele, {rnd('sum(greatest(rise, 0.0)) OVER (PARTITION BY trail_id ORDER BY idx)', 1)} AS cum_ascent FROM g""",
)
def win32(spark, sf_dir):
    """Heights of a sampler where it has one, those known else, and what hangs on them; every third is drawn between."""
    m = measured(spark, sf_dir).withColumn("ele", F.when(F.col("idx") % 3 == 1, F.col("ele")))
    m = m.withColumns({"at": F.col("lat"), "lat": F.when(F.col("idx") % 3 == 0, F.col("lat"))})
    out = track.recompute_elevation(m, lambda lat, lon: F.abs(lat) * 20 + lon)
    return out.select("trail_id", "idx", js_round("ele", 3).alias("ele"), js_round("cum_ascent", 1).alias("cum_ascent"))


@register("win38_walkable_runs", f"WITH {PTS}, s AS (SELECT trail_id, idx, sum(is_break::INT) OVER (PARTITION BY trail_id ORDER BY idx) AS r FROM pts WHERE idx BETWEEN 5 AND 40) SELECT trail_id, idx, r - first_value(r) OVER (PARTITION BY trail_id ORDER BY idx) AS run FROM s")
def win38(spark, sf_dir):
    runs = track.split_at_breaks(pts(spark, sf_dir).where("idx between 5 and 40"))
    return runs.select("trail_id", "idx", (F.col("stretch") - F.first("stretch").over(Window.partitionBy("trail_id").orderBy("idx"))).alias("run"))


@register("srt13_greedy_days")
def srt13(spark, sf_dir):
    """Nights of about six hours each; a choice hangs on the one before, so there is no twin, see the tests."""
    m = measured(spark, sf_dir)
    camps = m.where("event_type = 'purchase'").select("trail_id", F.col("dist").alias("km"), F.col("event_id").alias("camp"))
    return sequential.day_stops(camps, m.select("trail_id", F.col("dist").alias("km"), F.col("cum_ascent").alias("ascent")), 6.0).withColumn("km", js_round("km", 4))


@register(
    "sim04_corridor_chunks",
    f"""WITH {PTS}, g AS (SELECT trail_id, idx, idx // 2 AS s, lag(idx // 2) OVER w AS b, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS gap FROM pts WINDOW w AS (PARTITION BY trail_id ORDER BY idx)),
l AS (SELECT trail_id, idx, sum(CASE WHEN coalesce(b <> s AND gap > 8000, false) THEN 1 ELSE 0 END) OVER (PARTITION BY trail_id ORDER BY idx) AS line FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY trail_id, line ORDER BY idx) - 1 AS k, count(*) OVER (PARTITION BY trail_id, line) AS n FROM l),
c AS (SELECT trail_id, idx, line, unnest(range(0, greatest(1, CAST(ceil((n - 1) / 4.0) AS BIGINT)))) AS c, k, n FROM k)
SELECT trail_id, idx, CAST(line AS BIGINT) AS line, c AS chunk FROM c WHERE n <= 5 OR k BETWEEN c * 4 AND c * 4 + 4""",
)
def sim04(spark, sf_dir):
    """Stretches of two rows each, joined over gaps of up to 8 km, in chunks of five rows that overlap by one."""
    rows = pts(spark, sf_dir).withColumn("stretch", F.floor(F.col("idx") / 2))
    return sequential.corridor_chunks(rows, 4000.0, most=5)


@register(
    "sim06_cells_by_bytes",
    f"""WITH RECURSIVE {PTS}, r AS (SELECT trail_id, idx, CAST(event_id % 90 AS DOUBLE) AS used, 0 AS n FROM pts WHERE idx = 0
UNION ALL SELECT p.trail_id, p.idx, CASE WHEN r.used + p.event_id % 90 <= 250 OR r.used = 0 THEN r.used + p.event_id % 90 ELSE p.event_id % 90 END, r.n + CASE WHEN r.used + p.event_id % 90 <= 250 OR r.used = 0 THEN 0 ELSE 1 END FROM r JOIN pts p ON p.trail_id = r.trail_id AND p.idx = r.idx + 1)
SELECT trail_id, CAST(max(n) + 1 AS INT) AS n_batches FROM r GROUP BY trail_id""",
)
def sim06(spark, sf_dir):
    rows = pts(spark, sf_dir).select("trail_id", F.col("idx").alias("seq"), (F.col("event_id") % 90).cast("double").alias("size"))
    return sequential.pack_in_order(rows, 250.0).select("trail_id", (F.array_max("batches") + 1).alias("n_batches"))


@register("sim12_candidate_clusters")
def sim12(spark, sf_dir):
    """Boxes along each trail, each into the first cluster that it overlaps; the order counts, so see the tests."""
    p = pts(spark, sf_dir)
    box = p.select("trail_id", F.col("event_id").alias("id"), "km", (F.col("lon") - 0.01).alias("west"), (F.col("lat") - 0.01).alias("south"), (F.col("lon") + 0.01).alias("east"), (F.col("lat") + 0.01).alias("north"))
    return sequential.cluster_candidates(box, 6.0)


@register("sim19_contour_index", "SELECT event_id, CAST(floor(value * 10) AS INT) AS elevation, CASE WHEN CAST(floor(value * 10) AS INT) % 50 = 0 THEN 1 ELSE 0 END AS is_index FROM events")
def sim19(spark, sf_dir):
    height = F.floor(F.col("value") * 10).cast("int")
    return table(spark, sf_dir, "events").select("event_id", height.alias("elevation"), track.contour_index(height, 50).alias("is_index"))


@register("sim21_finished_places")
def sim21(spark, sf_dir):
    """Places through the whole chain: on the track, no noise, no copies, thinned, slim; held against its steps in the tests."""
    from trekframe.plans.pois import places

    rows = places(spark, sf_dir).join(pts(spark, sf_dir).select("event_id", "lat", "lon"), "event_id").select(F.col("event_id").alias("place_id"), "name", "tags", (F.col("lat") + 0.0005).alias("lat"), "lon")
    line = measured(spark, sf_dir)
    waypoints = line.where("event_type = 'purchase'").select(F.col("event_id").alias("waypoint_id"), F.lit("campsite").alias("type"), F.lit("Ponderosa").alias("wp_name"), "lat", "lon")
    out = linkage.finish_places(rows, line, waypoints, 120.0, 5.0, [("amenity", "fuel")])
    return out.withColumn("tags", F.to_json("tags"))


@register("stm05_pruned_state", "SELECT event_id FROM events WHERE event_id * 1000 > 300000")
def stm05(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 1000).alias("ms"))
    return sync.prune_stale(rows, 900_000, 600_000).select("event_id")


@register("udf01_build_hooks", f"WITH {PTS}, h AS (SELECT trail_id, idx, ele * 0.3048 AS e, is_break FROM pts WHERE ele > 5), r AS (SELECT *, CASE WHEN is_break THEN 0.0 ELSE coalesce(e - lag(e) OVER (PARTITION BY trail_id ORDER BY idx), 0.0) END AS rise FROM h) SELECT trail_id, count(*) AS n, {rnd('sum(greatest(rise, 0.0))', 4)} AS ascent FROM r GROUP BY trail_id")
def udf01(spark, sf_dir):
    """A track built with two steps of the caller's own: rows left out, and feet turned to metres."""
    built = track.build_trail(pts(spark, sf_dir), lambda p: p.where("ele > 5"), lambda p: p.withColumn("ele", F.col("ele") * 0.3048))
    return built.groupBy("trail_id").agg(F.count("*").alias("n"), js_round(F.max("cum_ascent"), 4).alias("ascent"))


@register("udf04_first_containing_by_column", f"WITH {PTS} SELECT event_id, CASE WHEN ele * 2 < 60 THEN 1 WHEN ele * 2 <= 120 THEN 2 ELSE 0 END AS number FROM pts")
def udf04(spark, sf_dir):
    """The kilometre of a row is whatever column expression the caller gives (UDF04)."""
    p = pts(spark, sf_dir).select("event_id", "trail_id", (F.col("ele") * 2).alias("km"))
    spans = p.select("trail_id").distinct().select("trail_id", F.inline(F.array(*(F.struct(F.lit(a).alias("from_km"), F.lit(b).alias("to_km"), F.lit(n).alias("number")) for a, b, n in ((0.0, 59.999999999, 1), (60.0, 120.0, 2))))))
    return ordered.first_containing(p, spans).select("event_id", "number")
