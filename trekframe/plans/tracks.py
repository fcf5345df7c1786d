"""Queries on ordered tracks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trekframe.functions.rounding import js_round
from trekframe.operators import ordered, track
from trekframe.plans.registry import register
from trekframe.plans.tables import ENDS, PTS, ends, hav, pts, rnd

_STEP = hav("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")
_W = "WINDOW w AS (PARTITION BY trail_id ORDER BY idx)"
DIST = f"""{PTS}, st AS (SELECT *, CASE WHEN is_break OR lag(lat) OVER w IS NULL THEN 0.0 ELSE {_STEP} END AS step,
  CASE WHEN is_break THEN 0.0 ELSE coalesce(ele - lag(ele) OVER w, 0.0) END AS rise FROM pts {_W}),
m AS (SELECT *, sum(step) OVER w / 1000.0 AS dist, sum(greatest(rise, 0.0)) OVER w AS cum_ascent, sum(greatest(-rise, 0.0)) OVER w AS cum_descent FROM st {_W})"""


def measured(spark, sf_dir):
    return track.cumulative_climb(track.cumulative_km(pts(spark, sf_dir)))


@register("win01_cumulative_km", f"WITH {DIST} SELECT trail_id, idx, {rnd('dist', 4)} AS dist FROM m")
def win01(spark, sf_dir):
    return track.cumulative_km(pts(spark, sf_dir)).select("trail_id", "idx", js_round("dist", 4).alias("dist"))


@register("win02_cumulative_climb", f"WITH {DIST} SELECT trail_id, idx, {rnd('cum_ascent', 3)} AS cum_ascent, {rnd('cum_descent', 3)} AS cum_descent FROM m")
def win02(spark, sf_dir):
    return track.cumulative_climb(pts(spark, sf_dir)).select("trail_id", "idx", js_round("cum_ascent", 3).alias("cum_ascent"), js_round("cum_descent", 3).alias("cum_descent"))


@register(
    "win03_hysteresis_climb",
    f"""WITH RECURSIVE {PTS}, r AS (SELECT trail_id, idx, ele AS at, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss FROM pts WHERE idx = 0
UNION ALL SELECT p.trail_id, p.idx, CASE WHEN p.is_break OR abs(p.ele - r.at) >= 3 THEN p.ele ELSE r.at END,
  r.gain + CASE WHEN NOT p.is_break AND p.ele - r.at >= 3 THEN p.ele - r.at ELSE 0 END, r.loss + CASE WHEN NOT p.is_break AND r.at - p.ele >= 3 THEN r.at - p.ele ELSE 0 END
FROM r JOIN pts p ON p.trail_id = r.trail_id AND p.idx = r.idx + 1)
SELECT trail_id, {rnd('max(gain)', 3)} AS gain, {rnd('max(loss)', 3)} AS loss FROM r GROUP BY trail_id""",
)
def win03(spark, sf_dir):
    out = track.hysteresis_climb(pts(spark, sf_dir), 3.0)
    return out.select("trail_id", js_round("gain", 3).alias("gain"), js_round("loss", 3).alias("loss"))


@register(
    "win04_smooth_elevation",
    f"""WITH {PTS} SELECT trail_id, idx, {rnd('''CASE WHEN count(*) OVER (PARTITION BY trail_id) < 7 THEN ele
  ELSE avg(ele) OVER (PARTITION BY trail_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END''', 4)} AS smooth FROM pts""",
)
def win04(spark, sf_dir):
    return track.smooth_elevation(pts(spark, sf_dir), 7).select("trail_id", "idx", js_round("smooth", 4).alias("smooth"))


@register(
    "win05_remove_spikes",
    f"""WITH {PTS}, s AS (SELECT *, coalesce((ele - lag(ele) OVER w > 10 AND ele - lead(ele) OVER w > 10) OR (ele - lag(ele) OVER w < -10 AND ele - lead(ele) OVER w < -10), false) AS spike FROM pts {_W}),
k AS (SELECT *, max(CASE WHEN NOT spike THEN idx END) OVER (PARTITION BY trail_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi,
  min(CASE WHEN NOT spike THEN idx END) OVER (PARTITION BY trail_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ni FROM s)
SELECT k.trail_id, k.idx, {rnd('CASE WHEN k.spike THEN coalesce(p.ele + (n.ele - p.ele) * (k.idx - k.pi) / (k.ni - k.pi), p.ele, n.ele) ELSE k.ele END', 4)} AS clean
FROM k LEFT JOIN pts p ON p.trail_id = k.trail_id AND p.idx = k.pi LEFT JOIN pts n ON n.trail_id = k.trail_id AND n.idx = k.ni""",
)
def win05(spark, sf_dir):
    return track.remove_spikes(pts(spark, sf_dir), 10.0).select("trail_id", "idx", js_round("clean", 4).alias("clean"))


@register("win24_split_at_breaks", f"WITH {PTS} SELECT trail_id, idx, CAST(sum(is_break::INT) OVER (PARTITION BY trail_id ORDER BY idx) AS BIGINT) AS stretch FROM pts")
def win24(spark, sf_dir):
    return track.split_at_breaks(pts(spark, sf_dir)).select("trail_id", "idx", "stretch")


@register("win37_break_crossings", f"WITH {PTS}, g AS (SELECT *, {_STEP} / 1000.0 AS gap FROM pts {_W}) SELECT trail_id, idx, {rnd('gap', 4)} AS gap_km FROM g WHERE is_break AND gap IS NOT NULL")
def win37(spark, sf_dir):
    return track.break_crossings(pts(spark, sf_dir)).withColumn("gap_km", js_round("gap_km", 4))


@register(
    "agg29_gap_check",
    f"""WITH {PTS}, g AS (SELECT *, {_STEP} / 1000.0 AS step FROM pts {_W})
SELECT trail_id, count(*) FILTER (WHERE step > 5) AS n_gaps, min(idx) FILTER (WHERE step > 5) AS first_idx, {rnd('max(step) FILTER (WHERE step > 5)', 4)} AS longest_km FROM g GROUP BY trail_id""",
)
def agg29(spark, sf_dir):
    return track.gap_check(pts(spark, sf_dir), 5.0).withColumn("longest_km", js_round("longest_km", 4))


@register(
    "win16_lod_rows",
    f"""WITH {DIST}, b AS (SELECT *, coalesce(least(9, floor(dist / nullif(max(dist) OVER (PARTITION BY trail_id), 0) * 10)), 0) AS b, count(*) OVER (PARTITION BY trail_id) AS n FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY trail_id, b ORDER BY ele, idx) AS lo, row_number() OVER (PARTITION BY trail_id, b ORDER BY ele DESC, idx) AS hi FROM b)
SELECT trail_id, idx, ele FROM r WHERE lo = 1 OR hi = 1 OR idx = 0 OR idx = n - 1""",
)
def win16(spark, sf_dir):
    return track.lod_rows(track.cumulative_km(pts(spark, sf_dir)), 10).select("trail_id", "idx", "ele")


@register(
    "win17_resample",
    f"""WITH {PTS}, t AS (SELECT trail_id, max(km) / 19.0 AS step FROM pts GROUP BY trail_id), k AS (SELECT trail_id, step, unnest(range(20)) AS k FROM t)
SELECT k.trail_id, CAST(k.k AS INT) AS k, min(p.idx) AS idx FROM k JOIN pts p ON p.trail_id = k.trail_id AND floor(p.km / k.step) >= k.k WHERE k.step > 0 GROUP BY k.trail_id, k.k""",
)
def win17(spark, sf_dir):
    return track.resample_targets(pts(spark, sf_dir), 20, "km")


@register(
    "win18_interpolate",
    f"""WITH {PTS}, v AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN ele END AS known FROM pts),
k AS (SELECT *, max(CASE WHEN known IS NOT NULL THEN idx END) OVER (PARTITION BY trail_id ORDER BY idx) AS pi,
  min(CASE WHEN known IS NOT NULL THEN idx END) OVER (PARTITION BY trail_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM v)
SELECT k.trail_id, k.idx, {rnd('coalesce(p.known + (n.known - p.known) * coalesce((k.km - p.km) / nullif(n.km - p.km, 0), 0), p.known, n.known)', 4)} AS filled
FROM k LEFT JOIN v p ON p.trail_id = k.trail_id AND p.idx = k.pi LEFT JOIN v n ON n.trail_id = k.trail_id AND n.idx = k.ni""",
)
def win18(spark, sf_dir):
    rows = pts(spark, sf_dir).withColumn("known", F.when(F.col("event_id") % 4 == 0, F.col("ele")))
    return track.interpolate_nulls(rows, "known", "km").select("trail_id", "idx", js_round("filled", 4).alias("filled"))


@register(
    "win21_reverse_track",
    f"""WITH {DIST} SELECT trail_id, max(idx) OVER v - idx AS idx, lat, {rnd('max(dist) OVER v - dist', 4)} AS dist,
  {rnd('max(cum_descent) OVER v - cum_descent', 3)} AS cum_ascent, {rnd('max(cum_ascent) OVER v - cum_ascent', 3)} AS cum_descent FROM m WINDOW v AS (PARTITION BY trail_id)""",
)
def win21(spark, sf_dir):
    out = track.reverse_track(measured(spark, sf_dir))
    return out.select("trail_id", "idx", "lat", js_round("dist", 4).alias("dist"), js_round("cum_ascent", 3).alias("cum_ascent"), js_round("cum_descent", 3).alias("cum_descent"))


@register(
    "sim15_truncate_ends",
    f"""WITH {DIST}, f AS (SELECT *, dist * 1000 >= 9000 AND (max(dist) OVER v - dist) * 1000 >= 9000 AS keep FROM m WINDOW v AS (PARTITION BY trail_id)),
n AS (SELECT *, sum(keep::INT) OVER (PARTITION BY trail_id) AS kept FROM f) SELECT trail_id, idx FROM n WHERE (keep AND kept >= 2) OR (kept < 2 AND idx < 2)""",
)
def sim15(spark, sf_dir):
    return track.truncate_ends(track.cumulative_km(pts(spark, sf_dir)), 9000, 9000).select("trail_id", "idx")


@register(
    "agg16_route_stats",
    f"""WITH {DIST} SELECT trail_id, count(*) AS n, {rnd('max(dist)', 3)} AS km, {rnd('max(cum_ascent)', 2)} AS ascent, {rnd('max(cum_descent)', 2)} AS descent,
  min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east, arg_min(lat, idx) AS start_lat, arg_max(lat, idx) AS end_lat FROM m GROUP BY trail_id""",
)
def agg16(spark, sf_dir):
    return track.route_stats(pts(spark, sf_dir))


@register(
    "agg17_upper_median",
    """WITH r AS (SELECT user_id AS trail_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
SELECT trail_id, v AS median, n FROM r WHERE r = n // 2 + 1""",
)
def agg17(spark, sf_dir):
    return track.upper_median(pts(spark, sf_dir), "trail_id", "ele")


@register(
    "agg18_moving_speed",
    f"""WITH {PTS}, g AS (SELECT trail_id, {_STEP} / 1000.0 AS step, epoch_us(e.ts) / 3.6e9 - lag(epoch_us(e.ts)) OVER w / 3.6e9 AS hours, is_break FROM pts JOIN events e USING (event_id) {_W}),
s AS (SELECT trail_id, {rnd('step / hours', 6)} AS kmh FROM g WHERE NOT is_break AND hours > 0 AND step / hours >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY trail_id ORDER BY kmh) AS r, count(*) OVER (PARTITION BY trail_id) AS n FROM s)
SELECT trail_id, kmh AS median, n FROM r WHERE r = n // 2 + 1 AND n >= 10""",
)
def agg18(spark, sf_dir):
    from trekframe.functions.geo import haversine_m
    from trekframe.plans.tables import table

    w = Window.partitionBy("trail_id").orderBy("idx")
    times = table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("h"))
    rows = pts(spark, sf_dir).join(times, "event_id")
    step = haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")) / 1000.0
    rows = rows.withColumn("step", step).withColumn("hours", F.col("h") - F.lag("h").over(w)).where("not is_break and hours > 0 and step / hours >= 0.5")
    return track.upper_median(rows.withColumn("kmh", js_round(F.col("step") / F.col("hours"), 6)), "trail_id", "kmh").where("n >= 10")


@register(
    "flt15_km_range_in_bounds",
    f"""WITH {PTS}, i AS (SELECT *, lat BETWEEN -34.99 AND -34.92 AND lon BETWEEN 148.0 AND 148.09 AS inside FROM pts),
g AS (SELECT *, idx - sum(inside::INT) OVER (PARTITION BY trail_id ORDER BY idx) AS grp FROM i), h AS (SELECT * FROM g WHERE inside),
n AS (SELECT trail_id, arg_min(grp, {{'d': {hav('lat', 'lon', '(-34.99 + -34.92) / 2', '(148.0 + 148.09) / 2')}, 'i': idx}}) AS grp FROM h GROUP BY trail_id)
SELECT trail_id, min(km) AS from_km, max(km) AS to_km FROM h JOIN n USING (trail_id, grp) GROUP BY trail_id""",
)
def flt15(spark, sf_dir):
    return track.km_range_in_bounds(pts(spark, sf_dir).withColumn("dist", F.col("km")), -34.99, -34.92, 148.0, 148.09)


# --- gaps, islands and lookups along the kilometre axis

_STOPS = "stops AS (SELECT DISTINCT trail_id, km FROM pts WHERE event_type = 'purchase')"
_MARKS = """marks AS (SELECT trail_id, km FROM stops JOIN ends USING (trail_id) WHERE km > start_km AND km < end_km
  UNION SELECT trail_id, start_km FROM ends UNION SELECT trail_id, end_km FROM ends)"""


def stops_of(spark, sf_dir, kind="purchase"):
    return pts(spark, sf_dir).where(F.col("event_type") == kind).select("trail_id", "km").distinct()


@register(
    "win08_consecutive_gaps",
    f"""WITH {PTS}, {ENDS}, {_STOPS}, {_MARKS}, l AS (SELECT trail_id, km AS from_km, lead(km) OVER (PARTITION BY trail_id ORDER BY km) AS to_km FROM marks)
SELECT trail_id, from_km, to_km, {rnd('to_km - from_km', 6)} AS gap_km FROM l WHERE to_km > from_km""",
)
def win08(spark, sf_dir):
    return ordered.consecutive_gaps(stops_of(spark, sf_dir), ends(spark, sf_dir)).withColumn("gap_km", js_round("gap_km", 6))


_WATER = f"""WITH {PTS}, {ENDS}, near AS (SELECT trail_id, km, min(coalesce(ele / 100.0, 0)) AS walk FROM pts WHERE event_type = 'view' GROUP BY trail_id, km),
inn AS (SELECT trail_id, km, walk FROM near JOIN ends USING (trail_id) WHERE km BETWEEN start_km AND end_km),
marks AS (SELECT * FROM inn UNION ALL SELECT trail_id, km, 0.0 FROM (SELECT trail_id, start_km AS km FROM ends UNION SELECT trail_id, end_km FROM ends) s
  WHERE NOT EXISTS (SELECT 1 FROM inn WHERE inn.trail_id = s.trail_id AND inn.km = s.km)),
l AS (SELECT trail_id, km AS from_km, lead(km) OVER w AS to_km, walk, lead(walk) OVER w AS next_walk FROM marks WINDOW w AS (PARTITION BY trail_id ORDER BY km)),
gaps AS (SELECT trail_id, from_km, to_km, to_km - from_km + walk + next_walk AS gap_km FROM l WHERE to_km > from_km)"""


def _water(spark, sf_dir):
    sources = pts(spark, sf_dir).where("event_type = 'view'").select("trail_id", "km", (F.col("ele") / 100.0).alias("walk_km"))
    return ordered.water_gaps(sources, ends(spark, sf_dir), 5.0)


@register("win09_water_gaps", f"{_WATER} SELECT trail_id, from_km, to_km, {rnd('gap_km', 5)} AS gap_km, gap_km >= 5 AS dry FROM gaps")
def win09(spark, sf_dir):
    return _water(spark, sf_dir).withColumn("gap_km", js_round("gap_km", 5))


@register("agg23_gap_summary", f"{_WATER} SELECT trail_id, {rnd('max(gap_km)', 5)} AS longest_km, count(*) FILTER (WHERE gap_km >= 5) AS n_dry, count(*) AS n_gaps FROM gaps GROUP BY trail_id")
def agg23(spark, sf_dir):
    return ordered.gap_summary(_water(spark, sf_dir)).withColumn("longest_km", js_round("longest_km", 5))


@register(
    "win10_day_split",
    f"""WITH {PTS}, {ENDS}, {_STOPS}, {_MARKS}, l AS (SELECT trail_id, km AS from_km, lead(km) OVER (PARTITION BY trail_id ORDER BY km) AS to_km FROM marks)
SELECT trail_id, CAST(row_number() OVER (PARTITION BY trail_id ORDER BY from_km) AS INT) AS day, from_km, to_km FROM l WHERE to_km > from_km""",
)
def win10(spark, sf_dir):
    return ordered.day_split(stops_of(spark, sf_dir), ends(spark, sf_dir))


@register(
    "win11_rest_day_dates",
    """WITH d AS (SELECT o_custkey AS trail_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS day, CAST(o_orderkey % 3 AS INT) AS nights FROM orders),
s AS (SELECT *, coalesce(sum(greatest(nights - 1, 0)) OVER (PARTITION BY trail_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rested FROM d)
SELECT trail_id, day, DATE '2026-01-01' + CAST(day - 1 + rested AS INT) AS date FROM s""",
)
def win11(spark, sf_dir):
    from trekframe.plans.tables import table

    w = Window.partitionBy("trail_id").orderBy("o_orderkey")
    days = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "trail_id")
    days = days.select("trail_id", F.row_number().over(w).alias("day"), (F.col("o_orderkey") % 3).cast("int").alias("nights"), F.lit("2026-01-01").cast("date").alias("start_date"))
    return ordered.rest_day_dates(days).select("trail_id", "day", "date")


@register(
    "win12_chain_groups",
    f"""WITH {PTS}, f AS (SELECT *, coalesce((km - lag(km) OVER w > 1 + 1e-9)::INT, 0) AS f FROM pts WINDOW w AS (PARTITION BY trail_id ORDER BY km, event_id))
SELECT trail_id, event_id, CAST(sum(f) OVER (PARTITION BY trail_id ORDER BY km, event_id) AS BIGINT) AS grp FROM f""",
)
def win12(spark, sf_dir):
    return ordered.chain_groups(pts(spark, sf_dir), 1.0, tie="event_id").select("trail_id", "event_id", "grp")


_STRETCHES = """bins AS (SELECT l_suppkey AS trail_id, CAST(floor(l_orderkey / 50.0) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
grid AS (SELECT trail_id, unnest(generate_series(min(bin), max(bin))) AS bin FROM bins GROUP BY trail_id),
d AS (SELECT g.trail_id, g.bin, coalesce(n, 0) AS n FROM grid g LEFT JOIN bins b ON b.trail_id = g.trail_id AND b.bin = g.bin),
e AS (SELECT *, sum(n) OVER (PARTITION BY trail_id ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS density FROM d),
i AS (SELECT *, bin - row_number() OVER (PARTITION BY trail_id ORDER BY bin) AS island FROM e WHERE density >= 2),
s AS (SELECT trail_id, island, min(bin) AS a, max(bin) AS b, max(density) AS peak FROM i GROUP BY ALL HAVING max(density) >= 4),
c AS (SELECT b.trail_id, b.bin FROM bins b JOIN s ON s.trail_id = b.trail_id AND b.bin BETWEEN a AND b.bin AND b.bin <= s.b),
m AS (SELECT *, coalesce((bin - lag(bin) OVER (PARTITION BY trail_id ORDER BY bin) - 1 > 5)::INT, 0) AS f FROM c),
k AS (SELECT *, sum(f) OVER (PARTITION BY trail_id ORDER BY bin) AS g FROM m), j AS (SELECT trail_id, g, min(bin) AS from_bin, max(bin) AS to_bin FROM k GROUP BY ALL),
stretches AS (SELECT j.trail_id, from_bin, to_bin, CAST(sum(n) AS BIGINT) AS n FROM j JOIN bins USING (trail_id) WHERE bin BETWEEN from_bin AND to_bin GROUP BY ALL HAVING sum(n) >= 20)"""


@register("win13_dense_stretches", f"WITH {_STRETCHES} SELECT trail_id, from_bin, to_bin, n FROM stretches")
def win13(spark, sf_dir):
    from trekframe.plans.tables import table

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("trail_id"), (F.col("l_orderkey") / 50.0).alias("km"))
    return ordered.dense_stretches(rows, 4.0, 2.0, 20, 5)


_ANCHOR = {1: "supermarket", 2: "station", 3: "hut"}


@register(
    "win14_thin_places",
    f"""WITH {_STRETCHES}, p AS (SELECT DISTINCT l_suppkey AS trail_id, l_orderkey * 10 + l_linenumber AS place_id, l_orderkey / 50.0 AS km, l_linenumber % 4 AS category, CASE l_linenumber {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _ANCHOR.items())} END AS anchor FROM lineitem),
q AS (SELECT p.*, place_id % 5 = 0 AS branded, place_id % 37 / 100.0 AS off_km, place_id % 53 = 0 AS kept, from_bin FROM p LEFT JOIN stretches s ON s.trail_id = p.trail_id AND p.km >= from_bin AND p.km < to_bin + 1),
r AS (SELECT *, row_number() OVER (PARTITION BY trail_id, from_bin, category ORDER BY km, NOT branded, off_km, place_id) AS a, row_number() OVER (PARTITION BY trail_id, from_bin, category ORDER BY km DESC, NOT branded DESC, off_km DESC, place_id DESC) AS z,
  row_number() OVER (PARTITION BY trail_id, from_bin, anchor, floor((km - from_bin) / 2.0) ORDER BY NOT branded, off_km, km, place_id) AS c FROM q)
SELECT trail_id, place_id FROM r WHERE from_bin IS NULL OR kept OR a = 1 OR z = 1 OR (anchor IS NOT NULL AND c = 1)""",
)
def win14(spark, sf_dir):
    """Lines of a supplier as places on its trail, thinned in the dense stretches."""
    from trekframe.plans.tables import table

    line, place = F.col("l_linenumber"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("trail_id"), place.alias("place_id"), (F.col("l_orderkey") / 50.0).alias("km"), (line % 4).alias("category"), F.coalesce(*(F.when(line == k, v) for k, v in _ANCHOR.items())).alias("anchor"),
        (place % 5 == 0).alias("branded"), (place % 37 / 100.0).alias("off_km"), (place % 53 == 0).alias("kept"),
    )
    return ordered.thin_dense(rows.distinct(), ordered.dense_stretches(rows, 4.0, 2.0, 20, 5)).select("trail_id", "place_id")


@register(
    "win15_coalesce_intervals",
    f"""WITH {PTS}, i AS (SELECT trail_id, km AS from_km, km + ele / 50.0 AS to_km FROM pts),
f AS (SELECT *, coalesce((from_km > max(to_km) OVER (PARTITION BY trail_id ORDER BY from_km, to_km ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 0) AS f FROM i),
g AS (SELECT *, sum(f) OVER (PARTITION BY trail_id ORDER BY from_km, to_km ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT trail_id, min(from_km) AS from_km, {rnd('max(to_km)', 6)} AS to_km, count(*) AS n FROM g GROUP BY trail_id, g""",
)
def win15(spark, sf_dir):
    rows = pts(spark, sf_dir).select("trail_id", F.col("km").alias("from_km"), (F.col("km") + F.col("ele") / 50.0).alias("to_km"))
    return ordered.coalesce_intervals(rows).select("trail_id", "from_km", js_round("to_km", 6).alias("to_km"), "n")


_SPLIT = "a AS (SELECT trail_id, km, event_id FROM pts WHERE event_type <> 'purchase'), b AS (SELECT trail_id, km, event_id AS bid FROM pts WHERE event_type = 'purchase')"


def _sides(spark, sf_dir):
    p = pts(spark, sf_dir)
    return p.where("event_type <> 'purchase'").select("trail_id", "km", "event_id"), p.where("event_type = 'purchase'").select("trail_id", "km", F.col("event_id").alias("bid"))


@register("jon24_asof_backward", f"WITH {PTS}, {_SPLIT} SELECT a.trail_id, a.event_id, b.bid AS anchor FROM a ASOF LEFT JOIN b ON a.trail_id = b.trail_id AND a.km >= b.km")
def jon24(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return ordered.asof(a, b, "trail_id", "km", F.col("bid"), "anchor").select("trail_id", "event_id", "anchor")


@register("jon25_asof_forward", f"WITH {PTS}, {_SPLIT} SELECT a.trail_id, a.event_id, b.bid AS next FROM a ASOF LEFT JOIN b ON a.trail_id = b.trail_id AND a.km < b.km")
def jon25(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return ordered.asof(a, b, "trail_id", "km", F.col("bid"), "next", forward=True, inclusive=False).select("trail_id", "event_id", "next")


@register(
    "jon26_nearest_km",
    f"""WITH {PTS}, {_SPLIT}, x AS (SELECT a.*, b.km AS bk FROM a ASOF LEFT JOIN b ON a.trail_id = b.trail_id AND a.km >= b.km), y AS (SELECT x.*, b.km AS ak FROM x ASOF LEFT JOIN b ON x.trail_id = b.trail_id AND x.km <= b.km)
SELECT trail_id, event_id, CASE WHEN bk IS NULL OR ak - km < km - bk THEN ak ELSE bk END AS near_km FROM y""",
)
def jon26(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return ordered.nearest_by_km(a, b.select("trail_id", "km")).select("trail_id", "event_id", "near_km")


_DAYS = "days AS (SELECT trail_id, km AS from_km, km + 2.5 AS to_km, CAST(row_number() OVER (PARTITION BY trail_id ORDER BY km) AS INT) AS number FROM stops)"


def _days(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("trail_id").orderBy("km"))
    return stops_of(spark, sf_dir).select("trail_id", F.col("km").alias("from_km"), (F.col("km") + 2.5).alias("to_km"), n.alias("number"))


@register(
    "jon27_first_containing",
    f"""WITH {PTS}, {_STOPS}, {_DAYS} SELECT p.trail_id, p.event_id, p.km, coalesce(min(number), 0) AS number FROM pts p LEFT JOIN days d ON d.trail_id = p.trail_id AND p.km BETWEEN d.from_km AND d.to_km GROUP BY ALL""",
)
def jon27(spark, sf_dir):
    return ordered.first_containing(pts(spark, sf_dir).select("trail_id", "event_id", "km"), _days(spark, sf_dir))


@register(
    "jon28_map_piecewise",
    f"""WITH {PTS}, {_STOPS}, {_DAYS}, m AS (SELECT p.trail_id, p.event_id, p.km, min({{'r': number, 's': number * 10.0, 'f': from_km}}) AS b FROM pts p LEFT JOIN days d ON d.trail_id = p.trail_id AND p.km BETWEEN d.from_km AND d.to_km GROUP BY ALL)
SELECT trail_id, event_id, {rnd('b.s + km - b.f', 6)} AS route_km FROM m""",
)
def jon28(spark, sf_dir):
    pieces = _days(spark, sf_dir).select("trail_id", "from_km", "to_km", F.col("number").alias("rank"), (F.col("number") * 10.0).alias("route_start"))
    out = ordered.map_piecewise(pts(spark, sf_dir).select("trail_id", "event_id", "km"), pieces)
    return out.select("trail_id", "event_id", js_round("route_km", 6).alias("route_km"))


@register(
    "jon31_overlapping_pairs",
    f"""WITH {PTS}, {_STOPS}, {_DAYS} SELECT a.trail_id, a.number AS a, b.number AS b FROM days a JOIN days b ON a.trail_id = b.trail_id AND a.number < b.number AND a.from_km < b.to_km - 1e-9 AND b.from_km < a.to_km - 1e-9""",
)
def jon31(spark, sf_dir):
    return ordered.overlapping_pairs(_days(spark, sf_dir).withColumnRenamed("number", "id"))


@register(
    "jon33_interleave",
    f"""WITH {PTS}, u AS (SELECT trail_id, km, event_id, 0 AS kind FROM pts WHERE event_type = 'purchase' UNION ALL SELECT trail_id, km + 0.5, event_id, 1 FROM pts WHERE event_type = 'click')
SELECT trail_id, event_id, kind, CAST(row_number() OVER (PARTITION BY trail_id ORDER BY km, kind, event_id) AS INT) AS place FROM u""",
)
def jon33(spark, sf_dir):
    p = pts(spark, sf_dir)
    a = p.where("event_type = 'purchase'").select("trail_id", "km", "event_id", F.lit(0).alias("kind"))
    b = p.where("event_type = 'click'").select("trail_id", (F.col("km") + 0.5).alias("km"), "event_id", F.lit(1).alias("kind"))
    w = Window.partitionBy("trail_id").orderBy("km", "kind", "event_id")
    return a.unionByName(b).select("trail_id", "event_id", "kind", F.row_number().over(w).alias("place"))


@register(
    "jon38_services_near",
    f"""WITH {PTS}, s AS (SELECT trail_id, km, event_id FROM pts WHERE event_type = 'purchase') SELECT s.trail_id, s.event_id, count(p.event_id) AS n, coalesce(bool_or(p.event_type = 'view'), false) AS has_water
FROM s LEFT JOIN pts p ON p.trail_id = s.trail_id AND p.event_id BETWEEN s.event_id - 100 AND s.event_id + 100 GROUP BY ALL""",
)
def jon38(spark, sf_dir):
    p = pts(spark, sf_dir)
    w = Window.partitionBy("trail_id").orderBy("event_id").rangeBetween(-100, 100)  # one kilometre is a hundred ids
    out = p.withColumn("n", F.count("event_id").over(w)).withColumn("has_water", F.max(F.col("event_type") == "view").over(w))
    return out.where("event_type = 'purchase'").select("trail_id", "event_id", "n", F.coalesce("has_water", F.lit(False)).alias("has_water"))


@register(
    "win19_relog_after_drop",
    f"""WITH {DIST} SELECT trail_id, idx, {rnd('dist - coalesce(lag(dist) OVER (PARTITION BY trail_id ORDER BY idx), 0)', 4)} AS leg FROM m WHERE event_id % 3 <> 0""",
)
def win19(spark, sf_dir):
    rows = track.cumulative_km(pts(spark, sf_dir)).select("trail_id", "idx", F.col("idx").alias("seq"), F.col("dist").alias("total"), (F.col("event_id") % 3 == 0).alias("dropped"))
    return ordered.relog_after_drop(rows).select("trail_id", "idx", js_round("leg", 4).alias("leg"))


@register(
    "win07_datasheet_legs",
    f"""WITH {DIST}, v AS (SELECT * FROM m WHERE event_type = 'purchase') SELECT trail_id, idx, {rnd('dist - coalesce(lag(dist) OVER w, 0)', 2)} AS distance, {rnd('dist', 2)} AS total_distance,
  {rnd(rnd('cum_ascent - coalesce(lag(cum_ascent) OVER w, 0)', 6), 0)} AS ascent, {rnd(rnd('cum_ascent', 6), 0)} AS total_ascent FROM v {_W}""",
)
def win07(spark, sf_dir):
    w = Window.partitionBy("trail_id").orderBy("idx")
    leg = lambda c: F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0.0))
    rows = measured(spark, sf_dir).where("event_type = 'purchase'")
    return rows.select("trail_id", "idx", js_round(leg("dist"), 2).alias("distance"), js_round("dist", 2).alias("total_distance"), js_round(js_round(leg("cum_ascent"), 6)).alias("ascent"), js_round(js_round("cum_ascent", 6)).alias("total_ascent"))


@register(
    "flt22_rows_ahead",
    f"""WITH {PTS}, f AS (SELECT *, min(CASE WHEN ele >= 30 - 0.05 THEN idx END) OVER (PARTITION BY trail_id) AS first FROM pts),
g AS (SELECT *, count(*) FILTER (WHERE first IS NULL OR idx < first) OVER (PARTITION BY trail_id) AS n_gone FROM f) SELECT trail_id, idx, n_gone FROM g WHERE idx >= first""",
)
def flt22(spark, sf_dir):
    rows = pts(spark, sf_dir).select("trail_id", "idx", F.col("idx").alias("seq"), F.col("ele").alias("km"))
    return ordered.rows_ahead(rows, 30.0).select("trail_id", "idx", "n_gone")


@register(
    "flt17_slice_with_neighbours",
    f"""WITH {PTS}, n AS (SELECT *, lead(km) OVER w AS n, lag(km) OVER w AS p FROM pts WINDOW w AS (PARTITION BY trail_id ORDER BY km, idx)) SELECT trail_id, idx FROM n WHERE (n >= 20 OR n IS NULL) AND (p <= 40 OR p IS NULL)""",
)
def flt17(spark, sf_dir):
    return ordered.neighbours_of_slice(pts(spark, sf_dir).select("trail_id", "idx", "km", F.col("idx").alias("seq")), 20.0, 40.0).select("trail_id", "idx")


@register(
    "agg11_decayed_vote",
    f"""WITH t AS (SELECT user_id AS waypoint_id, event_type AS status, epoch_us(ts) // 1000 AS time_ms FROM events), n AS (SELECT 1706745600000 AS now),
a AS (SELECT *, (now - time_ms) / 86400000.0 AS age FROM t, n), v AS (SELECT waypoint_id, status, sum(exp(-greatest(0, age) / 30.0)) AS weight, count(*) AS n, max(time_ms) AS latest_ms FROM a WHERE age <= 120 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY waypoint_id ORDER BY round(weight, 9) DESC, latest_ms DESC, status) AS r FROM v) SELECT waypoint_id, status, {rnd('weight', 6)} AS weight, n, latest_ms FROM r WHERE r = 1""",
)
def agg11(spark, sf_dir):
    from trekframe.plans.tables import table

    reports = table(spark, sf_dir, "events").select(F.col("user_id").alias("waypoint_id"), F.col("event_type").alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time_ms"))
    return ordered.decayed_vote(reports, 1706745600000).withColumn("weight", js_round("weight", 6))


@register(
    "agg01_monthly_climate",
    f"""WITH d AS (SELECT o_custkey % 20 AS location, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice % 40 END AS t_max, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice % 15 END AS t_min,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 9 AS DOUBLE) / 2 END AS rain FROM orders),
m AS (SELECT location, month(day) AS month, avg(t_min) FILTER (WHERE t_max IS NOT NULL AND t_min IS NOT NULL) AS lo, avg(t_max) FILTER (WHERE t_max IS NOT NULL AND t_min IS NOT NULL) AS hi, sum(rain) AS rain,
  count(*) FILTER (WHERE rain > 1) AS wet, count(DISTINCT CASE WHEN t_max IS NOT NULL AND t_min IS NOT NULL THEN year(day) END) AS years FROM d GROUP BY ALL),
g AS (SELECT location, unnest(range(1, 13)) AS month FROM (SELECT DISTINCT location FROM d))
SELECT g.location, CAST(g.month AS INT) AS month, coalesce(CASE WHEN years > 0 THEN {rnd('lo', 1)} END, 0.0) AS avg_temp_min, coalesce(CASE WHEN years > 0 THEN {rnd('hi', 1)} END, 0.0) AS avg_temp_max,
  coalesce(CASE WHEN years > 0 THEN {rnd('coalesce(rain, 0) / years', 1)} END, 0.0) AS avg_precipitation, coalesce(CASE WHEN years > 0 THEN {rnd('wet / years', 1)} END, 0.0) AS avg_rainy_days
FROM g LEFT JOIN m ON m.location = g.location AND m.month = g.month""",
)
def agg01(spark, sf_dir):
    from trekframe.plans.tables import table

    k = F.col("o_orderkey")
    daily = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("location"), F.col("o_orderdate").cast("date").alias("day"), F.when(k % 7 != 0, F.col("o_totalprice") % 40).alias("t_max"),
        F.when(k % 5 != 0, F.col("o_totalprice") % 15).alias("t_min"), F.when(k % 3 != 0, (k % 9).cast("double") / 2).alias("rain"),
    )
    return ordered.monthly_climate(daily)
