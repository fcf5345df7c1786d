"""Queries on single values: distances, times, units, names, links, dates, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.functions import geo, hiking, text
from trekframe.functions.rounding import js_round
from trekframe.plans.registry import register
from trekframe.plans.tables import CUST, cust, hav, rnd, table

_HOME = hav("lat", "lon", "-35.0", "148.0")


@register("mth02_flat_distance", f"WITH {CUST} SELECT place_id, {rnd(_HOME, 3)} AS metres FROM cust")
def mth02(spark, sf_dir):
    return cust(spark, sf_dir).select("place_id", js_round(geo.haversine_m(F.col("lat"), F.col("lon"), F.lit(-35.0), F.lit(148.0)), 3).alias("metres"))


@register("mth03_slope_distance", f"WITH {CUST} SELECT place_id, {rnd('sqrt(pow(' + _HOME + ', 2) + pow(place_id * 3.0 - 70.0, 2))', 2)} AS metres FROM cust")
def mth03(spark, sf_dir):
    return cust(spark, sf_dir).select("place_id", js_round(geo.haversine_3d_m(F.col("lat"), F.col("lon"), F.col("place_id") * 3.0, F.lit(-35.0), F.lit(148.0), F.lit(70.0)), 2).alias("metres"))


def _event(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events").select("event_id", *columns)


@register("mth05_rounded_time", f"SELECT event_id, {rnd('value / 3.5 + event_id % 700 / 600.0 + greatest(0.0, (event_id % 900 - 300) / 600.0)', 1)} AS hours FROM events")
def mth05(spark, sf_dir):
    return _event(spark, sf_dir, hiking.hiking_time(F.col("value"), F.col("event_id") % 700, F.col("event_id") % 900, 3.5).alias("hours"))


@register("mth07_food_weight", f"SELECT event_id, {rnd('event_id % 9 * 650 / 1000.0', 3)} AS kg FROM events")
def mth07(spark, sf_dir):
    return _event(spark, sf_dir, js_round(hiking.food_weight_kg(F.col("event_id") % 9, 650), 3).alias("kg"))


@register("mth08_units", f"SELECT event_id, {rnd('value / 1.609344', 5)} AS miles, value AS km, {rnd('value * 3.280839895', 5)} AS feet FROM events")
def mth08(spark, sf_dir):
    return _event(spark, sf_dir, js_round(hiking.convert_distance(F.col("value"), "mi"), 5).alias("miles"), hiking.convert_distance(F.col("value"), "km").alias("km"), js_round(hiking.convert_elevation(F.col("value"), "mi"), 5).alias("feet"))


@register("mth10_clamped", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 8.0 WHEN event_id % 6 = 1 THEN 8.0 ELSE least(40.0, greatest(12.0, value)) END AS x FROM events")
def mth10(spark, sf_dir):
    x = F.when(F.col("event_id") % 6 == 0, F.lit(None).cast("double")).when(F.col("event_id") % 6 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return _event(spark, sf_dir, hiking.clamp(x, 12.0, 40.0, 8.0).alias("x"))


@register("mth11_backoff", "SELECT event_id, CAST(least(pow(2, event_id % 12) * 30000, 3600000) AS BIGINT) AS ms FROM events")
def mth11(spark, sf_dir):
    return _event(spark, sf_dir, hiking.backoff_ms(F.col("event_id") % 12).alias("ms"))


@register("mth12_fetch_backoff", "SELECT event_id, CAST(least(pow(2, greatest(event_id % 9 - 1, 0)) * 3600000, 172800000) AS BIGINT) AS ms FROM events")
def mth12(spark, sf_dir):
    return _event(spark, sf_dir, hiking.fetch_backoff_ms(F.col("event_id") % 9).alias("ms"))


@register("mth14_tiles", f"WITH {CUST} SELECT place_id, CAST(floor((lon + 180) / 360 * 16384) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / 3.141592653589793) / 2 * 16384) AS BIGINT) AS y FROM cust")
def mth14(spark, sf_dir):
    return cust(spark, sf_dir).select("place_id", geo.tile_x(F.col("lon"), 14).alias("x"), geo.tile_y(F.col("lat"), 14).alias("y"))


@register("mth15_wrapped_longitude", "SELECT event_id, CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END AS d FROM (SELECT event_id, event_id * 7 % 720 - 360.0 AS d FROM events) x")
def mth15(spark, sf_dir):
    return _event(spark, sf_dir, geo.wrap_lon(F.col("event_id") * 7 % 720 - 360.0).alias("d"))


@register(
    "mth16_projections",
    "SELECT event_id, CAST(CASE WHEN lon BETWEEN 112 AND 154 AND lat BETWEEN -44 AND -10 THEN 28300 WHEN lat >= 0 THEN 32600 ELSE 32700 END + least(60, floor((lon + 180) / 6) + 1) AS BIGINT) AS epsg FROM (SELECT event_id, event_id * 7 % 361 - 180.0 AS lon, event_id * 11 % 160 - 80.0 AS lat FROM events) x",
)
def mth16(spark, sf_dir):
    return _event(spark, sf_dir, geo.projected_epsg(F.col("event_id") * 7 % 361 - 180.0, F.col("event_id") * 11 % 160 - 80.0).alias("epsg"))


@register(
    "mth17_walks_both_ways",
    """SELECT event_id, value + coalesce(o.km, 0) + coalesce(i.km, 0) AS km, 100 + coalesce(o.down, 0) + coalesce(i.up, 0) AS ascent, 50 + coalesce(o.up, 0) + coalesce(i.down, 0) AS descent FROM events
LEFT JOIN (VALUES (0, 2.5, 40, 10), (1, 0.5, 5, 60)) o(k, km, up, down) ON o.k = event_id % 3 LEFT JOIN (VALUES (1, 1.5, 30, 20)) i(k, km, up, down) ON i.k = event_id % 4""",
)
def mth17(spark, sf_dir):
    """Legs with the walk back from the place they start at, its climb and descent swapped, and the one to their end."""
    walk = lambda km, up, down: F.struct(F.lit(km).alias("km"), F.lit(up).alias("ascent"), F.lit(down).alias("descent"))
    out = F.when(F.col("event_id") % 3 == 0, walk(2.5, 40, 10)).when(F.col("event_id") % 3 == 1, walk(0.5, 5, 60))
    leg = hiking.add_walks(F.col("value"), F.lit(100), F.lit(50), out, F.when(F.col("event_id") % 4 == 1, walk(1.5, 30, 20)))
    return _event(spark, sf_dir, leg.alias("leg")).select("event_id", "leg.km", "leg.ascent", "leg.descent")


@register("mth20_option_access", "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 4 = 1 OR value % 10 < 1 OR (event_id % 4 = 0 AND value <= 5) THEN 'walk' ELSE 'ride' END AS access FROM (SELECT event_id, CASE WHEN value % 10 < 1 THEN 0.0 ELSE value END AS value FROM events) x")
def mth20(spark, sf_dir):
    mode = F.when(F.col("event_id") % 4 == 1, "foot").when(F.col("event_id") % 4 == 2, "hitch").when(F.col("event_id") % 4 == 3, "boat")
    return _event(spark, sf_dir, hiking.option_access(F.when(F.col("value") % 10 < 1, 0.0).otherwise(F.col("value")), mode, F.col("event_id") % 7 == 0).alias("access"))


@register("mth21_active_km", f"SELECT event_id, {rnd('CASE WHEN event_id % 2 = 0 THEN 250.0 - value ELSE value END', 6)} AS km FROM events")
def mth21(spark, sf_dir):
    return _event(spark, sf_dir, js_round(hiking.active_km(F.col("value"), F.when(F.col("event_id") % 2 == 0, "SOBO").otherwise("NOBO"), F.lit(250.0)), 6).alias("km"))


@register("mth22_suggestion_windows", f"SELECT event_id, {rnd('least(2.5, greatest(0.75, value / 8 * 0.35))', 6)} AS about, {rnd('greatest(0.75, value / 8 * 0.25)', 6)} AS least_h FROM events")
def mth22(spark, sf_dir):
    return _event(spark, sf_dir, js_round(hiking.plan_window_hours(F.col("value") / 8), 6).alias("about"), js_round(hiking.plan_floor_hours(F.col("value") / 8), 6).alias("least_h"))


@register("str01_name_tokens", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mount|' || replace(p_name, ' ', '|') WHEN 1 THEN replace(p_name, ' ', '|') || '|south' WHEN 2 THEN 'okeefes|' || replace(p_name, ' ', '|') ELSE 'pahautea|' || replace(p_name, ' ', '|') END AS tokens FROM part")
def str01(spark, sf_dir):
    """Names as walkers write them: abbreviations, compass letters, apostrophes, prefixes, qualifiers and accents."""
    k, n = F.col("p_partkey"), F.col("p_name")
    name = F.when(k % 4 == 0, F.concat(F.lit("R: Mt "), n, F.lit(" Hut - North NP"))).when(k % 4 == 1, F.concat(n, F.lit(" Camp S")))
    name = name.when(k % 4 == 2, F.concat(F.lit("O' Keefe’s "), n)).otherwise(F.concat(F.lit("Pāhautea "), n, F.lit(" (Site)")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.name_tokens(name), "|").alias("tokens"))


_TWO = "SELECT a.p_partkey AS a, b.p_partkey AS b, string_split(a.p_name, ' ') AS x, string_split(b.p_name, ' ') AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"


def _neighbours(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"))
    return a.join(p.select((F.col("p_partkey") - 1).alias("a"), F.col("p_partkey").alias("b"), F.col("p_name").alias("y")), "a")


@register(
    "str02_set_score",
    f"WITH t AS ({_TWO}), s AS (SELECT *, len(list_intersect(x, y)) AS i FROM t) SELECT a, b, CASE WHEN i = least(len(x), len(y)) AND (i >= 2 OR len(x) = len(y)) THEN 1.0 ELSE i / len(list_distinct(list_concat(x, y))) END AS score FROM s",
)
def str02(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("a", "b", text.set_score(text.all_tokens(F.col("x")), text.all_tokens(F.col("y"))).alias("score"))


@register("str03_letter_ratio")
def str03(spark, sf_dir):
    """Twice the longest common subsequence of two names over their lengths; beyond SQL, held against a table in the tests."""
    return _neighbours(spark, sf_dir).select("a", "b", "x", "y", text.lcs_ratio(F.col("x"), F.col("y")).alias("ratio"))


@register(
    "str04_told_apart",
    "SELECT p_partkey, (p_partkey % 3 = 0) <> (p_partkey % 5 = 0) OR (p_partkey % 7 > 0 AND p_partkey % 7 <> 4) AS apart FROM part",
)
def str04(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    a = F.concat(F.when(k % 3 == 0, "Upper ").otherwise(""), n, F.when(k % 7 > 0, F.concat(F.lit(" "), k % 7)).otherwise(""))
    b = F.concat(n, F.when(k % 5 == 0, " upper").otherwise(""), F.lit(" 4"))
    return table(spark, sf_dir, "part").select("p_partkey", text.names_distinguished(text.all_tokens(a), text.all_tokens(b)).alias("apart"))


@register(
    "str05_classified",
    """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'campsite' WHEN p_name IN ('red ring', 'small gear') THEN 'town' WHEN split_part(p_name, ' ', 1) = 'hot' THEN 'water' WHEN split_part(p_name, ' ', 2) = 'ring' THEN 'junction' WHEN split_part(p_name, ' ', 2) = 'bolt' THEN 'hut' ELSE 'waypoint' END AS type FROM part""",
)
def str05(spark, sf_dir):
    folder = F.when(F.col("p_partkey") % 9 == 0, "Camps")
    kind = text.classify_waypoint(F.col("p_name"), folder, folders={"camps": "campsite"}, towns=["red ring", "small gear"], prefixes=[("hot", "water")], keywords=[("ring", "junction"), ("bolt", "hut")])
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("type"))


@register("str07_clean_names", "SELECT p_partkey, CASE WHEN starts_with(p_name, 'small ') THEN substr(p_name, 7) WHEN starts_with(p_name, 'red ') THEN substr(p_name, 5) ELSE p_name END AS name FROM part")
def str07(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_prefix(F.col("p_name"), ["small", "red"]).alias("name"))


@register(
    "str08_links_in_text",
    "SELECT p_partkey, 'text:' || p_name || ' |link:https://a.org/' || p_partkey || '|text:, |email:x' || p_partkey || '@b.org|text: or |phone:+61 8 9755 ' || (1000 + p_partkey % 9000) AS parts FROM part",
)
def str08(spark, sf_dir):
    k = F.col("p_partkey")
    said = F.concat(F.col("p_name"), F.lit(" https://a.org/"), k, F.lit(", x"), k, F.lit("@b.org or +61 8 9755 "), 1000 + k % 9000)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(text.split_links(said), lambda x: F.concat_ws(":", x["kind"], x["text"])), "|").alias("parts"))


@register("str09_first_sentence", "SELECT p_partkey, 'Mt. ' || p_name || ' is near.' AS sentence FROM part")
def str09(spark, sf_dir):
    said = F.concat(F.lit("Before. | Mt. "), F.col("p_name"), F.lit(" is near. More follows!"))
    return table(spark, sf_dir, "part").select("p_partkey", text.first_sentence(said).alias("sentence"))


@register("str11_xml", "SELECT p_partkey, '&lt;' || p_name || '&gt; &amp; &quot;' || p_type || '&quot; &apos;' AS xml FROM part")
def str11(spark, sf_dir):
    said = F.concat(F.lit("<"), "p_name", F.lit('> & "'), "p_type", F.lit("\" '"))
    return table(spark, sf_dir, "part").select("p_partkey", text.escape_xml(said).alias("xml"))


@register("str13_safe_links", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'https://example.org/' || page_id END AS url, CASE WHEN page_id % 2 = 0 THEN 'tel:+61(8)' || page_id END AS tel FROM pages")
def str13(spark, sf_dir):
    from trekframe.functions.pois import safe_tel_url

    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("javascript:alert("), k, F.lit(")"))).otherwise(F.concat(F.lit("  https://example.org/"), k))
    tel = F.when(k % 2 == 0, F.concat(F.lit("call +61 (8) "), k)).otherwise("ask inside")
    return table(spark, sf_dir, "pages").select("page_id", text.safe_http_url(url).alias("url"), safe_tel_url(tel).alias("tel"))


@register("str14_slugs", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'own-' || p_partkey ELSE rtrim(substr(replace(p_name, ' ', '-') || '-' || lower(p_type) || '-' || repeat('long-', 12), 1, 60), '') END AS slug FROM part")
def str14(spark, sf_dir):
    """The trail's own id where it has one that is not a traveller's, else a slug of its name."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("  "), "p_name", F.lit(" / "), "p_type", F.lit(" ("), F.repeat(F.lit("Long "), 12), F.lit(")!"))
    own = F.when(k % 4 == 0, F.concat(F.lit("own-"), k)).otherwise(F.concat(F.lit("u_"), k))
    return table(spark, sf_dir, "part").select("p_partkey", text.trail_slug(own, name).alias("slug"))


@register("str15_minted_ids", "SELECT p_partkey, 'w_' || substr(sha1('t|' || p_type || '|' || printf('%.5f', (p_partkey % 90) * 0.5) || '|' || printf('%.5f', p_size * 0.25)), 1, 12) AS id FROM part")
def str15(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.mint_id(F.lit("t"), F.col("p_type"), (k % 90) * 0.5, F.col("p_size") * 0.25, 12).alias("id"))


@register("str16_keys", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'node' WHEN 1 THEN 'way' ELSE 'relation' END || '/' || p_partkey AS key FROM part")
def str16(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", text.poi_key(F.element_at(F.array(*map(F.lit, ("node", "way", "relation"))), (k % 3 + 1).cast("int")), k).alias("key"))


@register("str17_fingerprints", "SELECT count(DISTINCT text) AS texts, count(DISTINCT text) AS prints, 12 AS least, 12 AS most FROM documents WHERE text IS NOT NULL")
def str17(spark, sf_dir):
    """As many fingerprints as texts, all of 12 characters."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("text", text.short_hash("text").alias("h"))
    return d.agg(F.count_distinct("text").alias("texts"), F.count_distinct("h").alias("prints"), F.min(F.length("h")).alias("least"), F.max(F.length("h")).alias("most"))


@register(
    "str18_rate_keys",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '10.0.' || page_id % 200 || '.7' WHEN 1 THEN '10.0.' || page_id % 200 || '.7' WHEN 2 THEN '2001:db8:' || printf('%x', page_id % 250 + 1) || '::/64' ELSE 'unknown' END AS key FROM pages",
)
def str18(spark, sf_dir):
    k = F.col("page_id")
    v4 = F.concat(F.lit("10.0."), k % 200, F.lit(".7"))
    address = F.when(k % 4 == 0, v4).when(k % 4 == 1, F.concat(F.lit("::ffff:"), v4)).when(k % 4 == 2, F.concat(F.lit("2001:DB8:"), F.lower(F.hex(k % 250 + 1)), F.lit("::9:1"))).otherwise("unknown")
    return table(spark, sf_dir, "pages").select("page_id", text.rate_key(address).alias("key"))


@register("str20_distances_in_words", "SELECT event_id, CAST(event_id % 700 AS VARCHAR) || '.0 km' AS km, CAST(event_id % 700 AS VARCHAR) || '.00 mi' AS miles FROM events")
def str20(spark, sf_dir):
    return _event(spark, sf_dir, text.format_distance((F.col("event_id") % 700).cast("double"), "km").alias("km"), text.format_distance((F.col("event_id") % 700) * 1.609344, "mi", 2).alias("miles"))


@register("str21_mostly_links", "SELECT page_id, length(url) > 0.5 * (length(url) + page_id % 90) AS mostly FROM pages")
def str21(spark, sf_dir):
    said = F.concat(F.repeat(F.lit("x"), (F.col("page_id") % 90).cast("int")), F.lit(" \n "), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.mostly_links(said).alias("mostly"))


@register("str22_digests", "SELECT doc_id, sha256(coalesce(text, '')) AS sha, md5(coalesce(text, '')) AS md5 FROM documents")
def str22(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("sha"), F.md5(t).alias("md5"))


_ORDER = lambda spark, sf_dir, *columns: table(spark, sf_dir, "orders").select("o_orderkey", *columns)


@register("dat02_days_added", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT), '%Y-%m-%d') AS day FROM orders")
def dat02(spark, sf_dir):
    return _ORDER(spark, sf_dir, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).cast("string").alias("day"))


@register("dat04_day_of_text", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS day FROM orders")
def dat04(spark, sf_dir):
    """The day of an ISO text, by its own characters."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return _ORDER(spark, sf_dir, F.concat(F.substr(iso, F.lit(1), F.instr(iso, "T") - 1), F.lit("T00:00:00Z")).alias("day"))


@register("dat05_iso_millis", "SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM events")
def dat05(spark, sf_dir):
    return _event(spark, sf_dir, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))


@register("dat06_ages", "SELECT event_id, CASE WHEN d < 7 THEN d || 'd' WHEN d < 30 THEN d // 7 || 'w' ELSE d // 30 || 'mo' END AS age FROM (SELECT event_id, event_id % 400 AS d FROM events) x")
def dat06(spark, sf_dir):
    return _event(spark, sf_dir, text.format_age(F.col("event_id") % 400).alias("age"))


@register(
    "dat07_local_days",
    "SELECT event_id, strftime(CAST(ts AS TIMESTAMP) + INTERVAL 10 HOUR, '%Y-%m-%d') AS day, 86400000 - CAST(epoch_us(CAST(ts AS TIMESTAMP) + INTERVAL 10 HOUR) // 1000 % 86400000 AS BIGINT) AS left_ms FROM events",
)
def dat07(spark, sf_dir):
    """The date where the traveller is, and the milliseconds until it ends there."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Australia/Brisbane")
    return _event(spark, sf_dir, F.date_format(local, "yyyy-MM-dd").alias("day"), (86_400_000 - F.pmod(F.unix_millis(local), F.lit(86_400_000))).alias("left_ms"))


@register("dat08_stamps", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 500000 WHEN 500000 > event_id * 1000 THEN 500000 ELSE event_id * 1000 + 1 END AS stamp FROM events")
def dat08(spark, sf_dir):
    """A stamp that never goes back: now, or one millisecond after the one before; an unreadable one counts for nothing."""
    before = F.when(F.col("event_id") % 4 == 3, "soon").otherwise((F.col("event_id") * 1000).cast("string"))
    return _event(spark, sf_dir, text.monotone_stamp(F.lit(500_000).cast("long"), before).alias("stamp"))


@register(
    "dat10_token_checks",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'revoked' WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'expired' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'renew' ELSE 'valid' END AS state FROM orders",
)
def dat10(spark, sf_dir):
    """Tokens at noon of 1995-01-01's midnight: revoked, expired, near their end, or valid."""
    state = text.token_state(F.to_timestamp(F.lit("1995-01-01 00:00:00")), F.col("o_orderdate").cast("timestamp"), (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), 365)
    return _ORDER(spark, sf_dir, state.alias("state"))


@register("jsn02_json_lengths", "SELECT user_id, CAST(count(*) AS INT) AS n FROM events GROUP BY user_id")
def jsn02(spark, sf_dir):
    docs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(F.collect_list("event_id")).alias("j"))
    return docs.select("user_id", F.json_array_length("j").alias("n"))


@register("jsn04_json_groups", "SELECT o_custkey, '[' || string_agg('{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS doc FROM orders GROUP BY o_custkey")
def jsn04(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(rows).alias("doc"))


@register(
    "arr02_descriptions_joined",
    "WITH t AS (SELECT o_custkey, nullif(trim(CASE o_orderkey % 4 WHEN 0 THEN '' ELSE o_orderpriority END), '') AS d, min(o_orderkey) AS k FROM orders GROUP BY o_custkey, d) SELECT o_custkey, coalesce(string_agg(d, '; ' ORDER BY k), '') AS description FROM t GROUP BY o_custkey",
)
def arr02(spark, sf_dir):
    said = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", said.alias("d")))).alias("r"))
    return rows.select("o_custkey", text.join_distinct(F.transform("r", lambda x: x["d"]), "; ").alias("description"))


@register("arr03_sorted_insert", "SELECT c_custkey, array_to_string(list_sort([5, 20, 35, CAST(c_custkey % 50 AS INT)]), ',') AS stops FROM customer")
def arr03(spark, sf_dir):
    stops = F.array_sort(F.array_append(F.array(F.lit(5), F.lit(20), F.lit(35)), (F.col("c_custkey") % 50).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(stops, ",").alias("stops"))


@register("udf02_sampled_heights", f"WITH {CUST} SELECT place_id, {rnd('abs(lat) * 10 + abs(lon)', 4)} AS ele FROM cust")
def udf02(spark, sf_dir):
    """A caller's own sampler of heights, taken as a function of two columns (UDF02, UDF04)."""
    from trekframe.operators.track import with_elevation

    return with_elevation(cust(spark, sf_dir), lambda lat, lon: F.abs(lat) * 10 + F.abs(lon)).select("place_id", js_round("ele", 4).alias("ele"))
