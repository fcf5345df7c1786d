"""Queries on scalar functions, filters and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.functions import hiking, pois, text
from trekframe.functions.rounding import js_round, round_km
from trekframe.plans.registry import register
from trekframe.plans.tables import rnd, table

@register(
    "mth04_hiking_time",
    f"""SELECT event_id, {rnd('value / 4.0 + (value * 20) / 600.0 + greatest(0.0, (value * 15 - 300) / 600.0)', 6)} AS hours, {rnd('value / 4.0 + (value * 20) / 600.0 + greatest(0.0, (value * 15 - 300) / 600.0)', 1)} AS rounded,
  {rnd('value * 7 * 800 / 1000.0', 4)} AS food_kg, {rnd('value / 1.609344', 4)} AS miles, {rnd('value * 3.280839895', 3)} AS feet FROM events""",
)
def mth04(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", js_round(hiking.hiking_hours(v, v * 20, v * 15), 6).alias("hours"), hiking.hiking_time(v, v * 20, v * 15).alias("rounded"),
        js_round(hiking.food_weight_kg(v * 7, 800), 4).alias("food_kg"), js_round(hiking.convert_distance(v, "mi"), 4).alias("miles"), js_round(hiking.convert_elevation(v, "mi"), 3).alias("feet"),
    )


@register(
    "mth06_rounding",
    "SELECT event_id, floor((event_id - 500) / 2.0 + 0.5) AS whole, floor(-value * 100 + 0.5) / 100.0 AS km FROM events",
)
def mth06(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", js_round((F.col("event_id") - 500) / 2.0).alias("whole"), round_km(-F.col("value")).alias("km"))


@register(
    "mth09_bands_and_limits",
    """SELECT event_id, CASE WHEN value * 4 < 30 THEN 'short' WHEN value * 4 <= 300 THEN 'medium' ELSE 'long' END AS band, CASE WHEN event_id % 9 = 0 THEN 12.0 ELSE least(50.0, greatest(5.0, value)) END AS clamped,
  CAST(least(pow(2, event_id % 10) * 30000, 3600000) AS BIGINT) AS wait_ms, least(2.5, greatest(0.75, value * 0.35)) AS window_h, greatest(0.75, value * 0.25) AS floor_h, CASE WHEN event_id % 2 = 0 THEN 100.0 - value ELSE value END AS km FROM events""",
)
def mth09(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", hiking.length_band(v * 4).alias("band"), hiking.clamp(F.when(k % 9 != 0, v), 5.0, 50.0, 12.0).alias("clamped"), hiking.backoff_ms(k % 10).alias("wait_ms"),
        hiking.plan_window_hours(v).alias("window_h"), hiking.plan_floor_hours(v).alias("floor_h"), hiking.active_km(v, F.when(k % 2 == 0, "SOBO").otherwise("NOBO"), F.lit(100.0)).alias("km"),
    )


@register(
    "mth13_nice_steps",
    """WITH r AS (SELECT o_orderkey, o_totalprice / 6 AS raw FROM orders), u AS (SELECT *, pow(10.0, floor(log10(raw))) AS u FROM r)
SELECT o_orderkey, CASE WHEN raw / u <= 1 THEN u WHEN raw / u <= 2 THEN 2 * u WHEN raw / u <= 5 THEN 5 * u ELSE 10 * u END AS step FROM u""",
)
def mth13(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hiking.nice_step(F.col("o_totalprice"), 6).alias("step"))


@register(
    "mth18_day_cost",
    f"""SELECT event_id, {rnd('CASE WHEN value > 60 THEN NULL WHEN event_id % 4 = 0 AND value <= 30 THEN 0.0 ELSE pow((value - 30) / 8.0, 2) END', 6)} AS cost,
  CASE WHEN event_id % 5 = 0 OR event_id % 3 = 1 OR value = 0 OR (event_id % 3 = 0 AND value <= 5) THEN 'walk' ELSE 'ride' END AS access FROM events""",
)
def mth18(spark, sf_dir):
    v, k = F.col("value"), F.col("event_id")
    mode = F.when(k % 3 == 1, "foot").when(k % 3 == 2, "hitch")
    return table(spark, sf_dir, "events").select("event_id", js_round(hiking.day_cost(v, 30, 8.0, 60, k % 4 == 0), 6).alias("cost"), hiking.option_access(v, mode, k % 5 == 0).alias("access"))


_KIND = "lower(trim(CASE p_partkey % 5 WHEN 0 THEN ' Spring ' WHEN 1 THEN 'town-access' WHEN 2 THEN 'Supermarket' WHEN 3 THEN 'hut' ELSE 'WATER-tank' END))"


@register(
    "flt01_type_families",
    f"""SELECT p_partkey, {_KIND} IN ({", ".join(f"'{w}'" for w in pois.WATER_TYPES)}) AS water, {_KIND} IN ({", ".join(f"'{w}'" for w in pois.RESUPPLY_TYPES)}) AS resupply, {_KIND} LIKE '%-access' AS turn_off, regexp_replace({_KIND}, '-access$', '') AS base FROM part""",
)
def flt01(spark, sf_dir):
    k = F.col("p_partkey") % 5
    kind = F.when(k == 0, " Spring ").when(k == 1, "town-access").when(k == 2, "Supermarket").when(k == 3, "hut").otherwise("WATER-tank")
    return table(spark, sf_dir, "part").select("p_partkey", pois.is_water(kind).alias("water"), pois.is_resupply(kind).alias("resupply"), pois.is_access(kind).alias("turn_off"), pois.base_type(kind).alias("base"))


@register("flt11_search", "SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), lower(trim(' MACH '))) AND CASE WHEN c_acctbal < 30 THEN 'short' WHEN c_acctbal <= 3000 THEN 'medium' ELSE 'long' END IN ('medium', 'long')")
def flt11(spark, sf_dir):
    words = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    band = F.when(F.col("c_acctbal") < 30, "short").when(F.col("c_acctbal") <= 3000, "medium").otherwise("long")
    return table(spark, sf_dir, "customer").where(words.contains("mach") & band.isin("medium", "long")).select("c_custkey")


@register("flt12_range_slice", "SELECT event_id FROM events WHERE value BETWEEN least(30, 20) - 0.001 AND greatest(30, 20) + 0.001")
def flt12(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("value").between(F.least(F.lit(30), F.lit(20)) - 0.001, F.greatest(F.lit(30), F.lit(20)) + 0.001)).select("event_id")


@register("flt20_seasonal_words", "SELECT doc_id, len(list_filter(['the', 'tion', 'schung', 'queeau'], lambda w: contains(lower(text), w))) > 0 AS noted FROM documents")
def flt20(spark, sf_dir):
    words = F.array(*(F.lit(w) for w in ("the", "tion", "schung", "queeau")))
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(words, lambda w: F.contains(F.lower("text"), w)).alias("noted"))


@register(
    "str10_escapes_and_slugs",
    """SELECT p_partkey, replace(replace(replace(replace(replace(n, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
  substr(regexp_replace(regexp_replace(lower(n), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug,
  'w_' || substr(sha1('t|' || p_type || '|' || printf('%.5f', p_retailprice / 100) || '|' || printf('%.5f', p_size / 7.0)), 1, 8) AS id,
  CASE WHEN regexp_matches(n, '[",\r\n]') THEN '"' || replace(n, '"', '""') || '"' ELSE n END AS csv, CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'way' END || '/' || p_partkey AS key, sha256(n) AS sha, md5(n) AS md5
FROM (SELECT *, '<' || p_name || ' & "' || p_brand || '">' AS n FROM part) x""",
)
def str10(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("n", F.concat(F.lit("<"), "p_name", F.lit(' & "'), "p_brand", F.lit('">')))
    n = F.col("n")
    return p.select(
        "p_partkey", text.escape_html(n).alias("html"), text.slug(n).alias("slug"), text.mint_id(F.lit("t"), F.col("p_type"), F.col("p_retailprice") / 100, F.col("p_size") / 7.0).alias("id"),
        text.csv_quote(n).alias("csv"), F.concat_ws("/", F.when(F.col("p_partkey") % 2 == 0, "node").otherwise("way"), F.col("p_partkey").cast("string")).alias("key"),
        F.sha2(n, 256).alias("sha"), F.md5(n).alias("md5"),
    )


@register(
    "str19_targets_and_links",
    """WITH t AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN 'w_0123abcd' WHEN 1 THEN 'u_x' WHEN 2 THEN 's_y' WHEN 3 THEN 'node/' || (page_id + 1) ELSE 'node/0' END AS target FROM pages)
SELECT page_id, CASE WHEN regexp_matches(target, '^w_[0-9a-f]{8}([0-9a-f]{4})?$') THEN 'curated' WHEN starts_with(target, 'u_') THEN 'community' WHEN starts_with(target, 's_') THEN 'shared' WHEN regexp_matches(target, '^(node|way|relation)/[1-9][0-9]{0,15}$') THEN 'osm' END AS kind,
  CASE WHEN regexp_matches(trim(url), '^(?i)https?://[^\\s/?#]+([/?#]\\S*)?$') THEN trim(url) END AS safe, length(url) > 0.5 * (length(url) + 40) AS mostly FROM t""",
)
def str19(spark, sf_dir):
    k = F.col("page_id")
    target = F.when(k % 5 == 0, "w_0123abcd").when(k % 5 == 1, "u_x").when(k % 5 == 2, "s_y").when(k % 5 == 3, F.concat(F.lit("node/"), k + 1)).otherwise("node/0")
    said = F.concat(F.col("url"), F.lit(" "), F.repeat(F.lit("x"), 40))
    return table(spark, sf_dir, "pages").select("page_id", text.target_kind(target).alias("kind"), text.safe_http_url(F.col("url")).alias("safe"), text.mostly_links(said).alias("mostly"))


@register("str06_keyword_types", r"""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])ring(e?s)?($|[^a-z0-9])') THEN 'ring' WHEN regexp_matches(lower(p_name), '(^|[^a-z0-9])widget(e?s)?($|[^a-z0-9])') THEN 'widget' ELSE 'waypoint' END AS type,
  CASE WHEN starts_with(lower(p_name), 'red') AND trim(substr(p_name, 4)) <> '' THEN trim(substr(p_name, 4)) ELSE p_name END AS clean FROM part""")
def str06(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.keyword_type(n, [("ring", "ring"), ("widget", "widget")]).alias("type"), text.clean_prefix(n, ["red"]).alias("clean"))


@register("str12_python_text")
def str12(spark, sf_dir):
    """Text functions without a twin in SQL; see the tests."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", text.first_sentence("text").alias("sentence"), text.decode_entities(F.concat(F.lit("&amp;&#233;&#0;"), F.col("text"))).alias("decoded"), text.short_hash("text").alias("hash"), text.rate_key(F.concat(F.lit("::ffff:10.0.0."), F.col("doc_id") % 200)).alias("key"))


@register(
    "dat01_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS later, CASE WHEN o_orderkey % 2 = 0 THEN true ELSE false END AS is_date,
  CASE WHEN o_orderkey % 60 < 7 THEN (o_orderkey % 60) || 'd' WHEN o_orderkey % 60 < 30 THEN (o_orderkey % 60) // 7 || 'w' ELSE (o_orderkey % 60) // 30 || 'mo' END AS age FROM orders""",
)
def dat01(spark, sf_dir):
    k = F.col("o_orderkey")
    days = k % 60
    written = F.when(k % 2 == 0, "2026-02-28").otherwise("2026-02-30")
    age = F.when(days < 7, F.concat(days, F.lit("d"))).when(days < 30, F.concat(F.floor(days / 7), F.lit("w"))).otherwise(F.concat(F.floor(days / 30), F.lit("mo")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), (k % 9).cast("int")).alias("later"), F.try_to_date(written, "yyyy-MM-dd").isNotNull().alias("is_date"), age.alias("age"))


@register(
    "arr01_arrays",
    """SELECT c_custkey, array_to_string(list_transform(range(5), lambda k: CAST(CAST(floor(k * (c_custkey % 50 + 9) / 4.0 + 0.5) AS INT) AS VARCHAR)), ',') AS strided, array_to_string(list_sort(list_append([30, 10, 20], CAST(c_custkey % 40 AS INT))), ',') AS inserted FROM customer""",
)
def arr01(spark, sf_dir):
    n = F.col("c_custkey") % 50 + 10
    at = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * (n - 1) / 4.0 + 0.5).cast("string"))
    added = F.array_sort(F.array_append(F.array(F.lit(30), F.lit(10), F.lit(20)), (F.col("c_custkey") % 40).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(at, ",").alias("strided"), F.array_join(added, ",").alias("inserted"))


@register(
    "sim03_adaptive_tolerance",
    f"SELECT user_id, {rnd('least(25.0, 5 + log2(greatest(count(*) / 20.0, 1.0)) * (1 + max(event_id) / 500.0) * 5)', 5)} AS metres FROM events GROUP BY user_id",
)
def sim03(spark, sf_dir):
    over = F.log2(F.greatest(F.count("*") / 20.0, F.lit(1.0)))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(js_round(F.least(F.lit(25.0), 5 + over * (1 + F.max("event_id") / 500.0) * 5), 5).alias("metres"))


@register("agg37_elevation_axis", "SELECT user_id, min(value) AS lo, max(value) AS hi, greatest(ceil(max(value) / 50.0) * 50, 100.0) AS ceiling FROM events GROUP BY user_id")
def agg37(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.greatest(F.ceil(F.max("value") / 50.0) * 50, F.lit(100.0)).cast("double").alias("ceiling"))


@register("snk11_guards", "SELECT user_id, count(*) <= 500 AND bool_and(value >= 0) AND octet_length(encode(string_agg(event_type, '' ORDER BY event_id))) <= 65536 AS fine FROM events GROUP BY user_id")
def snk11(spark, sf_dir):
    stops = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value")))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(stops.alias("s"))
    size = F.octet_length(F.array_join(F.transform("s", lambda x: x["event_type"]), ""))
    return per.select("user_id", ((F.size("s") <= 500) & F.forall("s", lambda x: x["value"] >= 0) & (size <= 65536)).alias("fine"))


@register("snk12_manifest", "SELECT sha256(p_name) AS sha, md5(p_name) AS md5, octet_length(encode(p_name)) AS bytes, p_partkey FROM part")
def snk12(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.sha2("p_name", 256).alias("sha"), F.md5("p_name").alias("md5"), F.octet_length("p_name").cast("long").alias("bytes"), "p_partkey")
