"""Queries on places and their tags. Events stand for places, with tags, names and types dealt by their id."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.functions import pois
from trekframe.functions.rounding import js_round
from trekframe.operators import linkage
from trekframe.plans.registry import register
from trekframe.plans.tables import rnd, table

# Input: what each tag of a place may be, by the remainder of its id; an empty value is no tag.
_VALUES = {
    "amenity": ["", "drinking_water", "cafe", "shelter", "fuel", "toilets", "hospital"],
    "shop": ["", "", "convenience", "", "bakery"],
    "tourism": ["", "camp_site", "", "", "museum", "", "", "", "wilderness_hut", "", ""],
    "highway": ["", "bus_stop", "", "path", "motorway", "", "", "track", "", "", "", "", ""],
    "shelter_type": ["", "picnic_shelter", "public_transport", "", "weather_shelter", "gazebo", "", ""],
    "emergency": ["", "no", "phone", "", "", "", "", "", ""],
    "addr:street": ["", "Old Road", "Pacific Motorway", "North Off-Ramp"],
    "drinking_water": ["", "yes", "no"],
    "foot": ["", "no", "yes", "private", "designated", ""],
    "access": ["", "private", "yes", "no", ""],
    "website": ["", "https://example.org/a", " ", "ftp://example.org"],
    "phone": ["", "+61 (8) 9755", "none", ""],
    "description": ["", " A spring ", "  "],
}
_NAMES = ["", "Centenary Gazebo", "Picnic Hut", "Ponderosa Campground", "Cradle Shuttle Bus", "Airport shuttle", "Big Shelter", "Ronny Creek pick-up", "Plain"]
_TYPES = [" Spring ", "town-access", "Supermarket", "hut", "WATER-tank", "campsite", "hut-access", "town", "water-access", "Cafe", "", "caravan-park", "resupply-access"]


def _dealt(values: list[str], step: int = 1):
    return F.nullif(F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("event_id") / step) % len(values) + 1).cast("int")), F.lit(""))


def _dealt_sql(values: list[str], step: int = 1) -> str:
    return f"nullif([{', '.join(repr(v) for v in values)}][1 + (event_id // {step}) % {len(values)}], '')"


def places(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    entries = F.array(*(F.struct(F.lit(k).alias("key"), _dealt(v, 1 + i % 3).alias("value")) for i, (k, v) in enumerate(_VALUES.items())))
    tags = F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull()))
    return e.select("event_id", "user_id", "value", _dealt(_NAMES, 2).alias("name"), _dealt(_TYPES).alias("type"), tags.alias("tags"))


_TAG = {k: f'"{k}"' for k in _VALUES}
PLACES = f"""p AS (SELECT event_id, user_id, value, {_dealt_sql(_NAMES, 2)} AS name, {_dealt_sql(_TYPES)} AS type, {", ".join(f'{_dealt_sql(v, 1 + i % 3)} AS "{k}"' for i, (k, v) in enumerate(_VALUES.items()))} FROM events)"""
_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)


@register("flt02_resupply_types", f"WITH {PLACES} SELECT event_id, coalesce(lower(trim(type)) IN ({_QUOTED(pois.RESUPPLY_TYPES)}), false) AS resupply FROM p")
def flt02(spark, sf_dir):
    return places(spark, sf_dir).select("event_id", pois.is_resupply(F.col("type")).alias("resupply"))


@register(
    "flt03_family",
    f"WITH {PLACES} SELECT event_id FROM p WHERE lower(trim(type)) IN ({_QUOTED(pois.WATER_TYPES)}) AND event_id % 2 = 0 UNION ALL SELECT event_id FROM p WHERE lower(trim(type)) IN ({_QUOTED(pois.RESUPPLY_TYPES)}) AND event_id % 2 = 1",
)
def flt03(spark, sf_dir):
    family = F.when(F.col("event_id") % 2 == 0, "water").otherwise("resupply")
    return places(spark, sf_dir).where(pois.in_family(F.col("type"), family)).select("event_id")


@register("flt04_turn_offs", f"WITH {PLACES} SELECT event_id, coalesce(suffix(lower(trim(type)), '-access'), false) AS turn_off, coalesce(regexp_replace(lower(trim(type)), '-access$', ''), '') AS base FROM p")
def flt04(spark, sf_dir):
    return places(spark, sf_dir).select("event_id", pois.is_access(F.col("type")).alias("turn_off"), pois.base_type(F.col("type")).alias("base"))


_OWN = [("amenity", "fuel"), ("amenity", "cafe")]
_REASON = f"""CASE WHEN amenity IN ('fuel', 'cafe') AND coalesce(shop, '') NOT IN ('convenience', 'supermarket') THEN 'excluded-by-trail'
  WHEN highway = 'bus_stop' AND NOT (regexp_matches(coalesce(name, ''), '\\b(shuttle|pick-?up)\\b', 'i') AND NOT regexp_matches(coalesce(name, ''), '\\b(parking|car ?park|airport)\\b', 'i')) THEN 'bus-stop'
  WHEN shelter_type IN ({_QUOTED(pois.MINOR_SHELTERS)}) AND (regexp_matches(lower(coalesce(name, '')), '\\bpicnic\\b') OR NOT regexp_matches(lower(coalesce(name, '')), 'camp|hut|shelter|hostel|yha|cabin|bunk')) THEN 'minor-shelter'
  WHEN emergency = 'no' THEN 'no-emergency-department'
  WHEN emergency = 'phone' AND regexp_matches(coalesce("addr:street", ''), '\\b(motorway|freeway|expressway|tunnel|distributor|off-?ramp|on-?ramp)\\b', 'i') THEN 'road-emergency-phone' END"""


@register("flt05_noise_reason", f"WITH {PLACES} SELECT event_id, {_REASON} AS reason FROM p")
def flt05(spark, sf_dir):
    return places(spark, sf_dir).select("event_id", pois.noise_reason(F.col("name"), F.col("tags"), _OWN).alias("reason"))


@register("flt06_without_noise", f"WITH {PLACES}, r AS (SELECT event_id, name, {_REASON} AS reason FROM p) SELECT event_id, name FROM r WHERE reason IS NULL")
def flt06(spark, sf_dir):
    return places(spark, sf_dir).where(pois.noise_reason(F.col("name"), F.col("tags"), _OWN).isNull()).select("event_id", "name")


@register("flt07_tag_rule", f"WITH {PLACES} SELECT event_id FROM p WHERE amenity = 'shelter' AND coalesce(shelter_type, '') <> 'public_transport' AND drinking_water IS NOT NULL AND access = 'yes'")
def flt07(spark, sf_dir):
    rule = pois.rule_matches(F.col("tags"), "amenity", "shelter", exclude=[("shelter_type", "public_transport")], require=[("drinking_water", None), ("access", "yes")])
    return places(spark, sf_dir).where(rule).select("event_id")


def _catalog_sql(preferred: list[str]) -> str:
    """The catalog as rows with a rank; the least rank that a place's tags match gives its category."""
    order = [c for c in pois.CATEGORIES if c in preferred] + [c for c in pois.CATEGORIES if c not in preferred]
    rows = [(c, k, v, 0) for c, k, v in pois.CATALOG] + [(c, k, v, 1) for c, k, v in pois.FALLBACKS]
    rank = lambda r: (r[0] not in preferred, r[3], order.index(r[0]))
    ranked = sorted(rows, key=rank)
    return "rules(rank, category, k, v) AS (VALUES " + ", ".join(f"({i}, '{c}', '{k}', '{v}')" for i, (c, k, v, _) in enumerate(ranked)) + ")"


_LONG = ", ".join(f"struct_pack(k := '{k}', v := \"{k}\")" for k in _VALUES)


def _category_sql(preferred: list[str], name: str) -> str:
    return f"""{name} AS (SELECT l.event_id, arg_min(category, rank) AS category FROM (SELECT event_id, shelter_type, unnest([{_LONG}]) AS t FROM p) l JOIN ({"WITH " + _catalog_sql(preferred) + " SELECT * FROM rules"}) r
  ON l.t.k = r.k AND l.t.v = r.v AND NOT (r.v = 'shelter' AND coalesce(shelter_type, '') = 'public_transport') GROUP BY l.event_id)"""


@register(
    "flt08_categories",
    f"""WITH {PLACES}, {_category_sql(pois.CATEGORIES, 'a')}, {_category_sql(['transport', 'water'], 'b')}
SELECT event_id, a.category AS category, b.category AS preferred FROM p LEFT JOIN a USING (event_id) LEFT JOIN b USING (event_id)""",
)
def flt08(spark, sf_dir):
    """Categories by the rule table, and again with transport and water asked for (FLT08, MAP01)."""
    t = F.col("tags")
    return places(spark, sf_dir).select("event_id", pois.categorise(t).alias("category"), pois.categorise(t, ["transport", "water"]).alias("preferred"))


@register(
    "flt16_walkable_ways",
    f"""WITH {PLACES} SELECT event_id, highway IS NOT NULL AND highway NOT IN ({_QUOTED(pois.UNWALKABLE)}) AND coalesce(foot, '') NOT IN ('no', 'private', 'use_sidepath')
  AND (coalesce(foot, '') IN ('yes', 'designated', 'permissive') OR coalesce(access, '') NOT IN ('no', 'private')) AS walkable FROM p""",
)
def flt16(spark, sf_dir):
    return places(spark, sf_dir).select("event_id", pois.is_walkable(F.col("tags")).alias("walkable"))


@register(
    "flt25_compatible_types",
    f"""WITH {PLACES}, c(category, type) AS (VALUES {", ".join(f"('{c}', '{t}')" for c, ts in linkage.COMPATIBLE_TYPES.items() for t in ts)}), {_category_sql(pois.CATEGORIES, 'a')}
SELECT p.event_id FROM p JOIN a USING (event_id) JOIN c ON c.category = a.category AND c.type = lower(trim(p.type))""",
)
def flt25(spark, sf_dir):
    allowed = F.array_contains(linkage.types_for(pois.categorise(F.col("tags"))), pois.type_key(F.col("type")))
    return places(spark, sf_dir).where(allowed).select("event_id")


_SHOWN = [k for k in _VALUES if k in [*pois.PRIMARY_TAGS, *(key for key, _, _ in pois.LABELLED_TAGS)]]


@register(
    "prj01_slim_places",
    f"""WITH {PLACES} SELECT event_id, {rnd('value / 7', 6)} AS lat, {rnd('value / 3', 1)} AS along, array_to_string(list_sort(list_filter([{", ".join(f"'{k}=' || " + _TAG[k] for k in _SHOWN)}], lambda x: x IS NOT NULL)), ';') AS tags FROM p""",
)
def prj01(spark, sf_dir):
    """Places with the tags that are shown and short numbers (PRJ01)."""
    kept = F.transform(F.map_entries(pois.slim_tags(F.col("tags"))), lambda x: F.concat_ws("=", x["key"], x["value"]))
    return places(spark, sf_dir).select("event_id", js_round(F.col("value") / 7, 6).alias("lat"), js_round(F.col("value") / 3, 1).alias("along"), F.array_join(F.array_sort(kept), ";").alias("tags"))


@register(
    "prj02_tag_summary",
    f"""WITH {PLACES}, s AS (SELECT event_id, coalesce('amenity=' || amenity, 'shop=' || shop, 'tourism=' || tourism, 'emergency=' || emergency, 'highway=' || highway) AS a, nullif(trim(description), '') AS d, drinking_water AS w, access AS x,
  phone AS t, nullif(trim(website), '') AS u FROM p)
SELECT event_id, array_to_string(list_filter(['OSM tag:' || a, 'Description:' || d, 'Drinking water:' || w, 'Access:' || x, 'Phone:' || t || CASE WHEN t = 'none' THEN '' ELSE ' tel:+61(8)9755' END,
  'Website:' || u || CASE WHEN u LIKE 'https:%' THEN ' ' || u ELSE '' END], lambda y: y IS NOT NULL), '|') AS lines FROM s""",
)
def prj02(spark, sf_dir):
    lines = F.transform(pois.tag_summary(F.col("tags")), lambda x: F.concat(x["label"], F.lit(":"), x["value"], F.coalesce(F.concat(F.lit(" "), x["href"]), F.lit(""))))
    return places(spark, sf_dir).select("event_id", F.array_join(lines, "|").alias("lines"))


@register(
    "flt14_overnight_places",
    f"""WITH {PLACES} SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS INT) AS place FROM p
WHERE lower(trim(type)) IN ({_QUOTED([*pois.OVERNIGHT_TYPES, 'town'])})""",
)
def flt14(spark, sf_dir):
    """Where each traveller could sleep, in order of km; a turn-off is no such place (FLT14)."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("value", "event_id")
    return places(spark, sf_dir).where(pois.is_overnight(F.col("type"))).select("event_id", F.row_number().over(order).alias("place"))


@register(
    "flt21_resupply_points",
    f"""WITH {PLACES} SELECT event_id, coalesce(name, 'Resupply') AS name, coalesce(value, 0) AS km, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value, 0), event_id) AS INT) AS place FROM p
WHERE lower(trim(type)) IN ({_QUOTED(pois.RESUPPLY_TYPES)})""",
)
def flt21(spark, sf_dir):
    from trekframe.operators.resupply import resupply_points

    rows = resupply_points(places(spark, sf_dir).withColumns({"trail_id": F.col("user_id"), "km": F.col("value"), "ord": F.col("event_id")}))
    return rows.select("event_id", "name", "km", "place")


@register(
    "flt09_visible_places",
    f"""WITH {PLACES}, {_category_sql(pois.CATEGORIES, 'a')} SELECT event_id FROM p LEFT JOIN a USING (event_id)
WHERE user_id % 4 <> 0 AND event_id % 5 <> 0 AND CASE category WHEN 'water' THEN user_id % 2 = 0 WHEN 'camping' THEN true WHEN 'transport' THEN false ELSE true END""",
)
def flt09(spark, sf_dir):
    """Places that a traveller's switches show; those that repeat a waypoint never are (FLT09)."""
    state = F.struct((F.col("user_id") % 4 != 0).alias("enabled"), F.create_map(F.lit("water"), F.col("user_id") % 2 == 0, F.lit("camping"), F.lit(True), F.lit("transport"), F.lit(False)).alias("categories"))
    rows = places(spark, sf_dir).withColumns({"category": pois.categorise(F.col("tags")), "duplicate_of": F.when(F.col("event_id") % 5 == 0, "w"), "state": state})
    return rows.where(linkage.is_visible(F.col("category"), F.col("duplicate_of"), F.col("state"))).select("event_id")


@register(
    "agg26_duplicates_by_category",
    f"""WITH {PLACES}, {_category_sql(pois.CATEGORIES, 'a')} SELECT category, count(*) FILTER (WHERE event_id % 5 = 0) AS duplicates, count(*) FILTER (WHERE event_id % 5 <> 0) AS distinct_places FROM p JOIN a USING (event_id) GROUP BY category""",
)
def agg26(spark, sf_dir):
    """Places that repeat a waypoint and those that do not, by category (AGG26, FLT24)."""
    rows = places(spark, sf_dir).withColumns({"category": pois.categorise(F.col("tags")), "duplicate_of": F.when(F.col("event_id") % 5 == 0, "w")}).where("category is not null")
    return linkage.count_duplicates(rows, "category")


# The tables of places have no such tags; they are dealt here in the same way.
_TOWN = {"shop": ["", "supermarket", "convenience", "outdoor", "bakery"], "amenity": ["", "post_office", "hospital", "ferry_terminal", "cafe", "hospital", ""], "tourism": ["", "camp_site", "caravan_site", "alpine_hut", "", "wilderness_hut", "", "", "", "", ""], "emergency": ["", "yes", "no"], "railway": ["", "station", "", "", "", "", "", "", "", "", "", "", ""]}


@register(
    "map02_anchor_kinds",
    f"""WITH t AS (SELECT event_id, {", ".join(f"{_dealt_sql(v)} AS {k}" for k, v in _TOWN.items())} FROM events)
SELECT event_id, CASE WHEN shop IN ('supermarket', 'convenience', 'outdoor') THEN shop WHEN amenity = 'post_office' THEN 'post-office' WHEN tourism IN ('camp_site', 'caravan_site') THEN 'campground' WHEN tourism IN ('wilderness_hut', 'alpine_hut') THEN 'hut'
  WHEN amenity = 'hospital' AND emergency = 'yes' THEN 'hospital' WHEN railway = 'station' THEN 'station' WHEN amenity = 'ferry_terminal' THEN 'ferry' END AS anchor FROM t""",
)
def map02(spark, sf_dir):
    entries = F.array(*(F.struct(F.lit(k).alias("key"), _dealt(v).alias("value")) for k, v in _TOWN.items()))
    rows = table(spark, sf_dir, "events").select("event_id", F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("tags"))
    return rows.select("event_id", pois.anchor_kind(F.col("tags")).alias("anchor"))
