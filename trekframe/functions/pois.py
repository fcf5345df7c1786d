"""Types of waypoints and tags of places, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from trekframe.functions.text import safe_http_url

# Waypoint types where water or supplies can be had, with the names other files use.
WATER_TYPES = [
    "water", "water-tank", "spring", "creek", "stream", "river", "tap", "tank", "rainwater", "water-source", "watersource", "waterhole", "well", "soak", "bore", "trough",
]
RESUPPLY_TYPES = [
    "town", "food", "resupply", "town-access", "food-access", "resupply-access", "store", "shop", "supermarket", "grocery", "groceries", "kiosk", "cafe", "restaurant",
    "post-office", "postoffice", "roadhouse", "village", "settlement",
]
# Types to spend a night at.
OVERNIGHT_TYPES = ["camp", "campsite", "campground", "shelter", "hut", "accommodation", "caravan-park"]

# The tags of each category in order, and those that only count once nothing else does.
CATALOG = [
    ("water", "amenity", "drinking_water"), ("water", "natural", "spring"), ("water", "man_made", "water_tap"), ("water", "amenity", "water_point"),
    ("camping", "tourism", "camp_site"), ("camping", "tourism", "caravan_site"), ("camping", "tourism", "alpine_hut"), ("camping", "tourism", "wilderness_hut"), ("camping", "amenity", "shelter"),
    ("resupply", "shop", "supermarket"), ("resupply", "shop", "convenience"), ("resupply", "shop", "general"), ("resupply", "shop", "kiosk"), ("resupply", "shop", "bakery"),
    ("resupply", "shop", "greengrocer"), ("resupply", "shop", "outdoor"), ("resupply", "amenity", "fuel"), ("resupply", "amenity", "post_office"),
    ("restaurant", "amenity", "restaurant"), ("restaurant", "amenity", "cafe"), ("restaurant", "amenity", "fast_food"), ("restaurant", "amenity", "pub"), ("restaurant", "amenity", "bar"),
    ("restaurant", "amenity", "food_court"),
    ("transport", "highway", "bus_stop"), ("transport", "railway", "station"), ("transport", "railway", "halt"), ("transport", "railway", "tram_stop"), ("transport", "amenity", "ferry_terminal"),
    ("emergency", "amenity", "hospital"), ("emergency", "amenity", "clinic"), ("emergency", "amenity", "doctors"), ("emergency", "amenity", "pharmacy"), ("emergency", "amenity", "police"),
    ("emergency", "amenity", "fire_station"), ("emergency", "amenity", "ranger_station"), ("emergency", "emergency", "phone"),
]
FALLBACKS = [("water", "drinking_water", "yes")]
EXCLUSIONS = {("camping", "amenity", "shelter"): [("shelter_type", "public_transport")]}
CATEGORIES = ["water", "camping", "resupply", "restaurant", "transport", "emergency"]

# Fixed values of the noise rules.
MINOR_SHELTERS = ["picnic_shelter", "gazebo", "pavilion", "sun_shelter", "pergola"]
SHELTER_KEEP_WORDS = ["camp", "hut", "shelter", "hostel", "yha", "cabin", "bunk"]
PICNIC, SHUTTLE, CAR_SHUTTLE = r"\bpicnic\b", r"(?i)\b(shuttle|pick-?up)\b", r"(?i)\b(parking|car ?park|airport)\b"
ROAD_PHONE = r"(?i)\b(motorway|freeway|expressway|tunnel|distributor|off-?ramp|on-?ramp)\b"

# Ways nobody walks on, and what a ``foot`` tag says.
UNWALKABLE = ["motorway", "motorway_link", "construction", "proposed", "abandoned", "razed", "raceway", "bus_guideway", "escape"]
FOOT_NO, FOOT_YES, ACCESS_NO = ["no", "private", "use_sidepath"], ["yes", "designated", "permissive"], ["no", "private"]

# The tags shown of a place, with their labels.
PRIMARY_TAGS = ["amenity", "shop", "tourism", "natural", "man_made", "emergency", "highway", "healthcare", "leisure"]
LABELLED_TAGS = [
    ("description", "Description", None), ("opening_hours", "Opening hours", None), ("drinking_water", "Drinking water", None), ("water_source", "Water source", None), ("fee", "Fee", None),
    ("access", "Access", None), ("capacity", "Capacity", None), ("operator", "Operator", None), ("ele", "Elevation (m)", None), ("phone", "Phone", "tel"), ("contact:phone", "Phone", "tel"),
    ("website", "Website", "url"), ("contact:website", "Website", "url"), ("url", "Website", "url"),
]


def type_key(kind: Column) -> Column:
    return F.lower(F.trim(kind))


def is_water(kind: Column) -> Column:
    """(FLT01)"""
    return F.coalesce(type_key(kind).isin(WATER_TYPES), F.lit(False))


def is_resupply(kind: Column) -> Column:
    """(FLT02)"""
    return F.coalesce(type_key(kind).isin(RESUPPLY_TYPES), F.lit(False))


def in_family(kind: Column, family: Column) -> Column:
    """Whether a type belongs to the water or the resupply family (FLT03)."""
    return F.when(family == "water", is_water(kind)).otherwise(is_resupply(kind))


def is_access(kind: Column) -> Column:
    """Whether a type is a turn-off and not the place itself (FLT04)."""
    return F.coalesce(type_key(kind).endswith("-access"), F.lit(False))


def base_type(kind: Column) -> Column:
    """The type of the place that a turn-off serves (FLT04)."""
    return F.coalesce(F.regexp_replace(type_key(kind), "-access$", ""), F.lit(""))


def is_overnight(kind: Column, towns: bool = True) -> Column:
    """Whether one can spend a night there; never at a turn-off (FLT14)."""
    base = base_type(kind)
    return ~is_access(kind) & (base.isin(OVERNIGHT_TYPES) | ((base == "town") & F.lit(towns)))


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def has_tag(tags: Column, key: str, value: str) -> Column:
    return F.coalesce(tag(tags, key) == value, F.lit(False))


def noise_reason(name: Column, tags: Column, excluded: list[tuple[str, str]] = ()) -> Column:
    """Why a place is not worth showing, by the first rule that holds, else null (FLT05). ``excluded`` are a trail's own
    tags; shops for supplies are spared those."""
    shop = has_tag(tags, "shop", "convenience") | has_tag(tags, "shop", "supermarket")
    own = F.lit(False)
    for key, value in excluded:
        own = own | has_tag(tags, key, value)
    called = F.coalesce(name, F.lit(""))
    shuttle = called.rlike(SHUTTLE) & ~called.rlike(CAR_SHUTTLE)
    low = F.lower(called)
    kept = F.lit(False)
    for word in SHELTER_KEEP_WORDS:
        kept = kept | low.contains(word)
    minor = F.coalesce(tag(tags, "shelter_type").isin(MINOR_SHELTERS), F.lit(False))
    road = F.coalesce(tag(tags, "addr:street"), F.lit("")).rlike(ROAD_PHONE)
    return (
        F.when(own & ~shop, "excluded-by-trail")
        .when(has_tag(tags, "highway", "bus_stop") & ~shuttle, "bus-stop")
        .when(minor & (low.rlike(PICNIC) | ~kept), "minor-shelter")
        .when(has_tag(tags, "emergency", "no"), "no-emergency-department")
        .when(has_tag(tags, "emergency", "phone") & road, "road-emergency-phone")
    )


def rule_matches(tags: Column, key: str, value: str, exclude: list[tuple[str, str]] = (), require: list[tuple[str, str | None]] = ()) -> Column:
    """Whether tags have ``key=value``, all that is required (any value, if none is named) and nothing excluded (FLT07)."""
    out = has_tag(tags, key, value)
    for k, v in require:
        out = out & (tag(tags, k).isNotNull() if v is None else has_tag(tags, k, v))
    for k, v in exclude:
        out = out & ~has_tag(tags, k, v)
    return out


def categorise(tags: Column, preferred: list[str] | None = None) -> Column:
    """Category of a place: the first rule that its tags match, preferred categories before the others and fallbacks
    after the rules of either (FLT08, MAP01)."""
    first = CATEGORIES if preferred is None else [c for c in CATEGORIES if c in preferred]
    rest = [c for c in CATEGORIES if c not in first]
    out = F.lit(None).cast("string")
    for group, rules in ((rest, FALLBACKS), (rest, CATALOG), (first, FALLBACKS), (first, CATALOG)):
        for category, key, value in reversed(sorted((r for r in rules if r[0] in group), key=lambda r: group.index(r[0]))):
            out = F.when(rule_matches(tags, key, value, EXCLUSIONS.get((category, key, value), ())), category).otherwise(out)
    return out


def is_walkable(tags: Column) -> Column:
    """Whether a way's tags let someone walk along it (FLT16)."""
    yes = lambda key, values: F.coalesce(tag(tags, key).isin(values), F.lit(False))
    way = F.coalesce((tag(tags, "highway") != "") & ~tag(tags, "highway").isin(UNWALKABLE), F.lit(False))
    return way & F.when(yes("foot", FOOT_NO), False).when(yes("foot", FOOT_YES), True).otherwise(~yes("access", ACCESS_NO))


# The kinds of places that a walker steers by in a town, each with the tags that tell it.
ANCHORS = [
    ("supermarket", {"shop": ["supermarket"]}), ("convenience", {"shop": ["convenience"]}), ("outdoor", {"shop": ["outdoor"]}),
    ("post-office", {"amenity": ["post_office"]}), ("campground", {"tourism": ["camp_site", "caravan_site"]}), ("hut", {"tourism": ["wilderness_hut", "alpine_hut"]}),
    ("hospital", {"amenity": ["hospital"], "emergency": ["yes"]}), ("station", {"railway": ["station"]}), ("ferry", {"amenity": ["ferry_terminal"]}),
]


def anchor_kind(tags: Column) -> Column:
    """What a place anchors a walker's stay in a town by, null for any other place (MAP02)."""
    has = lambda rule: reduce(and_, (F.coalesce(tag(tags, key).isin(values), F.lit(False)) for key, values in rule.items()))
    return F.coalesce(*(F.when(has(rule), kind) for kind, rule in ANCHORS))


def slim_tags(tags: Column) -> Column:
    """The tags that are shown (PRJ01)."""
    shown = [*PRIMARY_TAGS, *(key for key, _, _ in LABELLED_TAGS)]
    return F.map_filter(tags, lambda k, v: k.isin(shown) & F.coalesce(v != "", F.lit(False)))


def tag_summary(tags: Column) -> Column:
    """Lines ``(label, value, href)``: the first primary tag, then one line for each label that has a value (PRJ02)."""
    text = lambda key: F.nullif(F.trim(tag(tags, key)), F.lit(""))
    line = lambda label, value, href: F.struct(F.lit(label).alias("label"), value.alias("value"), href.alias("href"))
    none = F.lit(None).cast("string")
    primary = F.coalesce(*(F.concat(F.lit(f"{key}="), text(key)) for key in PRIMARY_TAGS))
    lines = [line("OSM tag", primary, none)]
    for label in dict.fromkeys(label for _, label, _ in LABELLED_TAGS):
        own = [(key, kind) for key, name, kind in LABELLED_TAGS if name == label]
        value = F.coalesce(*(text(key) for key, _ in own))
        href = safe_http_url(value) if own[0][1] == "url" else safe_tel_url(value) if own[0][1] == "tel" else none
        lines.append(line(label, value, href))
    return F.filter(F.array(*lines), lambda x: x["value"].isNotNull())


def safe_tel_url(value: Column) -> Column:
    """A ``tel:`` link of a number's digits and what may stand between them, else null (STR_13)."""
    cleaned = F.trim(F.regexp_replace(value, r"[^\d+\-().\s]", ""))
    return F.when(cleaned.rlike(r"\d"), F.concat(F.lit("tel:"), F.regexp_replace(cleaned, r"\s+", "")))
