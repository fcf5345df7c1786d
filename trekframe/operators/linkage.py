"""Matching places with waypoints, and merging copies of one waypoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions.geo import haversine_m
from trekframe.functions.rounding import js_round
from trekframe.functions.text import all_tokens, is_unnamed, name_score, names_distinguished, set_score, without_generic
from trekframe.operators.graph import connected_components
from trekframe.operators.spatial import radius_pairs
from trekframe.storage import materialize


# The waypoint types that a place of each category may repeat, and those that say nothing.
COMPATIBLE_TYPES = {
    "camping": ["campsite", "caravan-park", "hut", "shelter", "camp"],
    "water": ["water", "water-tank", "tank", "spring", "water-source"],
    "resupply": ["resupply", "food", "shop"],
    "restaurant": ["food", "resupply"],
    "emergency": ["emergency", "hospital"],
}
GENERIC_TYPES = ["poi", "waypoint"]


def types_for(category: Column, compatible: dict[str, list[str]] = COMPATIBLE_TYPES, generic: bool = False) -> Column:
    """The types that a place of this category may repeat (FLT25); with ``generic`` also those that say nothing."""
    table = F.create_map(*(x for c, types in compatible.items() for x in (F.lit(c), F.array(*map(F.lit, types)))))
    own = F.coalesce(F.try_element_at(table, category), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(own, F.array(*map(F.lit, GENERIC_TYPES)))) if generic else own


def mark_duplicates(
    places: DataFrame, waypoints: DataFrame, compatible: dict[str, list[str]] = COMPATIBLE_TYPES, radius_m: float = 250.0, near_m: float = 25.0, same_m: float = 10.0,
    unnamed_m: float = 30.0, margin_m: float = 30.0, exact_lcs: bool = True,
) -> DataFrame:
    """``(place_id, waypoint_id, score, metres)``: the waypoint that a place repeats, if any (JON20, FLT25, STR_01-04).

    ``places`` are ``(place_id, category, name, lat, lon)``, ``waypoints`` ``(waypoint_id, type, wp_name, lat, lon)``. A
    named place repeats a waypoint within ``radius_m`` whose type its category allows, whose name scores 0.9 (0.85 within
    ``near_m``) and is told apart by no word or number; within ``same_m`` a full score also serves for a waypoint whose
    type says nothing, but for transport. The best by score, then by the very same words, then distance, then id counts.
    An unnamed camping place repeats the nearest waypoint of an allowed type within ``unnamed_m``, unless another one
    with another name is at most ``margin_m`` farther; its score is null. Without ``exact_lcs`` names score by their
    words alone. Names are cut into words once a row, before the sides meet by cell and type. Places of one category, name and
    position are compared once; of waypoints of one type, name and position the first counts, and the last stands for the
    others, as a rival.
    """
    score_of = name_score if exact_lcs else set_score
    alike = F.struct("category", "name", "lat", "lon")
    each, places = places.select("place_id", alike.alias("_p")), materialize(places.select("category", "name", "lat", "lon").distinct().withColumn("place_id", alike), "alike")
    ends = waypoints.where("waypoint_id is not null").groupBy("type", "wp_name", "lat", "lon").agg(F.array_distinct(F.array(F.min("waypoint_id"), F.max("waypoint_id"))).alias("_w"))
    waypoints = materialize(ends.select(F.explode("_w").alias("waypoint_id"), "type", "wp_name", "lat", "lon"), "ends")
    tokens = places.withColumn("_a", all_tokens(F.col("name"))).withColumn("_unnamed", is_unnamed(F.col("name"), F.col("_a")))
    wp = waypoints.select("waypoint_id", "type", "lat", "lon", all_tokens(F.col("wp_name")).alias("_b"))
    named = tokens.where(F.size(without_generic(F.col("_a"))) > 0)
    sides = named.select("place_id", "category", "lat", "lon", "_a", F.explode(types_for(F.col("category"), compatible, True)).alias("type"))
    met = radius_pairs(sides, wp.where(F.size(without_generic(F.col("_b"))) > 0), radius_m, keys=("type",))
    met = met.where(~names_distinguished(F.col("_a"), F.col("_b"))).withColumn("score", score_of(F.col("_a"), F.col("_b")))
    allowed = F.array_contains(types_for(F.col("category"), compatible), F.col("type"))
    same = (F.col("metres") <= same_m) & (F.col("score") == 1) & (F.col("category") != "transport") & F.col("type").isin(GENERIC_TYPES)
    fine = (F.col("score") >= F.when(F.col("metres") <= near_m, 0.85).otherwise(0.9)) & (allowed | same)
    words = lambda t: F.array_sort(F.array_distinct(without_generic(F.col(t))))
    order = F.struct(-F.col("score"), words("_a") != words("_b"), "metres", "waypoint_id")
    best = met.where(fine).groupBy("place_id").agg(F.min_by(F.struct("waypoint_id", "score", "metres"), order).alias("b")).select("place_id", "b.*")

    nameless = tokens.where((F.col("category") == "camping") & F.col("_unnamed")).select("place_id", "lat", "lon", F.explode(types_for(F.col("category"), compatible)).alias("type"))
    near = radius_pairs(nameless, wp, unnamed_m + margin_m, keys=("type",)).select("place_id", "waypoint_id", "metres", "_b")
    host = near.groupBy("place_id").agg(F.min(F.struct("metres", "waypoint_id", "_b")).alias("h")).where(F.col("h.metres") <= unnamed_m)
    others = near.join(host, "place_id").where((F.col("waypoint_id") != F.col("h.waypoint_id")) & (F.col("metres") - F.col("h.metres") <= margin_m))
    rivals = others.where(score_of(F.col("h._b"), F.col("_b")) < 0.9).select("place_id").distinct()
    lone = host.join(rivals, "place_id", "left_anti")
    found = best.unionByName(lone.select("place_id", "h.waypoint_id", F.lit(None).cast("double").alias("score"), "h.metres"))
    return each.join(found.withColumnRenamed("place_id", "_p"), "_p").drop("_p")


def is_visible(category: Column, duplicate_of: Column, state: Column) -> Column:
    """Whether a place is shown (FLT09): never one that repeats a waypoint (FLT24), none with the master switch off, and one
    of a category without a switch always. ``state`` is ``(enabled, categories)``."""
    return duplicate_of.isNull() & state["enabled"] & F.coalesce(F.try_element_at(state["categories"], category), F.lit(True))


def count_duplicates(places: DataFrame, key: str) -> DataFrame:
    """``(key, duplicates, distinct_places)`` (AGG26)."""
    repeats = F.col("duplicate_of").isNotNull()
    return places.groupBy(key).agg(F.count_if(repeats).alias("duplicates"), F.count_if(~repeats).alias("distinct_places"))


def lone_host(places: DataFrame, waypoints: DataFrame, radius_m: float = 30.0, margin_m: float = 30.0) -> DataFrame:
    """``(place_id, waypoint_id)``: the nearest waypoint, unless another one is nearly as near (JON21)."""
    met = radius_pairs(places, waypoints, radius_m + margin_m)
    w = Window.partitionBy("place_id").orderBy("metres", "waypoint_id")
    ranked = met.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("metres").over(w))
    return ranked.where((F.col("r") == 1) & (F.col("metres") <= radius_m) & (F.col("next").isNull() | (F.col("next") - F.col("metres") > margin_m))).select("place_id", "waypoint_id")


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with overridden values, and the overrides that match no row (JON22, JON37)."""
    new = overrides.select(key, F.col(value).alias("_new"))
    out = rows.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")
    return out, overrides.join(rows.select(key), key, "left_anti")


def merge_near_copies(waypoints: DataFrame, radius_m: float = 150.0) -> DataFrame:
    """``(survivor, waypoint_id, merged_ids, description)`` of groups of near waypoints of one name and type (SET07-09, ARR02).

    Single links within the radius, closed over components; copies at one position are linked with the first of them only, and
    that one with others. The survivor is the preferred one, then the first along
    the trail, then the smallest id. Descriptions are joined once each, in order of id.
    """
    same = ["name", "type", "lat", "lon"]
    sound = waypoints.where(" and ".join(f"{c} is not null" for c in same)).select("waypoint_id", *same)
    first = materialize(sound.groupBy(*same).agg(F.min("waypoint_id").alias("a")), "first")
    links = radius_pairs(first, first.withColumnRenamed("a", "b"), radius_m, keys=("name", "type")).where("a < b").select("a", "b")
    links = links.unionByName(sound.join(first, same).where("waypoint_id > a").select("a", F.col("waypoint_id").alias("b")))
    groups = connected_components(links, "a", "b").withColumnsRenamed({"node": "waypoint_id"})
    members = waypoints.join(groups, "waypoint_id")
    order = F.struct((~F.col("preferred")).alias("p"), F.col("km").isNull().alias("n"), F.col("km"), F.col("waypoint_id"))
    merged = members.groupBy("component").agg(
        F.min_by("waypoint_id", order).alias("survivor"), F.array_sort(F.collect_list("waypoint_id")).alias("merged_ids"),
        F.array_sort(F.collect_list(F.struct("waypoint_id", "description"))).alias("_d"),
    )
    texts = F.array_distinct(F.filter(F.transform("_d", lambda d: d["description"]), lambda t: t.isNotNull() & (t != "")))
    return merged.select("survivor", "merged_ids", F.array_join(texts, "\n\n").alias("description"))


def unique_ids(rows: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Repeated ids get ``_2``, ``_3``, ... in order (SET10)."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.concat_ws("_", key, n)))


def union_first_wins(*parts: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows of all parts; of one id the first part's first row counts, rows without id are all kept (SET06, SET01, JON42)."""
    out = None
    for k, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(k))
        out = part if out is None else out.unionByName(part)
    n = F.row_number().over(Window.partitionBy(key).orderBy("_part", order))
    return out.withColumn("_n", n).where(f"_n = 1 or {key} is null").drop("_n", "_part")


def first_lookup(rows: DataFrame, table: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``value`` of the table's first row with the same key, null if there is none (JON41)."""
    first = table.groupBy(key).agg(F.min_by(value, order).alias(value))
    return rows.join(first, key, "left")


def placed_at_junctions(waypoints: DataFrame, placements: DataFrame, most_m: float, stale_m: float = 50.0, slack_m: float = 100.0) -> DataFrame:
    """``(waypoint_id, state, lat, lon)``: waypoints put at the junction of their access entry, unless it is out of date (JON36).

    ``waypoints`` are ``(waypoint_id, lat, lon, track_m)`` with their distance from the route, ``placements``
    ``(waypoint_id, j_lat, j_lon, off_km, junction_m)`` with the junction's. An entry is ignored if the place is out of
    reach of the route and of the entry's own walk ('far'), or if the junction has left the route ('stale').
    """
    met = waypoints.join(placements, "waypoint_id", "left")
    walk = haversine_m(F.col("j_lat"), F.col("j_lon"), F.col("lat"), F.col("lon")) <= F.col("off_km") * 1000 + slack_m
    far = (F.col("track_m") > most_m) & ~walk
    state = F.when(F.col("j_lat").isNull(), "unlisted").when(far, "far").when(F.col("junction_m") > stale_m, "stale").otherwise("placed")
    at = lambda own, junction: F.when(F.col("state") == "placed", F.col(junction)).otherwise(F.col(own)).alias(own)
    return met.withColumn("state", state).select("waypoint_id", "state", at("lat", "j_lat"), at("lon", "j_lon"))


def stop_issues(stops: DataFrame, places: DataFrame, route_km: DataFrame, moved_km: float = 0.5) -> DataFrame:
    """``(plan, stop, issue)`` of planned stops that no longer fit (JON52): whose waypoint is gone, that lie beyond the
    route, or whose waypoint has moved along it. ``stops`` are ``(plan, stop, waypoint_id, km)``, with a null waypoint for a
    place of the traveller's own; ``places`` ``(waypoint_id, place_km)``, ``route_km`` ``(plan, total_km)``."""
    met = stops.join(places, "waypoint_id", "left").join(route_km, "plan", "left")
    issue = F.when(F.col("waypoint_id").isNotNull() & F.col("place_km").isNull(), "missing").when((F.col("km") < 0) | (F.col("km") > F.col("total_km")), "off-route")
    issue = issue.when(F.abs(F.col("place_km") - F.col("km")) > moved_km, "moved")
    return met.select("plan", "stop", issue.alias("issue")).where("issue is not null")


def index_entries(configs: DataFrame, points: DataFrame) -> DataFrame:
    """An entry of the trails' index for each config, with the start of its track (PRJ04)."""
    first = points.groupBy("id").agg(F.min_by(F.struct(js_round("lat", 5).alias("lat"), js_round("lon", 5).alias("lon")), "idx").alias("start"))
    return configs.join(first, "id", "left").select("id", "name", "region", F.upper("country").alias("country"), F.coalesce("states", F.array().cast("array<string>")).alias("states"), "start")


def sectioned(rows: DataFrame, query: str, current: str) -> DataFrame:
    """Adds ``place``: trails that match a query, the current one first, then curated ones by country, travellers' own and
    imported ones (SRT25). Rows are ``(id, name, country, source)``; they are the few that one list shows."""
    met = rows.where(F.lower("name").contains(query.strip().lower()) | (F.col("id") == current))
    section = F.when(F.col("id") == current, 0).when(F.col("source") == "curated", 1).when(F.col("source") == "community", 2).otherwise(3)
    w = Window.partitionBy(F.lit(0)).orderBy(section, F.when(section == 1, F.col("country")), F.lower("name"), "id")
    return met.withColumn("section", section).withColumn("place", F.row_number().over(w))


def finish_places(places: DataFrame, points: DataFrame, waypoints: DataFrame, radius_m: float, spacing_km: float, excluded: list[tuple[str, str]] = (), city: tuple = (15.0, 7.5, 40, 5)) -> DataFrame:
    """The places of a trail that are worth showing (SIM21): set on the track within the radius, without noise, without those
    that repeat a waypoint, thinned where they are dense as in a ``city``, with short numbers and the tags that are shown.

    ``places`` are ``(place_id, name, tags, lat, lon)``, ``points`` a measured track, ``waypoints`` as in
    ``mark_duplicates``. Returns ``(place_id, trail_id, category, name, lat, lon, km, off_km, tags)``.
    """
    from trekframe.functions import pois
    from trekframe.operators.ordered import dense_stretches, thin_dense
    from trekframe.operators.spatial import snap_to_track

    told = places.withColumns({"category": pois.categorise(F.col("tags")), "noise": pois.noise_reason(F.col("name"), F.col("tags"), list(excluded))})
    sound = materialize(told, "told").where("noise is null and category is not null").drop("noise")
    placed = materialize(sound.join(snap_to_track(sound, points, radius_m).select("place_id", "trail_id", "km", "metres"), "place_id"), "placed")
    copies = mark_duplicates(placed.select("place_id", "category", "name", "lat", "lon"), waypoints).select("place_id")
    kept = placed.join(copies, "place_id", "left_anti").withColumns({"anchor": pois.anchor_kind(F.col("tags")), "branded": F.coalesce(pois.tag(F.col("tags"), "brand") != "", F.lit(False)), "off_km": F.col("metres") / 1000, "kept": F.lit(False)})
    kept = materialize(kept, "kept")
    thin = thin_dense(kept, dense_stretches(kept, *city), spacing_km)
    return thin.select(
        "place_id", "trail_id", "category", "name", js_round("lat", 6).alias("lat"), js_round("lon", 6).alias("lon"), js_round("km", 1).alias("km"), js_round(F.col("metres") / 1000, 2).alias("off_km"),
        pois.slim_tags(F.col("tags")).alias("tags"),
    )
