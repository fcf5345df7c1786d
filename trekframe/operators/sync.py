"""Keeping copies in step: delta pages, tombstones, last writer wins, and merges without a table format."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_sizes(raw: Column, default: int = 20, most: int = 100) -> Column:
    """The page sizes that requests ask for: whole numbers from 1 up to the most, the default for anything else (SRT17)."""
    n = F.trim(raw).try_cast("int")
    return F.when(n >= 1, F.least(n, F.lit(most))).otherwise(F.lit(default))


def encode_cursor(value: str, row_id: str) -> str:
    """(SRT04)"""
    return base64.b64encode(f"{value}|{row_id}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[str, str]:
    value, _, row_id = base64.b64decode(cursor).decode().partition("|")
    return value, row_id


def cursor_of(value: Column, row_id: Column) -> Column:
    """The same as a column (SRT04)."""
    return F.base64(F.concat_ws("|", value, row_id).cast("binary"))


def cursor_parts(cursor: Column) -> Column:
    """``(value, row_id)`` of a cursor; the id is all that follows the first bar."""
    parts = F.split(F.unbase64(cursor).cast("string"), "\\|", 2)
    return F.struct(parts[0].alias("value"), parts[1].alias("row_id"))


def page_with_more(page: DataFrame, sort: str, row_id: str, size: int, descending: bool = True) -> DataFrame:
    """The rows of a page of ``size`` and ``more``: whether the row looked ahead at is there (SRT07)."""
    order = [F.desc(sort), F.desc(row_id)] if descending else [F.asc(sort), F.asc(row_id)]
    whole = Window.partitionBy(F.lit(0))  # at most size + 1 rows
    return page.withColumn("more", F.count("*").over(whole) > size).withColumn("_r", F.row_number().over(whole.orderBy(*order))).where(F.col("_r") <= size).drop("_r")


def keyset_page(rows: DataFrame, sort: str, row_id: str, size: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """One page and the look-ahead row: ``size + 1`` rows past the cursor (SRT01-03, SRT07, SRT18-19, SRT21)."""
    if after is not None:
        v, i = F.lit(after[0]), F.lit(after[1])
        s, k = F.col(sort), F.col(row_id)
        rows = rows.where((s < v) | ((s == v) & (k < i))) if descending else rows.where((s > v) | ((s == v) & (k > i)))
    order = [F.desc(sort), F.desc(row_id)] if descending else [F.asc(sort), F.asc(row_id)]
    return rows.orderBy(*order).limit(size + 1)


def delta_feed(rows: DataFrame, since: str | None, updated: str = "updated_at", deleted: str = "deleted_at") -> DataFrame:
    """Changes since a mark, tombstones included; a snapshot without them if there is no mark (STM01, STM02)."""
    return rows.where(F.col(deleted).isNull()) if since is None else rows.where(F.col(updated) >= F.lit(since))


def tombstone_or_row(rows: DataFrame, key: str, deleted: str = "deleted_at") -> DataFrame:
    """Deleted rows keep nothing but their key and time of deletion (PRJ05)."""
    gone = F.col(deleted).isNotNull()
    return rows.select(key, *(F.when(~gone, F.col(c)).alias(c) for c in rows.columns if c not in (key, deleted)), deleted)


def last_writer_wins(stored: DataFrame, incoming: DataFrame, key: str, updated: str) -> DataFrame:
    """One row per key: the newest, the stored one where the incoming is not strictly newer (SET16, SET17)."""
    both = stored.withColumn("_s", F.lit(1)).unionByName(incoming.withColumn("_s", F.lit(0)))
    w = Window.partitionBy(key).orderBy(F.desc(updated), F.desc("_s"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_s")


def apply_changes(stored: DataFrame, changes: DataFrame, key: str, updated: str, deleted: str = "deleted_at") -> DataFrame:
    """The stored rows after a pull: tombstones remove, others replace; the same pull twice changes nothing (STM03)."""
    return last_writer_wins(stored, changes, key, updated).where(F.col(deleted).isNull())


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Incoming rows whose key is not stored yet, the first of each (SET13, SET14, SET21)."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = incoming.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return stored.unionByName(first.join(stored.select(*keys), keys, "left_anti"))


def upsert_changed(stored: DataFrame, incoming: DataFrame, keys: list[str], value: str, stamp: str) -> DataFrame:
    """Insert or update; a row with the same value keeps its time (SET12, SET15, SET33)."""
    new = incoming.select(*keys, F.col(value).alias("_v"), F.col(stamp).alias("_t"))
    met = stored.join(new, keys, "full_outer")
    changed = F.col(value).isNull() | (F.col("_v").isNotNull() & (F.col("_v") != F.col(value)))
    return met.select(*keys, F.when(changed, F.col("_v")).otherwise(F.col(value)).alias(value), F.when(changed, F.col("_t")).otherwise(F.col(stamp)).alias(stamp))


def catalog_diff(local: DataFrame, live: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, change)`` with added, changed or removed entries (SET02-04, SET26, SET27)."""
    met = local.select(key, F.col(content).alias("_a")).join(live.select(key, F.col(content).alias("_b")), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return met.select(key, change.alias("change")).where("change is not null")


def toggled(members: DataFrame, toggles: DataFrame, keys: list[str]) -> DataFrame:
    """Members after each toggle took its key out or put it in (SET34)."""
    left = members.select(*keys, F.lit(True).alias("_m")).distinct()
    right = toggles.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("_t"))
    met = left.join(right, keys, "full_outer")
    return met.where(F.coalesce("_m", F.lit(False)) != F.coalesce("_t", F.lit(False))).select(*keys)


def hidden_targets(reports: DataFrame, targets: DataFrame, least: int = 3, account_age_ms: int = 86_400_000) -> DataFrame:
    """``(target_id, n)`` of targets hidden by reports of others with old enough accounts, since the last restore (AGG04-06)."""
    met = reports.join(targets, "target_id").where(
        (F.col("reporter_id") != F.col("owner_id")) & (F.col("restored_ms").isNull() | (F.col("created_ms") > F.col("restored_ms"))) & (F.col("created_ms") - F.col("joined_ms") >= account_age_ms)
    )
    return met.groupBy("target_id").agg(F.count_distinct("reporter_id").alias("n")).where(F.col("n") >= least)


def due_for_retry(outbox: DataFrame, now_ms: int) -> DataFrame:
    """Rows whose wait since creation is over (STM06, STM07, MTH11)."""
    from trekframe.functions.hiking import backoff_ms

    waiting = F.when(F.col("attempts") == 0, F.lit(0)).otherwise(backoff_ms(F.col("attempts")))
    return outbox.where((F.col("status") == "pending") & (F.col("created_ms") + waiting <= now_ms))


def gated(rows: DataFrame, done: DataFrame, needs: str) -> DataFrame:
    """Rows whose prerequisite is none or done (STM06)."""
    return rows.where(F.col(needs).isNull()).unionByName(rows.where(F.col(needs).isNotNull()).join(done.select(F.col("id").alias(needs)), needs, "left_semi").select(*rows.columns))


def keyed_union(existing: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """All keys of both with the fetched row's columns where there is one, and ``how``: added, updated or kept (SET01)."""
    values = [c for c in existing.columns if c != key]
    met = existing.select(key, F.struct(*values).alias("_a")).join(fetched.select(key, F.struct(*values).alias("_b")), key, "full_outer")
    how = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "kept").otherwise("updated")
    return met.select(key, *(F.coalesce("_b", "_a")[c].alias(c) for c in values), how.alias("how"))


def unapproved(removed: DataFrame, approved: DataFrame, key: str) -> DataFrame:
    """Removals that nobody approved (SET04), or keys that name nothing any more (SET05): a set difference."""
    return removed.select(key).distinct().join(approved.select(key), key, "left_anti")


def pick_survivor(rows: DataFrame, group: str, preferred: Column, km: Column, key: str) -> DataFrame:
    """``(group, survivor)``: the preferred row of a group, then the first along the trail, then the least id (SET09)."""
    order = F.struct((~F.coalesce(preferred, F.lit(False))).alias("p"), km.isNull().alias("n"), km.alias("km"), F.col(key).alias("k"))
    return rows.groupBy(group).agg(F.min_by(key, order).alias("survivor"))


def coalescing_upsert(stored: DataFrame, incoming: DataFrame, key: str, keep_local: list[str]) -> DataFrame:
    """The server's row wins, but where it has nothing for ``keep_local`` columns the stored value stays (SET15)."""
    values = [c for c in stored.columns if c != key]
    met = stored.select(key, F.struct(*values).alias("_a")).join(incoming.select(key, F.struct(*values).alias("_b")), key, "full_outer")
    pick = lambda c: F.coalesce(F.col("_b")[c], F.col("_a")[c]) if c in keep_local else F.when(F.col("_b").isNotNull(), F.col("_b")[c]).otherwise(F.col("_a")[c])
    return met.select(key, *(pick(c).alias(c) for c in values))


def guarded_upsert(stored: DataFrame, incoming: DataFrame, key: str, guard: Column, keep_local: list[str] = ()) -> DataFrame:
    """As ``coalescing_upsert``, but stored rows for which ``guard`` does not hold are left alone (SET33)."""
    closed = stored.where(~F.coalesce(guard, F.lit(False)))
    free = stored.where(F.coalesce(guard, F.lit(False)))
    return coalescing_upsert(free, incoming.join(closed.select(key), key, "left_anti"), key, list(keep_local)).unionByName(closed)


def superseded(objects: DataFrame, manifests: DataFrame, grace_ms: int, now_ms: int) -> DataFrame:
    """``(prefix, name)`` of objects that their prefix's manifest does not name, where both are older than the grace period;
    prefixes without a readable manifest are left alone (SET25).

    ``objects`` are ``(prefix, name, ms)``, ``manifests`` ``(prefix, ms, names)`` with null names if unreadable.
    """
    known = manifests.where("names is not null").select("prefix", F.col("ms").alias("_m"), "names")
    met = objects.join(known, "prefix").where(~F.array_contains("names", F.col("name")))
    return met.where((F.col("ms") < now_ms - grace_ms) & (F.col("_m") < now_ms - grace_ms)).select("prefix", "name")


def device_sync(catalog: DataFrame, bundled: DataFrame, installed: DataFrame) -> DataFrame:
    """``(id, action)``: installed copies that no longer supersede the bundle are removed, entries newer than the current
    copy downloaded; what is only in the catalog is left (SET26). All are ``(id, version)``."""
    b, i = bundled.select("id", F.col("version").alias("b")), installed.select("id", F.col("version").alias("i"))
    met = catalog.select("id", F.col("version").alias("c")).join(b, "id", "full_outer").join(i, "id", "full_outer")
    stale = F.col("i").isNotNull() & F.col("b").isNotNull() & (F.col("i") <= F.col("b"))
    current = F.when(stale, F.col("b")).otherwise(F.coalesce("i", "b"))
    action = F.when(current.isNotNull() & (F.col("c") > current), "download").when(stale, "remove")
    return met.select("id", action.alias("action")).where("action is not null")


def description_sync(authored: DataFrame, live: DataFrame) -> DataFrame:
    """``(id, action)``: put what is new or changed, withdraw what is live and not authored, and what is the same (SET27)."""
    met = authored.select("id", F.col("text").alias("a")).join(live.select("id", F.col("text").alias("b")), "id", "full_outer")
    action = F.when(F.col("a").isNotNull() & ~F.col("a").eqNullSafe(F.col("b")), "put").when(F.col("a").isNull() & (F.coalesce("b", F.lit("")) != ""), "withdraw").when(F.col("a").isNotNull(), "same")
    return met.select("id", action.alias("action")).where("action is not null")


def replace_in_range(stops: DataFrame, ranges: DataFrame, new: DataFrame, eps: float = 0.01) -> DataFrame:
    """Stops strictly inside each plan's range replaced by new ones; one already planned keeps its details, and one that
    would stand where another stays is skipped (SET28). Rows are ``(plan, km, note)``, ranges ``(plan, lo, hi)``."""
    met = stops.join(ranges, "plan", "left")
    inside = (F.col("km") > F.col("lo") + eps) & (F.col("km") < F.col("hi") - eps)
    outer = met.where(~F.coalesce(inside, F.lit(False))).select("plan", "km", "note")
    fresh = new.join(ranges, "plan").where((F.col("km") > F.col("lo") + eps) & (F.col("km") < F.col("hi") - eps)).select("plan", "km", F.col("note").alias("_n")).dropDuplicates(["plan", "km"])
    kept = fresh.join(stops.select("plan", "km", "note"), ["plan", "km"], "left").select("plan", "km", F.coalesce("note", "_n").alias("note"))
    return outer.unionByName(kept.join(outer.select("plan", "km"), ["plan", "km"], "left_anti"))


def list_merge(listed: DataFrame, installed: DataFrame, key: str = "id") -> DataFrame:
    """``(id, have, part)``: listed entries with whether they are installed, then those only installed (SET29)."""
    own = installed.select(key).distinct()
    first = listed.select(key).join(own.withColumn("_h", F.lit(True)), key, "left").select(key, F.coalesce("_h", F.lit(False)).alias("have"), F.lit(0).alias("part"))
    return first.unionByName(own.join(listed.select(key), key, "left_anti").select(key, F.lit(True).alias("have"), F.lit(1).alias("part")))


def set_selection(plans: DataFrame, choices: DataFrame) -> DataFrame:
    """Plans ``(plan, selected, zero_days)`` after a choice ``(plan, ids)`` (SET35): a null choice clears the selection and
    keeps the zero days, a list drops those of options no longer chosen; ``changed`` tells whether anything did."""
    met = plans.join(choices.select("plan", "ids", F.lit(True).alias("_set")), "plan", "left")
    days = F.when(F.col("_set") & F.col("ids").isNotNull(), F.map_filter("zero_days", lambda k, v: F.array_contains("ids", k))).otherwise(F.col("zero_days"))
    chosen = F.when(F.coalesce("_set", F.lit(False)), F.col("ids")).otherwise(F.col("selected"))
    moved = ~chosen.eqNullSafe(F.col("selected")) | (F.size(days) != F.size("zero_days"))
    return met.select("plan", chosen.alias("selected"), days.alias("zero_days"), moved.alias("changed"))


def compact_queue(queue: DataFrame, kind: str, key: str) -> DataFrame:
    """A queue without the waiting rows of one kind and key (STM08); those being sent stay."""
    return queue.where(~((F.col("kind") == kind) & (F.col("key") == key) & (F.col("status") != "sending")))


def prune_stale(rows: DataFrame, now_ms: int, ttl_ms: int, at: str = "ms") -> DataFrame:
    """Rows whose time to live is not over (STM05)."""
    return rows.where(F.col(at) > now_ms - ttl_ms)
