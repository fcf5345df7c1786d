"""Queries on copies that are kept in step: merges, plans of what to do, pages and queues. Orders stand for the rows."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from trekframe.operators import sync
from trekframe.plans.registry import register
from trekframe.plans.relational import _STORED, _two
from trekframe.plans.tables import table


@register("set01_merged_places", f"WITH {_STORED} SELECT id, CASE WHEN b.id IS NULL THEN a.v ELSE b.v END AS v, CASE WHEN b.id IS NULL THEN a.t ELSE b.t END AS t, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'kept' ELSE 'updated' END AS how FROM a FULL JOIN b USING (id)")
def set01(spark, sf_dir):
    return sync.keyed_union(*_two(spark, sf_dir), "id")


@register("set04_removals_to_approve", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 12)")
def set04(spark, sf_dir):
    approved = table(spark, sf_dir, "customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"))
    return sync.unapproved(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), approved, "o_custkey")


@register("set05_stale_keys", "SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey WHERE c_acctbal < 1000 AND o_custkey IS NULL")
def set05(spark, sf_dir):
    return sync.unapproved(table(spark, sf_dir, "customer").where("c_acctbal < 1000"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@register(
    "set09_survivors",
    "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey AS survivor FROM r WHERE r = 1",
)
def set09(spark, sf_dir):
    km = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice"))
    return sync.pick_survivor(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderpriority").startswith("1"), km, "o_orderkey")


@register("set14_reports_once", "SELECT l_orderkey, l_suppkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem WHERE l_returnflag <> 'A') x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_returnflag = 'A' AND y.l_orderkey = x.l_orderkey AND y.l_suppkey = x.l_suppkey)")
def set14(spark, sf_dir):
    """New reports whose pair of keys is not stored yet, the first of each."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", F.struct("l_linenumber", "l_partkey").alias("o"), "l_returnflag")
    stored = rows.where("l_returnflag = 'A'")
    return sync.insert_ignore(stored, rows.where("l_returnflag <> 'A'"), ["l_orderkey", "l_suppkey"], "o").where("l_returnflag <> 'A'").select("l_orderkey", "l_suppkey", "l_partkey")


@register("set15_coalesced", f"WITH {_STORED} SELECT id, CASE WHEN b.id IS NOT NULL AND b.id % 2 = 0 THEN b.v ELSE a.v END AS v, CASE WHEN b.id IS NULL THEN a.t ELSE b.t END AS t FROM a FULL JOIN b USING (id)")
def set15(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return sync.coalescing_upsert(a, b.withColumn("v", F.when(F.col("id") % 2 == 0, F.col("v"))), "id", ["v"])


@register("set17_tombstones", f"WITH {_STORED} SELECT id, CASE WHEN b.id IS NULL OR (a.id IS NOT NULL AND a.t >= b.t) THEN a.v END AS v, CASE WHEN b.id IS NULL OR (a.id IS NOT NULL AND a.t >= b.t) THEN false ELSE true END AS deleted FROM a FULL JOIN b USING (id)")
def set17(spark, sf_dir):
    """Deletions that come from elsewhere: a stored row stays unless the deletion is strictly newer."""
    a, b = _two(spark, sf_dir)
    gone = b.select("id", F.lit(None).cast("string").alias("v"), "t", F.lit(True).alias("deleted"))
    return sync.last_writer_wins(a.withColumn("deleted", F.lit(False)), gone, "id", "t").select("id", "v", "deleted")


@register("set21_backfill", "SELECT o_orderkey AS id, o_orderstatus AS v FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderkey % 2 = 1 AND o_totalprice > 1000")
def set21(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stored = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    return sync.insert_ignore(stored, o.where("o_totalprice > 1000").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("v")), ["id"], "id")


@register(
    "set25_superseded",
    "SELECT p_size AS prefix, p_partkey AS name FROM part WHERE p_size % 5 > 0 AND p_partkey % 3 > 0 AND p_partkey * 1000 < 1500000 AND p_size * 40000 < 1500000",
)
def set25(spark, sf_dir):
    """Parts as objects under their size: every third is named by its prefix's manifest, every fifth manifest is unreadable."""
    p = table(spark, sf_dir, "part")
    objects = p.select(F.col("p_size").alias("prefix"), F.col("p_partkey").alias("name"), (F.col("p_partkey") * 1000).alias("ms"))
    names = F.collect_list(F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey")))
    manifests = p.groupBy(F.col("p_size").alias("prefix")).agg(names.alias("names")).select("prefix", (F.col("prefix") * 40_000).alias("ms"), F.when(F.col("prefix") % 5 > 0, F.col("names")).alias("names"))
    return sync.superseded(objects, manifests, 500_000, 2_000_000)


@register(
    "set26_device_plan",
    """WITH c AS (SELECT o_orderkey AS id, o_orderkey % 7 AS c FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS id, o_orderkey % 4 AS b FROM orders WHERE o_orderkey % 3 = 0), i AS (SELECT o_orderkey AS id, o_orderkey % 6 AS i FROM orders WHERE o_orderkey % 2 = 0),
m AS (SELECT id, c, b, i, i IS NOT NULL AND b IS NOT NULL AND i <= b AS stale FROM c FULL JOIN b USING (id) FULL JOIN i USING (id)),
a AS (SELECT id, CASE WHEN c > CASE WHEN stale THEN b ELSE coalesce(i, b) END THEN 'download' WHEN stale THEN 'remove' END AS action FROM m) SELECT * FROM a WHERE action IS NOT NULL""",
)
def set26(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    side = lambda cond, n: o.where(cond).select(k.alias("id"), (k % n).alias("version"))
    return sync.device_sync(side(k % 5 > 0, 7), side(k % 3 == 0, 4), side(k % 2 == 0, 6))


@register("set27_description_plan", f"WITH {_STORED}, b2 AS (SELECT id, CASE WHEN id % 4 = 0 THEN '' WHEN id % 5 = 0 THEN (SELECT v FROM a WHERE a.id = b.id) ELSE v END AS v FROM b), d AS (SELECT id, CASE WHEN a.v IS NOT NULL AND a.v IS DISTINCT FROM b2.v THEN 'put' WHEN a.v IS NULL AND coalesce(b2.v, '') <> '' THEN 'withdraw' WHEN a.v IS NOT NULL THEN 'same' END AS action FROM a FULL JOIN b2 USING (id)) SELECT * FROM d WHERE action IS NOT NULL")
def set27(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    same = b.join(a.select("id", F.col("v").alias("w")), "id", "left")
    live = same.select("id", F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 5 == 0, F.col("w")).otherwise(F.col("v")).alias("text"))
    return sync.description_sync(a.withColumnRenamed("v", "text"), live)


@register(
    "set28_replaced_stops",
    """WITH s AS (SELECT l_orderkey AS plan, CAST(l_linenumber AS DOUBLE) AS km, l_returnflag AS note FROM lineitem), u AS (SELECT plan, km, min(note) AS note FROM s GROUP BY plan, km), r AS (SELECT DISTINCT plan, 1.0 AS lo, CASE WHEN plan % 2 = 0 THEN 5.0 ELSE 3.0 END AS hi FROM s WHERE plan % 3 > 0),
n AS (SELECT plan, unnest([2.0, 3.0, 4.0, 4.5]) AS km FROM (SELECT DISTINCT plan FROM s) x)
SELECT u.plan, u.km, u.note FROM u LEFT JOIN r USING (plan) WHERE NOT coalesce(km > lo + 0.01 AND km < hi - 0.01, false) UNION ALL
SELECT n.plan, n.km, coalesce(u.note, 'new') FROM n JOIN r USING (plan) LEFT JOIN u ON u.plan = n.plan AND u.km = n.km WHERE n.km > lo + 0.01 AND n.km < hi - 0.01""",
)
def set28(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    stops = li.groupBy(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("double").alias("km")).agg(F.min("l_returnflag").alias("note"))
    plans = stops.select("plan").distinct()
    ranges = plans.where("plan % 3 > 0").select("plan", F.lit(1.0).alias("lo"), F.when(F.col("plan") % 2 == 0, 5.0).otherwise(3.0).alias("hi"))
    new = plans.select("plan", F.explode(F.array(*map(F.lit, (2.0, 3.0, 4.0, 4.5)))).alias("km")).withColumn("note", F.lit("new"))
    return sync.replace_in_range(stops, ranges, new)


@register("set29_merged_lists", f"WITH {_STORED} SELECT a.id, EXISTS (SELECT 1 FROM b WHERE b.id = a.id) AS have, 0 AS part FROM a UNION ALL SELECT DISTINCT id, true, 1 FROM b WHERE id NOT IN (SELECT id FROM a)")
def set29(spark, sf_dir):
    return sync.list_merge(*_two(spark, sf_dir))


@register("set33_guarded_upsert", f"WITH {_STORED} SELECT id, CASE WHEN b.id IS NULL OR a.t < 3 THEN a.v ELSE coalesce(b.v, a.v) END AS v, CASE WHEN b.id IS NULL OR a.t < 3 THEN a.t ELSE b.t END AS t FROM a FULL JOIN b USING (id)")
def set33(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return sync.guarded_upsert(a, b, "id", F.col("t") >= 3, ["v"])


@register(
    "set35_selections",
    """WITH o AS (SELECT o_custkey AS plan, list_sort(list('w' || o_orderkey)) AS ids FROM orders GROUP BY o_custkey), c AS (SELECT plan, ids, list_filter(ids, lambda x: right(x, 1) IN ('0', '2', '4', '6', '8')) AS even FROM o)
SELECT plan, CASE WHEN plan % 4 = 1 THEN NULL WHEN plan % 4 > 1 THEN array_to_string(even, ',') ELSE array_to_string(ids, ',') END AS selected, CAST(CASE WHEN plan % 4 > 1 THEN len(even) ELSE len(ids) END AS INT) AS n_days,
  CASE WHEN plan % 4 = 0 THEN false WHEN plan % 4 = 1 THEN true ELSE len(even) <> len(ids) END AS changed FROM c""",
)
def set35(spark, sf_dir):
    """Plans by customer; a quarter of them keep their choice, a quarter clear it, the others choose the even orders."""
    key = F.concat(F.lit("w"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("plan")).agg(F.array_sort(F.collect_list(key)).alias("selected"))
    plans = rows.withColumn("zero_days", F.map_from_arrays("selected", F.transform("selected", lambda x: F.lit(1))))
    even = F.filter("selected", lambda x: x.rlike("[02468]$"))
    choices = rows.where("plan % 4 > 0").select("plan", F.when(F.col("plan") % 4 > 1, even).alias("ids"))
    return sync.set_selection(plans, choices).select("plan", F.array_join("selected", ",").alias("selected"), F.size("zero_days").alias("n_days"), "changed")


@register("stm08_compacted", "SELECT event_id FROM events WHERE NOT (event_type = 'click' AND user_id % 10 = 3 AND event_id % 4 > 0)")
def stm08(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    queue = e.select("event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 10).cast("string").alias("key"), F.when(F.col("event_id") % 4 == 0, "sending").otherwise("waiting").alias("status"))
    return sync.compact_queue(queue, "click", "3").select("event_id")


_PAGE = "SELECT o_orderkey FROM orders WHERE {} ORDER BY {} LIMIT {}"
_MARK = datetime.datetime(1996, 3, 1)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@register("srt03_own_page", _PAGE.format("o_custkey = 7 AND (o_orderdate, o_orderkey) > (TIMESTAMP '1993-01-01', 100)", "o_orderdate, o_orderkey", 11))
def srt03(spark, sf_dir):
    own = _orders(spark, sf_dir).where("o_custkey = 7")
    return sync.keyset_page(own, "o_orderdate", "o_orderkey", 10, (datetime.datetime(1993, 1, 1), 100), descending=False).select("o_orderkey")


@register("srt04_cursors", "SELECT o_orderkey, to_base64(encode(strftime(o_orderdate, '%Y-%m-%d') || '|' || o_orderkey || '|x')) AS cursor, strftime(o_orderdate, '%Y-%m-%d') AS value, o_orderkey || '|x' AS row_id FROM orders")
def srt04(spark, sf_dir):
    """Cursors made and read again; the id is all that follows the first bar."""
    cursor = sync.cursor_of(F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat("o_orderkey", F.lit("|x")))
    read = sync.cursor_parts(F.col("cursor"))
    return _orders(spark, sf_dir).select("o_orderkey", cursor.alias("cursor")).select("o_orderkey", "cursor", read["value"].alias("value"), read["row_id"].alias("row_id"))


@register("srt07_page_with_more", "SELECT *, true AS more FROM (" + _PAGE.format("o_orderstatus = 'O'", "o_totalprice DESC, o_orderkey DESC", 15) + ") x")
def srt07(spark, sf_dir):
    """A page of 15 with whether more follow, told by the row looked ahead at."""
    return sync.page_with_more(sync.keyset_page(_orders(spark, sf_dir).where("o_orderstatus = 'O'"), "o_totalprice", "o_orderkey", 15), "o_totalprice", "o_orderkey", 15).select("o_orderkey", "more")


@register("srt10_sorted_places", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value, 'node/' || event_id) AS INT) AS place FROM events")
def srt10(spark, sf_dir):
    from pyspark.sql import Window

    from trekframe.functions.text import poi_key

    w = Window.partitionBy("user_id").orderBy("value", poi_key(F.lit("node"), F.col("event_id")))
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).alias("place"))


@register("srt18_plan_deltas", _PAGE.format("o_custkey % 10 = 1 AND (o_orderdate, o_orderkey) > (TIMESTAMP '1996-03-01', 0)", "o_orderdate, o_orderkey", 31))
def srt18(spark, sf_dir):
    return sync.keyset_page(_orders(spark, sf_dir).where("o_custkey % 10 = 1"), "o_orderdate", "o_orderkey", 30, (_MARK, 0), descending=False).select("o_orderkey")


@register("srt19_shared_deltas", _PAGE.format("o_orderstatus = 'P' AND (o_orderdate, o_orderkey) > (TIMESTAMP '1996-03-01', 0)", "o_orderdate, o_orderkey", 51))
def srt19(spark, sf_dir):
    return sync.keyset_page(_orders(spark, sf_dir).where("o_orderstatus = 'P'"), "o_orderdate", "o_orderkey", 50, (_MARK, 0), descending=False).select("o_orderkey")


@register(
    "srt21_public_list",
    "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_nationkey = 3 AND c_mktsegment = 'BUILDING' AND (o_orderdate, o_orderkey) < (TIMESTAMP '1998-01-01', 9) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21",
)
def srt21(spark, sf_dir):
    rows = _orders(spark, sf_dir).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.where("o_orderstatus = 'O' and c_nationkey = 3 and c_mktsegment = 'BUILDING'")
    return sync.keyset_page(rows, "o_orderdate", "o_orderkey", 20, (datetime.datetime(1998, 1, 1), 9)).select("o_orderkey")


def _hidden(rows: str, least: int) -> str:
    return f"SELECT target_id, count(DISTINCT reporter_id) AS n FROM ({rows}) r WHERE reporter_id <> owner_id AND (restored_ms IS NULL OR created_ms > restored_ms) AND created_ms - joined_ms >= 86400000 GROUP BY target_id HAVING count(DISTINCT reporter_id) >= {least}"


@register("agg05_hidden_routes", _hidden("SELECT o_custkey AS target_id, o_orderkey % 40 AS reporter_id, o_custkey % 40 AS owner_id, epoch_ms(o_orderdate) AS created_ms, o_orderkey % 17 * 50000000000 AS joined_ms, CASE WHEN o_custkey % 3 = 0 THEN 800000000000 END AS restored_ms FROM orders", 3))
def agg05(spark, sf_dir):
    o, k = _orders(spark, sf_dir), F.col("o_orderkey")
    reports = o.select(F.col("o_custkey").alias("target_id"), (k % 40).alias("reporter_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_ms"), (k % 17 * 50_000_000_000).alias("joined_ms"))
    targets = o.select(F.col("o_custkey").alias("target_id")).distinct().select("target_id", (F.col("target_id") % 40).alias("owner_id"), F.when(F.col("target_id") % 3 == 0, F.lit(800_000_000_000)).alias("restored_ms"))
    return sync.hidden_targets(reports, targets)


@register("agg06_hidden_waypoints", _hidden("SELECT l_partkey AS target_id, l_suppkey AS reporter_id, l_partkey % 9 AS owner_id, epoch_ms(l_shipdate) AS created_ms, 0 AS joined_ms, CASE WHEN l_partkey % 2 = 0 THEN 850000000000 END AS restored_ms FROM lineitem", 4))
def agg06(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    reports = li.select(F.col("l_partkey").alias("target_id"), F.col("l_suppkey").alias("reporter_id"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("created_ms"), F.lit(0).cast("long").alias("joined_ms"))
    targets = reports.select("target_id").distinct().select("target_id", (F.col("target_id") % 9).alias("owner_id"), F.when(F.col("target_id") % 2 == 0, F.lit(850_000_000_000)).alias("restored_ms"))
    return sync.hidden_targets(reports, targets, least=4)
