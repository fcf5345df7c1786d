"""Relational reports: joins, counts, JSON, pages and moderation, over orders (reports), customers (users) and events (comments)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trekframe.operators import sync
from trekframe.plans.registry import register
from trekframe.plans.tables import table


def sql(name: str, text: str, twin: str | None = None) -> None:
    """A query in Spark SQL over the tables it names in braces; the twin is the same text unless given."""

    tables = [t for t in ("customer", "orders", "nation", "region", "events", "lineitem", "part", "supplier", "documents", "pages") if "{" + t + "}" in text]

    @register(name, (twin or text).replace("{", "").replace("}", "") if twin is None else twin)
    def run(spark, sf_dir, text=text, tables=tables):
        return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


sql("jon01_comment_user", "SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = 'F'")
sql("jon02_shared_plan_user", "SELECT o.o_orderkey, c.c_name FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey WHERE o.o_orderkey % 10 = 3 AND o.o_orderstatus <> 'P'")
sql("jon03_token_user", "SELECT c.c_custkey, n.n_name FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey WHERE c.c_name = 'Customer#000000042'")
sql("jon04_waypoint_user", "SELECT s.s_suppkey, n.n_name FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey")
sql("jon05_report_left_comment", "SELECT o.o_orderkey, c.c_name FROM {orders} o LEFT JOIN {customer} c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0")
sql("jon06_left_join_residual", "SELECT e.event_id, o.o_orderkey FROM {events} e LEFT JOIN {orders} o ON o.o_orderkey = e.event_id AND o.o_orderstatus = 'O'")
sql("jon07_semi_join", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 400000)")
sql("jon08_anti_join", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
sql("jon09_in_list_from_json", "SELECT n_nationkey, n_name FROM {nation} WHERE n_nationkey IN (SELECT explode(from_json('[1, 5, 9, 24]', 'array<int>')))", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT unnest(CAST('[1, 5, 9, 24]' AS INT[])))")
sql("jon10_scoped_delete", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_custkey % 4 = 1)")
sql(
    "jon11_top_one_by_priority",
    "SELECT c.c_custkey, t.o_orderstatus FROM {customer} c LEFT JOIN LATERAL (SELECT o_orderstatus FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey LIMIT 1) t ON true",
    "SELECT c_custkey, arg_min(o_orderstatus, {'p': CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, 'k': o_orderkey}) AS o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
)
sql("agg02_correlated_count", "SELECT c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS n FROM {customer} c", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
sql(
    "agg03_nested_json",
    "SELECT o_custkey, to_json(array_sort(collect_list(named_struct('k', o_orderkey, 's', o_orderstatus)))) AS reports FROM {orders} GROUP BY o_custkey",
    "SELECT o_custkey, '[' || string_agg('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS reports FROM orders GROUP BY o_custkey",
)
sql("agg07_sum_of_lengths", "SELECT user_id, coalesce(sum(json_array_length(concat('[', repeat('1,', CAST(event_id % 3 AS INT)), '0]'))), 0) AS n FROM {events} GROUP BY user_id", "SELECT user_id, CAST(coalesce(sum(json_array_length('[' || repeat('1,', CAST(event_id % 3 AS INT)) || '0]')), 0) AS BIGINT) AS n FROM events GROUP BY user_id")
sql("agg08_filtered_count", "SELECT count(*) AS n FROM {orders} WHERE o_orderstatus = 'P' AND o_totalprice < 100000")
sql("agg09_count_min_max", "SELECT count(*) AS n, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM {lineitem}")
sql("agg10_distinct", "SELECT DISTINCT o_custkey FROM {orders}")
sql("agg34_count_per_waypoint", "SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type")
sql("agg35_outbox_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS pending, count(*) FILTER (WHERE value > 50) > 0 AS has_pending FROM {events} GROUP BY event_type")
sql("agg36_focus_window", "SELECT user_id, min(value) AS lo, max(value) AS hi FROM {events} WHERE NOT isnan(value) AND value IS NOT NULL GROUP BY user_id")
sql(
    "agg13_count_by_category",
    "SELECT k.kind, count(e.event_id) AS n FROM (SELECT explode(array('view', 'click', 'purchase', 'hut')) AS kind) k LEFT JOIN {events} e ON e.event_type = k.kind AND e.value < 50 GROUP BY k.kind",
    "SELECT k.kind, count(e.event_id) AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'hut']) AS kind) k LEFT JOIN events e ON e.event_type = k.kind AND e.value < 50 GROUP BY k.kind",
)
sql(
    "agg14_count_by_reason",
    "SELECT k.reason, count(e.r) AS n FROM (SELECT explode(array('big', 'error', 'small', 'none')) AS reason) k LEFT JOIN (SELECT CASE WHEN value > 90 THEN 'big' WHEN event_type = 'error' THEN 'error' WHEN value < 5 THEN 'small' END AS r FROM {events}) e ON e.r = k.reason GROUP BY k.reason",
    "SELECT k.reason, count(e.r) AS n FROM (SELECT unnest(['big', 'error', 'small', 'none']) AS reason) k LEFT JOIN (SELECT CASE WHEN value > 90 THEN 'big' WHEN event_type = 'error' THEN 'error' WHEN value < 5 THEN 'small' END AS r FROM events) e ON e.r = k.reason GROUP BY k.reason",
)
sql("agg15_two_level_groups", "SELECT r_name, n_name, count(*) AS n, sum(count(*)) OVER (PARTITION BY r_name) AS in_region, row_number() OVER (ORDER BY CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END, r_name, n_name) AS place FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey GROUP BY r_name, n_name", "SELECT r_name, n_name, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY r_name) AS BIGINT) AS in_region, CAST(row_number() OVER (ORDER BY CASE WHEN r_name = 'ASIA' THEN 1 ELSE 0 END, r_name, n_name) AS INT) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_name")
sql("agg21_leg_summary", "SELECT user_id, count(DISTINCT event_type) AS stops, max(value) AS longest, round(sum(value), 4) AS food FROM {events} GROUP BY user_id")
sql(
    "agg28_check_suite",
    "WITH a AS (SELECT user_id, count(*) AS n, sum(value) AS km, max(value) AS top FROM {events} GROUP BY user_id) SELECT user_id, stack(3, 'points', CASE WHEN n < 2 THEN 'fail' ELSE 'pass' END, 'length', CASE WHEN km < 100 THEN 'warn' ELSE 'pass' END, 'elevation', CASE WHEN top > 99 THEN 'fail' ELSE 'pass' END) AS (rule, level) FROM a",
    "WITH a AS (SELECT user_id, count(*) AS n, sum(value) AS km, max(value) AS top FROM events GROUP BY user_id) SELECT user_id, 'points' AS rule, CASE WHEN n < 2 THEN 'fail' ELSE 'pass' END AS level FROM a UNION ALL SELECT user_id, 'length', CASE WHEN km < 100 THEN 'warn' ELSE 'pass' END FROM a UNION ALL SELECT user_id, 'elevation', CASE WHEN top > 99 THEN 'fail' ELSE 'pass' END FROM a",
)
sql("win06_last_per_group", "SELECT o_custkey, o_orderkey, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}) t WHERE r <= 3")
sql("srt05_flag_first_order", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY first, o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus IS NOT DISTINCT FROM 'P' THEN 0 ELSE 1 END AS first FROM {orders} ORDER BY first, o_totalprice DESC, o_orderkey LIMIT 50) x")
sql("srt06_case_ranked_by_json", "SELECT event_id FROM {events} ORDER BY CASE WHEN CAST(get_json_object(props, '$.k') AS INT) > 90 THEN 0 WHEN event_type = 'error' THEN 1 ELSE 2 END, event_id LIMIT 40", "SELECT event_id FROM events ORDER BY CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 90 THEN 0 WHEN event_type = 'error' THEN 1 ELSE 2 END, event_id LIMIT 40")
sql("srt08_due_queue", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'O' AND o_totalprice > 1000 ORDER BY o_orderdate, o_orderkey LIMIT 25")
sql("srt14_next_per_type", "SELECT user_id, event_type, min(event_id) AS event_id FROM {events} WHERE event_id > 100 GROUP BY user_id, event_type")
sql("srt16_pinned_first", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY CASE WHEN n_nationkey = 7 THEN 0 ELSE 1 END, n_nationkey) AS INT) AS place FROM {nation}")
sql("srt20_by_report_count", "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY n DESC, c_custkey DESC LIMIT 20")
sql("srt22_latest_failure", "SELECT user_id, max_by(value, event_id) AS last_error FROM {events} WHERE event_type = 'error' GROUP BY user_id", "SELECT user_id, arg_max(value, event_id) AS last_error FROM events WHERE event_type = 'error' GROUP BY user_id")
sql("srt23_stale_reviews", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 10")
sql("srt24_plan_stop_sort", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_returnflag, l_linenumber, l_partkey, l_suppkey) AS INT) AS place FROM {lineitem}")
sql("set18_guarded_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' THEN 'F' ELSE o_orderstatus END AS status FROM {orders}")
sql("set19_anonymise", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS deleted FROM {customer}")
sql("set20_ban_cascade", "SELECT o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'hidden' ELSE o_orderstatus END AS status FROM {orders} LEFT JOIN (SELECT c_custkey FROM {customer} WHERE c_acctbal < -500) c ON c.c_custkey = o_custkey")
sql("set22_day_truncation", "SELECT o_orderkey, concat(substr(CAST(o_orderdate AS STRING), 1, instr(concat(CAST(o_orderdate AS STRING), ' '), ' ') - 1), 'T00:00:00Z') AS observed FROM {orders}", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS observed FROM orders")
sql("set23_scoped_delete", "SELECT event_id FROM {events} WHERE user_id <> 3")
sql("set24_one_live_plan", "SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1")
sql("set30_iso_timestamps", "SELECT event_id, CASE WHEN t RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2} ' THEN concat(replace(t, ' ', 'T'), 'Z') ELSE t END AS iso FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '2024-01-02 03:04:05' ELSE '2024-01-02T03:04:05Z' END AS t FROM {events}) x".replace("{4}", "{{4}}").replace("{2}", "{{2}}"), "SELECT event_id, '2024-01-02T03:04:05Z' AS iso FROM events")
sql("set31_purge_synced", "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'BUILDING')")
sql("set32_rekey", "SELECT o_orderkey, coalesce(m.new_id, o_custkey) AS o_custkey FROM {orders} LEFT JOIN (SELECT c_custkey, c_custkey + 1000000 AS new_id FROM {customer} WHERE c_nationkey = 5) m ON m.c_custkey = o_custkey")
sql("flt13_half_open_count", "SELECT user_id, count(*) FILTER (WHERE value > 10 AND value <= 30 AND event_type = 'view') AS n FROM {events} GROUP BY user_id")
sql("flt18_contour_tiers", "SELECT event_id, CASE WHEN CAST(floor(value * 10) AS INT) % 100 = 0 THEN 100 WHEN CAST(floor(value * 10) AS INT) % 50 = 0 THEN 50 WHEN CAST(floor(value * 10) AS INT) % 20 = 0 THEN 20 ELSE 10 END AS tier, CASE WHEN CAST(floor(value * 10) AS INT) % 50 = 0 THEN 1 ELSE 0 END AS is_index FROM {events}")
sql("dat03_millis_between", "SELECT o_orderkey, CAST(datediff(o_orderdate, DATE '1992-01-01') AS BIGINT) * 86400000 AS ms FROM {orders}", "SELECT o_orderkey, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000 AS ms FROM orders")
sql("dat09_event_time", "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id * 10 END, event_id) AS at FROM {events}")
sql("jsn01_json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
sql("jsn03_json_each", "SELECT event_id, v FROM {events} LATERAL VIEW explode(from_json(concat('[', event_id, ',', user_id, ']'), 'array<bigint>')) t AS v", "SELECT event_id, unnest([event_id, user_id]) AS v FROM events")

_O = "SELECT o_orderkey, o_orderdate FROM orders"


@register("srt01_keyset_desc", f"{_O} WHERE (o_orderdate < TIMESTAMP '1997-01-01' OR (o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey < 500)) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 21")
def srt01(spark, sf_dir):
    import datetime

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sync.keyset_page(rows, "o_orderdate", "o_orderkey", 20, (datetime.datetime(1997, 1, 1), 500))


@register("srt02_keyset_asc", f"{_O} WHERE (o_orderdate > TIMESTAMP '1997-01-01' OR (o_orderdate = TIMESTAMP '1997-01-01' AND o_orderkey > 500)) ORDER BY o_orderdate, o_orderkey LIMIT 21")
def srt02(spark, sf_dir):
    import datetime

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return sync.keyset_page(rows, "o_orderdate", "o_orderkey", 20, (datetime.datetime(1997, 1, 1), 500), descending=False)


@register("prj05_tombstones", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'gone' END AS deleted_at FROM orders")
def prj05(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "P", "gone").alias("deleted_at"))
    return sync.tombstone_or_row(rows, "o_orderkey")


@register("stm01_delta_feed", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1998-01-01'")
def stm01(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.lit(None).cast("string").alias("deleted_at"))
    return sync.delta_feed(rows, "1998-01-01").select("o_orderkey")


_STORED = "a AS (SELECT o_orderkey AS id, o_orderstatus AS v, o_orderkey % 7 AS t FROM orders WHERE o_orderkey % 3 < 2), b AS (SELECT o_orderkey AS id, o_orderpriority AS v, o_orderkey % 5 AS t FROM orders WHERE o_orderkey % 3 > 0)"


def _two(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.where(k % 3 < 2).select(k.alias("id"), F.col("o_orderstatus").alias("v"), (k % 7).alias("t")), o.where(k % 3 > 0).select(k.alias("id"), F.col("o_orderpriority").alias("v"), (k % 5).alias("t"))


@register("set16_last_writer_wins", f"WITH {_STORED}, u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 0 FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, s DESC) AS r FROM u) SELECT id, v, t FROM r WHERE r = 1")
def set16(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return sync.last_writer_wins(a, b, "id", "t")


@register("stm03_apply_changes", f"WITH {_STORED}, u AS (SELECT *, 1 AS s FROM a UNION ALL SELECT *, 0 FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, s DESC) AS r FROM u) SELECT id, v, t FROM r WHERE r = 1 AND NOT (s = 0 AND id % 4 = 0)")
def stm03(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    none = F.lit(None).cast("string")
    return sync.apply_changes(a.withColumn("deleted_at", none), b.withColumn("deleted_at", F.when(F.col("id") % 4 == 0, "gone")), "id", "t").drop("deleted_at")


@register("set13_insert_ignore", f"WITH {_STORED} SELECT id, v FROM a UNION ALL SELECT id, v FROM b WHERE id NOT IN (SELECT id FROM a)")
def set13(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return sync.insert_ignore(a, b, ["id"], "t").select("id", "v")


@register("set12_upsert_changed", f"WITH {_STORED} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.v IS NULL OR (b.v IS NOT NULL AND b.v <> a.v) THEN b.v ELSE a.v END AS v, CASE WHEN a.v IS NULL OR (b.v IS NOT NULL AND b.v <> a.v) THEN b.t ELSE a.t END AS t FROM a FULL JOIN b ON a.id = b.id")
def set12(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return sync.upsert_changed(a, b, ["id"], "v", "t")


@register("set02_catalog_diff", f"WITH {_STORED}, d AS (SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.t <> b.t THEN 'changed' END AS change FROM a FULL JOIN b ON a.id = b.id) SELECT * FROM d WHERE change IS NOT NULL")
def set02(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return sync.catalog_diff(a, b, "id", "t")


@register("set03_upload_plan", f"WITH {_STORED} SELECT id, t FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = a.id AND b.t = a.t)")
def set03(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.join(b, ["id", "t"], "left_anti").select("id", "t")


@register("set34_toggled", f"WITH {_STORED}, t AS (SELECT id, count(*) % 2 = 1 AS f FROM (SELECT id FROM b UNION ALL SELECT id FROM b WHERE t = 0) GROUP BY id) SELECT coalesce(a.id, t.id) AS id FROM (SELECT DISTINCT id FROM a) a FULL JOIN t ON a.id = t.id WHERE (a.id IS NOT NULL) <> coalesce(t.f, false)")
def set34(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return sync.toggled(a, b.select("id").unionByName(b.where("t = 0").select("id")), ["id"])


@register(
    "agg04_hidden_targets",
    "SELECT c_custkey AS target_id, count(DISTINCT l_suppkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_suppkey <> c_custkey AND (c_nationkey < 20 OR epoch_ms(l_shipdate) > 900000000000) AND epoch_ms(l_shipdate) - l_partkey * 400000000 >= 86400000 GROUP BY c_custkey HAVING count(DISTINCT l_suppkey) >= 3",
)
def agg04(spark, sf_dir):
    li, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    ms = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    reports = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("target_id"), F.col("l_suppkey").alias("reporter_id"), ms.alias("created_ms"), (F.col("l_partkey") * 400000000).alias("joined_ms"))
    targets = c.select(F.col("c_custkey").alias("target_id"), F.col("c_custkey").alias("owner_id"), F.when(F.col("c_nationkey") >= 20, F.lit(900000000000)).alias("restored_ms"))
    return sync.hidden_targets(reports, targets)


@register("stm07_due_for_retry", "SELECT event_id FROM events WHERE event_type <> 'error' AND event_id * 1000 + CASE WHEN event_id % 5 = 0 THEN 0 ELSE least(pow(2, event_id % 5) * 30000, 3600000) END <= 400000")
def stm07(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", (k * 1000).alias("created_ms"), (k % 5).alias("attempts"), F.when(F.col("event_type") == "error", "failed").otherwise("pending").alias("status"))
    return sync.due_for_retry(rows, 400_000).select("event_id")


@register("stm06_gated_outbox", "SELECT event_id FROM events e WHERE event_id % 2 = 0 OR event_id - 1 IN (SELECT event_id FROM events WHERE event_type = 'click')")
def stm06(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 2 == 1, F.col("event_id") - 1).alias("after"))
    return sync.gated(rows, e.where("event_type = 'click'").select(F.col("event_id").alias("id")), "after").select("event_id")


@register("srt11_bounded_top_k", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE r <= 4")
def srt11(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 4").select("o_custkey", "o_orderkey")


@register("srt09_sorted_names", "SELECT p_partkey, CAST(row_number() OVER (ORDER BY lower(p_name), p_partkey) AS BIGINT) AS place FROM part")
def srt09(spark, sf_dir):
    """Every part and its place by name: numbered within ranges of names, and the rows of the ranges before added."""
    from trekframe.storage import materialize

    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("n"))
    ranges = materialize(rows.repartitionByRange("n", "p_partkey").withColumn("p", F.spark_partition_id()), "names")
    sizes = ranges.groupBy("p").count()  # a row a range
    before = sizes.select("p", (F.sum("count").over(Window.orderBy("p")) - F.col("count")).alias("before"))
    within = ranges.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("n", "p_partkey")))
    return within.join(F.broadcast(before), "p").select("p_partkey", (F.col("r") + F.col("before")).alias("place")).orderBy("place")
