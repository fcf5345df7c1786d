"""Queries that run as streams over the events, all that is there, into a table of the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.plans.moves import OUT_AND_BACK, out_and_back
from trekframe.plans.registry import register
from trekframe.plans.tables import hav, table
from trekframe.storage import materialize, scratch_path
from trekframe.streaming import feeds, outbox


def drained(stream: DataFrame) -> DataFrame:
    """What the stream has written once it has read all there is."""
    spark = stream.sparkSession
    path = scratch_path(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def event_stream(spark, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: the source takes no single file


@register("stm03_once", "SELECT DISTINCT event_id FROM events")
def stm03_once(spark, sf_dir):
    rows = event_stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    twice = rows.select("event_id", "at", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"))
    return drained(feeds.once(twice, ["event_id"], "at").select("event_id"))


@register("stm04_rate_limit_stream")
def stm04_stream(spark, sf_dir):
    rows = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return drained(feeds.limit_rate(rows, 5, 3_600_000))


@register("stm02_pulled_table", "SELECT user_id AS key, arg_max(value, event_id) AS value, max(event_id) AS at FROM events GROUP BY user_id")
def stm02(spark, sf_dir):
    """A stream of changes pulled into a table of versions, batch by batch, each at least once (STM02, STM03)."""
    changes = event_stream(spark, sf_dir).select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("at"))
    path = scratch_path(spark, "pull")
    feeds.pull_into(changes, path, "key", "at", scratch_path(spark, "mark")).awaitTermination()
    return feeds.current(spark, path)


def in_batches(spark, sf_dir: str, columns: list, parts: int = 4) -> DataFrame:
    """The events as a stream of ``parts`` batches, in the order of their ids."""
    path = scratch_path(spark, "batches")
    e = table(spark, sf_dir, "events")
    most = e.agg(F.max("event_id")).first()[0]
    for k in range(parts):
        mine = e.where((F.col("event_id") * parts >= k * (most + 1)) & (F.col("event_id") * parts < (k + 1) * (most + 1)))
        mine.select(*columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(e.select(*columns).schema).option("maxFilesPerTrigger", 1).parquet(path)


@register(
    "stm09_decayed_votes",
    """WITH e AS (SELECT user_id AS w, event_type AS s, CAST(ts AS TIMESTAMP) - CASE WHEN event_id % 10 = 3 THEN INTERVAL 5 DAY ELSE INTERVAL 0 DAY END AS seen, event_id * 4 // (max(event_id) OVER () + 1) AS b FROM events),
m AS (SELECT b, max(seen) AS top FROM e GROUP BY b), k AS (SELECT e.*, date_trunc('day', seen) + INTERVAL 1 DAY AS day_end, (SELECT max(top) - INTERVAL 1 DAY FROM m WHERE m.b < e.b - {lag}) AS mark FROM e),
n AS (SELECT max(seen) AS now FROM e), r AS (SELECT w, s, sum(exp(-(epoch_us(now) - epoch_us(seen)) / 86400000000.0 / 3.0)) AS weight, count(*) AS n, max(seen) AS latest FROM k, n WHERE (mark IS NULL OR day_end > mark) AND epoch_us(now) - epoch_us(day_end) <= 9 * 86400000000 GROUP BY w, s)
SELECT w AS waypoint_id, arg_max(s, {{'w': round(weight, 9), 'l': latest, 's': s}}) AS status, round(max(weight), 6) AS weight, arg_max(n, {{'w': round(weight, 9), 'l': latest, 's': s}}) AS n FROM r GROUP BY w""".format(lag=1),
)
def stm09(spark, sf_dir):
    """Reports in four batches, every tenth five days late; verdicts at the time of the last one."""
    at = F.col("ts").cast("timestamp") - F.when(F.col("event_id") % 10 == 3, F.expr("INTERVAL 5 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    columns = [F.col("user_id").alias("waypoint_id"), F.col("event_type").alias("status"), at.alias("observed_at")]
    now = table(spark, sf_dir, "events").select(F.max(at)).first()[0]
    path = scratch_path(spark, "votes")
    feeds.keep_votes(feeds.water_votes(in_batches(spark, sf_dir, columns), "1 day", 3.0), path, scratch_path(spark, "mark")).awaitTermination()
    return feeds.verdicts(spark.read.parquet(f"{path}/*"), now, 9, 3.0).select("waypoint_id", "status", F.round("weight", 6).alias("weight"), "n")


@register("stm10_sane_times", "SELECT event_id, strftime(least(CAST(ts AS TIMESTAMP), TIMESTAMP '2024-01-03 00:10:00'), '%Y-%m-%d %H:%M:%S') AS at FROM events")
def stm10(spark, sf_dir):
    import datetime

    reports = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("observed_at"))
    sane = feeds.sane_time(reports, datetime.datetime(2024, 1, 3))
    return sane.select("event_id", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("at"))


_POS = f"""{OUT_AND_BACK}, pos AS (SELECT trail_id, idx, lat + CASE WHEN idx % 9 = 4 THEN 0.06 ELSE 0.0003 END AS lat, lon FROM ob WHERE idx % 2 = 0 OR trail_id % 4 > 0),
c AS (SELECT p.trail_id, p.idx AS seq, o.idx, {hav('p.lat', 'p.lon', 'o.lat', 'o.lon')} AS m FROM pos p JOIN ob o USING (trail_id)), n AS (SELECT * FROM c WHERE m <= 2000),
s AS (SELECT trail_id, idx AS seq, row_number() OVER (PARTITION BY trail_id ORDER BY idx) AS k FROM pos)"""


@register(
    "stm12_followed_track",
    f"""WITH RECURSIVE {_POS}, g AS (SELECT s.trail_id, s.k, s.seq, list({{'m': n.m, 'i': n.idx}} ORDER BY n.m, n.idx) FILTER (n.m IS NOT NULL) AS near FROM s LEFT JOIN n ON n.trail_id = s.trail_id AND n.seq = s.seq GROUP BY ALL),
r AS (SELECT trail_id, k, seq, near[1].i AS idx, near[1].i AS at FROM g WHERE k = 1
UNION ALL SELECT g.trail_id, g.k, g.seq, coalesce(list_filter(g.near, lambda x: abs(x.i - r.at) <= 10 AND x.m < 500)[1].i, g.near[1].i), coalesce(list_filter(g.near, lambda x: abs(x.i - r.at) <= 10 AND x.m < 500)[1].i, g.near[1].i, r.at) FROM r JOIN g ON g.trail_id = r.trail_id AND g.k = r.k + 1)
SELECT trail_id AS device, seq, idx FROM r""",
)
def stm12(spark, sf_dir):
    """Every trail walked out and back by a device of its own, beside the line and at times far off it."""
    line = out_and_back(spark, sf_dir).select("trail_id", "idx", "lat", "lon")
    walk = line.where("idx % 2 = 0 or trail_id % 4 > 0").select(F.col("trail_id").alias("device"), F.col("idx").alias("seq"), "trail_id", (F.col("lat") + F.when(F.col("idx") % 9 == 4, 0.06).otherwise(0.0003)).alias("lat"), "lon")
    path = scratch_path(spark, "walk")
    for k in range(3):  # three batches
        walk.where((F.col("seq") >= 40 * k) & ((F.col("seq") < 40 * k + 40) | (F.lit(k) == 2))).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(walk.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return drained(feeds.follow(stream, materialize(feeds.track_cells(line, 2_000.0), "cells"), 2_000.0, hint=10))


def _outbox(spark, sf_dir):
    k = F.col("event_id")
    return in_batches(spark, sf_dir, [k.alias("id"), F.when(k % 3 > 0, k - 1).alias("after"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.col("event_type").alias("kind")])


def answer(due: DataFrame) -> DataFrame:
    """What a server says to an item: errors are refused, views fail at first, some signups get no answer, the rest is taken."""
    code = F.when(F.col("kind") == "error", 400).when((F.col("kind") == "view") & (F.col("attempts") < F.col("id") % 3), 503).when((F.col("kind") == "signup") & (F.col("id") % 7 == 0), F.lit(None)).otherwise(200)
    return due.select("id", "claim", code.cast("int").alias("code"))


@register("stm06_outbox_outcomes")
def stm06_outcomes(spark, sf_dir):
    """All events as items to send, three in a chain, in four batches; held against a plain loop in the tests."""
    path = scratch_path(spark, "outbox")
    outbox.maintain(_outbox(spark, sf_dir), path, scratch_path(spark, "mark"), answer).awaitTermination()
    return feeds.current(spark, path).select("id", "status", "attempts", "due_ms")
