"""Streams whose state decides: an outbox with outcomes, votes with late reports, positions on a way out and back."""

import datetime

import pytest

from trekframe.plans import load_queries
from trekframe.streaming import feeds, outbox

SF = "/root/testdata/sf0.001"
ITEMS = "id long, after long, at_ms long, kind string"


def plain_outbox(batches, answer, base=30_000, most=3_600_000):
    """One item after another: what is due is sent, and what waited for it after it."""
    rows = {}
    for batch in batches:
        for i, after, at, kind in batch:
            rows.setdefault(i, {"after": after, "kind": kind, "status": "pending", "attempts": 0, "due": at})
        now, tried, moved = max(b[2] for b in batch), set(), True
        while moved:
            moved = False
            for i, r in rows.items():
                before = rows[r["after"]]["status"] if r["after"] in rows else None
                if r["status"] == "pending" and before == "failed":
                    r["status"], moved = "failed", True
                if r["status"] == "pending" and i not in tried and r["due"] <= now and (r["after"] is None or before == "sent"):
                    tried.add(i)
                    moved, code = True, answer(i, r["kind"], r["attempts"])
                    if code is None:
                        continue
                    if 200 <= code < 300:
                        r["status"] = "sent"
                    elif 400 <= code < 500:
                        r["status"] = "failed"
                    else:
                        r["due"] = now + min(base * 2 ** r["attempts"], most)
                        r["attempts"] += 1
    return {i: (r["status"], r["attempts"]) for i, r in rows.items()}


def test_outbox_of_all_events_against_a_plain_loop(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    most = max(e.event_id for e in events) + 1
    batches = [[] for _ in range(4)]
    for e in events:
        k = e.event_id
        ms = int((e.ts.replace(tzinfo=datetime.timezone.utc)).timestamp() * 1_000_000) // 1000
        batches[k * 4 // most].append((k, k - 1 if k % 3 else None, ms, e.event_type))

    def answer(i, kind, attempts):
        return 400 if kind == "error" else 503 if kind == "view" and attempts < i % 3 else None if kind == "signup" and i % 7 == 0 else 200

    got = {r.id: (r.status, r.attempts) for r in load_queries()[0]["stm06_outbox_outcomes"](spark, SF).collect()}
    want = plain_outbox(batches, answer)
    assert got == want and {s for s, _ in want.values()} == {"sent", "failed", "pending"}


def test_a_crashed_and_a_repeated_batch_give_the_same_table(spark, tmp_path):
    calls = []

    def send(due):
        from pyspark.sql import functions as F

        calls.append(1)
        if len(calls) == 2 and crash:
            raise OSError("gone")
        return due.select("id", "claim", F.when(F.col("id") % 4 == 1, 503).otherwise(200).alias("code"))

    def run(name):
        src = spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        outbox.maintain(src, str(tmp_path / name), str(tmp_path / f"{name}-mark"), send).awaitTermination()

    for k in range(3):
        rows = [(10 * k + j, 10 * k + j - 1 if j % 2 else None, 1_000_000 * k + j, "x") for j in range(6)]
        spark.createDataFrame(rows, ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    crash = True
    with pytest.raises(Exception, match="gone"):
        run("a")
    crash = False
    run("a")
    run("b")
    tables = [sorted(tuple(r) for r in feeds.current(spark, str(tmp_path / n)).select("id", "status", "attempts", "due_ms").collect()) for n in "ab"]
    assert tables[0] == tables[1] and len(tables[0]) == 18
    assert len([p for p in (tmp_path / "a").iterdir() if p.name.startswith("v")]) == 2  # older versions are gone


def test_claims_run_out_and_late_answers_change_nothing(spark):
    rows = [(1, None, 0, "x", "sending", 0, 0, "old", 500, None), (2, None, 0, "x", "sending", 0, 0, "other", 5_000, None), (3, None, 0, "x", "pending", 2, 900, None, None, None), (4, None, 0, "x", "pending", 0, 2_000, None, None, None)]
    frame = spark.createDataFrame(rows, "id long, after long, at_ms long, kind string, status string, attempts int, due_ms long, claim string, lease_ms long, drain long")
    now = outbox.claimed(frame, 1_000, 7, 0, 100)
    got = {r.id: (r.status, r.claim, r.lease_ms) for r in now.collect()}
    assert got == {1: ("sending", "7.0", 1_100), 2: ("sending", "other", 5_000), 3: ("sending", "7.0", 1_100), 4: ("pending", None, None)}
    outcomes = spark.createDataFrame([(1, "old", 400), (2, "other", 200), (3, "7.0", 502)], "id long, claim string, code int")
    after = {r.id: (r.status, r.attempts, r.due_ms) for r in outbox.settled(now, outcomes, 1_000).collect()}
    assert after == {1: ("sending", 0, 0), 2: ("sent", 0, 0), 3: ("pending", 3, 121_000), 4: ("pending", 0, 2_000)}


def test_the_leg_walked_is_followed_where_a_full_scan_would_take_the_first(spark, tmp_path):
    out, back = [(0.0, 0.001 * k) for k in range(30)], [(0.0003, 0.001 * k) for k in range(29, -1, -1)]
    line = [*out, *[(0.001 * k, 0.032) for k in range(12)], *[(0.001 * k, 0.035) for k in range(11, -1, -1)], *back]
    track = spark.createDataFrame([(1, i, lat, lon) for i, (lat, lon) in enumerate(line)], "trail_id long, idx long, lat double, lon double")
    cells = feeds.track_cells(track, 1_000.0)
    first = len(line) - len(back)
    spot = lambda s: (0.0001, line[s][1]) if s < 30 or s >= first else line[s]  # noqa: E731  between the legs, nearer the one out
    walk = [(d, s, 1, *spot(s)) for d in (1, 2) for s in range(len(line)) if d == 1 or s >= first]
    walk.append((1, 999, 1, 5.0, 5.0))
    for part in (walk[:20], walk[20:65], walk[65:]):
        spark.createDataFrame(part, "device long, seq long, trail_id long, lat double, lon double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("device long, seq long, trail_id long, lat double, lon double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = feeds.follow(stream, cells, 1_000.0, hint=5).writeStream.format("memory").queryName("walked").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.device, r.seq): r.idx for r in spark.table("walked").collect()}
    assert all(got[1, s] == s for s in range(len(line))) and got[1, 999] is None  # keeps to the leg back
    assert all(got[2, s] == len(line) - 1 - s for s in range(first, len(line)))  # began there without a hint: the nearest of all rows


def test_late_reports_count_only_until_the_watermark_has_passed(spark, tmp_path):
    day = lambda d: datetime.datetime(2024, 1, d, 12)
    parts = [[(1, "dry", day(10))], [(1, "dry", day(20)), (1, "flowing", day(9))], [(1, "flowing", day(18)), (1, "flowing", day(9))], [(1, "flowing", day(9)), (1, "dry", day(19))]]
    for part in parts:
        spark.createDataFrame(part, "waypoint_id long, status string, observed_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("waypoint_id long, status string, observed_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.keep_votes(feeds.water_votes(stream, "5 days"), str(tmp_path / "votes"), str(tmp_path / "mark")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "votes") + "/*")
    n = {(r.status, r.day.start.day): r.n for r in kept.groupBy("status", "day").agg({"n": "max"}).withColumnRenamed("max(n)", "n").collect()}
    assert n[("flowing", 18)] == 1 and n[("dry", 19)] == 1 and n[("flowing", 9)] < 3  # the last report of the 9th came too late
    best = feeds.verdicts(kept, day(20)).first()
    assert best.status == "dry" and best.n == 3
