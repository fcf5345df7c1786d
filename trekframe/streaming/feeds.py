"""Structured Streaming: pulls applied once, event-time votes, rate limits and positions with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.operators.sequential import metres_between
from trekframe.operators.sync import last_writer_wins


def pull_into(changes: DataFrame, path: str, key: str, updated: str, checkpoint: str):
    """Applies a stream of changes to a table of versions under ``path`` (STM02, STM03). Returns the query."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        stored = current(batch.sparkSession, path, before=batch_id)
        # tombstones stay in the table, or a late older row would bring a deleted one back
        publish(last_writer_wins(batch.limit(0) if stored is None else stored, batch, key, updated), path, batch_id)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, path: str) -> tuple[object, list[int]]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def publish(rows: DataFrame, path: str, version: int) -> None:
    """Writes a version of a table, and then the marker that names it: a batch that runs again writes the same version, and
    readers never see half of one. Versions older than the one before go, so a stream keeps two, however long it runs."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/v{version}")
    spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/m{version}")
    fs, done = _versions(spark, path)
    for old in done[: max(0, done.index(version) - 1)]:
        for part in (f"{path}/marks/m{old}", f"{path}/v{old}"):
            fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part), True)


def current(spark, path: str, before: int | None = None) -> DataFrame | None:
    """The newest finished version, tombstones included."""
    done = [v for v in _versions(spark, path)[1] if before is None or v < before]
    return spark.read.parquet(f"{path}/v{done[-1]}") if done else None


def water_votes(reports: DataFrame, late: str = "120 days", decay_days: float = 30.0) -> DataFrame:
    """Counts, latest times and weights by waypoint, status and day (STM09). ``weight`` is what the day's reports weigh at its
    end, each fading with its age. On a stream, reports of days that the watermark has left behind are dropped."""
    aged = reports.withWatermark("observed_at", late).withColumn("day", F.window("observed_at", "1 day"))
    left = (F.unix_micros("day.end") - F.unix_micros("observed_at")) / 86_400_000_000.0
    return aged.groupBy("waypoint_id", "status", "day").agg(F.count("*").alias("n"), F.max("observed_at").alias("latest"), F.sum(F.exp(-left / decay_days)).alias("weight"))


def keep_votes(votes: DataFrame, path: str, checkpoint: str):
    """Writes what each batch of a stream of votes changed to a folder of its own under ``path``; a batch that runs again
    writes the same one. Returns the query."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select("*", F.lit(batch_id).alias("batch")).write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    return votes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verdicts(kept: DataFrame, now, window_days: int = 120, decay_days: float = 30.0) -> DataFrame:
    """``(waypoint_id, status, weight, n, latest)``: the status that weighs most at ``now``, of the days that end within the window;
    of equal weights the one reported last. ``kept`` is what ``keep_votes`` wrote: a day's last batch counts."""
    last = kept.groupBy("waypoint_id", "status", "day").agg(F.max_by(F.struct("n", "latest", "weight"), "batch").alias("v"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("day.end")) / 86_400_000_000.0
    per = last.where(age <= window_days).groupBy("waypoint_id", "status").agg(F.sum(F.col("v.weight") * F.exp(-age / decay_days)).alias("weight"), F.sum("v.n").alias("n"), F.max("v.latest").alias("latest"))
    best = F.max_by(F.struct("status", "weight", "n", "latest"), F.struct(F.round("weight", 9), F.col("latest"), F.col("status"))).alias("b")
    return per.groupBy("waypoint_id").agg(best).select("waypoint_id", "b.*")


def sane_time(reports: DataFrame, now, minutes: int = 10) -> DataFrame:
    """Event times no later than a little ahead of now (STM10)."""
    return reports.withColumn("observed_at", F.least("observed_at", F.lit(now) + F.expr(f"INTERVAL {minutes} MINUTES")))


def once(events: DataFrame, keys: list[str], at: str, within: str = "1 hour") -> DataFrame:
    """Repeated deliveries dropped within the watermark (STM03)."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def limit_rate(events: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """``(key, seq, allowed)``: a sliding-window limit; a key's state is its allowed times within the window (STM04).

    ``events`` are ``(key, seq, ms)``; refused ones do not count.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ms", "seq"])
        allowed = []
        for t in rows["ms"]:
            kept = [k for k in kept if k > t - window_ms]
            ok = len(kept) < limit
            if ok:
                kept.append(int(t))
            allowed.append(ok)
        state.update((kept,))
        yield pd.DataFrame({"key": key[0], "seq": rows["seq"].to_numpy(), "allowed": allowed})

    return events.groupBy("key").applyInPandasWithState(step, "key long, seq long, allowed boolean", "kept array<long>", "append", "NoTimeout")


def track_cells(track: DataFrame, within_m: float) -> DataFrame:
    """``(trail_id, cy, cx, near)``: for each cell of the globe, the rows ``(idx, lat, lon)`` of tracks that lie within ``within_m``
    of a place in it."""
    from trekframe.operators.spatial import Grid

    return Grid(within_m).around(track).groupBy("trail_id", "cy", "cx").agg(F.collect_list(F.struct("idx", "lat", "lon")).alias("near"))


def follow(positions: DataFrame, cells: DataFrame, within_m: float = 2_000.0, hint: int = 50, trusted_m: float = 500.0) -> DataFrame:
    """``(device, seq, idx)``: the row of its trail that each position is at, null beyond ``within_m`` of all rows (STM12).

    ``positions`` are a stream of ``(device, seq, trail_id, lat, lon)``, ``cells`` as from ``track_cells`` with the same
    distance. A position meets the rows of its cell, in a join of the stream with a table. Of these, rows
    within ``hint`` of the device's last one count first, if one is nearer than ``trusted_m``: on a way out and back, the
    leg that is walked. Else it is the nearest of all, the earlier in a tie. The state is a device's last row.
    """
    from trekframe.operators.spatial import Grid

    own = Grid(within_m).own(F.col("lat"), F.col("lon"))
    met = positions.select("device", "seq", "trail_id", "lat", "lon", *own).join(cells, ["trail_id", "cy", "cx"], "left").select("device", "seq", "lat", "lon", "near")

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for lat, lon, near in rows[["lat", "lon", "near"]].itertuples(index=False, name=None):
            here = sorted((metres_between(lat, lon, r["lat"], r["lon"]), r["idx"]) for r in ([] if near is None else near))
            here = [(d, i) for d, i in here if d <= within_m]
            close = [(d, i) for d, i in here if at is not None and abs(i - at) <= hint and d < trusted_m]
            found = (close or here or [(0.0, None)])[0][1]
            at = at if found is None else int(found)
            out.append(found)
        if at is not None:
            state.update((at,))
        yield pd.DataFrame({"device": key[0], "seq": rows["seq"].to_numpy(), "idx": pd.array(out, dtype="Int64")})

    return met.groupBy("device").applyInPandasWithState(step, "device long, seq long, idx long", "at long", "append", "NoTimeout")
