"""An outbox that a stream fills and drains: claims with a lease, guarded outcomes, waits after failures, items in chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.functions.hiking import backoff_ms
from trekframe.storage import materialize
from trekframe.streaming.feeds import current, publish

COLUMNS = ["id", "after", "at_ms", "kind", "status", "attempts", "due_ms", "claim", "lease_ms", "drain"]


def enqueued(stored: DataFrame | None, items: DataFrame) -> DataFrame:
    """New items ``(id, after, at_ms, kind)`` beside the stored ones; an id that is there already stays as it is (STM06)."""
    new = items.groupBy("id").agg(F.min(F.struct("at_ms", "after", "kind")).alias("i"))
    none = F.lit(None).cast("long")
    rows = new.select("id", "i.after", "i.at_ms", "i.kind", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.col("i.at_ms").alias("due_ms"), F.lit(None).cast("string").alias("claim"), none.alias("lease_ms"), none.alias("drain"))
    if stored is None:
        return rows.select(*COLUMNS)
    return stored.select(*COLUMNS).unionByName(rows.join(stored.select("id"), "id", "left_anti").select(*COLUMNS))


def claimed(rows: DataFrame, now_ms: int, drain: int, turn: int, lease_ms: int) -> DataFrame:
    """Rows with those that can be sent now marked as sending, under a claim and a lease (STM11).

    Due are pending rows whose wait is over and rows in sending whose lease has run out, as their sender is gone; each once
    a drain. An item in a chain waits until the one before it is sent; it goes with one that failed.
    """
    before = rows.select(F.col("id").alias("after"), F.col("status").alias("_before"))
    met = rows.join(before, "after", "left")
    open_ = (F.col("status") == "pending") & (F.col("due_ms") <= now_ms) | (F.col("status") == "sending") & (F.col("lease_ms") <= now_ms)
    free = F.col("after").isNull() | (F.col("_before") == "sent")
    due = F.coalesce(open_ & free & ~F.col("drain").eqNullSafe(drain), F.lit(False))
    gone = F.coalesce((F.col("status") == "pending") & (F.col("_before") == "failed"), F.lit(False))
    return met.select(
        "id", "after", "at_ms", "kind", F.when(due, "sending").when(gone, "failed").otherwise(F.col("status")).alias("status"), "attempts", "due_ms", F.when(due, f"{drain}.{turn}").otherwise(F.col("claim")).alias("claim"),
        F.when(due, now_ms + lease_ms).otherwise(F.col("lease_ms")).cast("long").alias("lease_ms"), F.when(due, drain).otherwise(F.col("drain")).cast("long").alias("drain"),
    )


def settled(rows: DataFrame, outcomes: DataFrame, now_ms: int, base_ms: int = 30_000, most_ms: int = 3_600_000) -> DataFrame:
    """Rows after the outcomes ``(id, claim, code)`` of what was sent (STM06).

    An outcome counts only for the claim that it answers, so a sender whose lease ran out changes nothing. 2xx is sent,
    4xx failed for good; any other code is the server's trouble: pending again, an attempt more and a longer wait. Without
    a code the network was gone: pending as before.
    """
    got = outcomes.groupBy("id", "claim").agg(F.max("code").alias("code"), F.lit(True).alias("_got"))
    met = rows.join(got, ["id", "claim"], "left")
    own, code = F.coalesce(F.col("_got") & (F.col("status") == "sending"), F.lit(False)), F.col("code")
    server = own & code.isNotNull() & ~code.between(200, 299) & ~code.between(400, 499)
    status = F.when(~own, F.col("status")).when(code.between(200, 299), "sent").when(code.between(400, 499), "failed").otherwise("pending")
    wait = now_ms + backoff_ms(F.col("attempts"), base_ms, most_ms)
    return met.select("id", "after", "at_ms", "kind", status.alias("status"), F.when(server, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(server, wait).otherwise(F.col("due_ms")).alias("due_ms"), "claim", "lease_ms", "drain")


def drained(rows: DataFrame, send: Callable[[DataFrame], DataFrame], now_ms: int, drain: int, lease_ms: int = 60_000, most_passes: int = 1_000) -> DataFrame:
    """The outbox after a drain at ``now_ms``: passes of claim, send and outcome, until nothing more is free to go. A pass sends
    all items whose chain has come to them, so there are as many passes as the longest chain has links."""
    for turn in range(most_passes):
        rows = materialize(claimed(rows, now_ms, drain, turn, lease_ms), "claimed")
        mine = rows.where(F.col("claim") == f"{drain}.{turn}")
        if mine.isEmpty():
            return rows
        rows = settled(rows, materialize(send(mine), "outcomes"), now_ms)
    raise RuntimeError("chains are longer than most_passes")


def maintain(items: DataFrame, path: str, checkpoint: str, send: Callable[[DataFrame], DataFrame], lease_ms: int = 60_000):
    """Runs an outbox on a stream of items ``(id, after, at_ms, kind)`` (STM11): each batch is enqueued, and what is due at its
    latest time is sent. The table is published in versions, so a batch that crashed or is run again starts from the
    version before it and ends in the same table. Returns the query."""

    def step(batch: DataFrame, batch_id: int) -> None:
        stored = current(batch.sparkSession, path, before=batch_id)
        now = batch.agg(F.max("at_ms")).first()[0]
        rows = materialize(enqueued(stored, batch), "outbox")
        publish(rows if now is None else drained(rows, send, now, batch_id, lease_ms), path, batch_id)

    return items.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
