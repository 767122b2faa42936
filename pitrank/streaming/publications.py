"""Publication feeds as streams: idempotent replays, freezing at a cutoff, late versions.

A freeze is an append-mode aggregation keyed by the cutoff itself, with the watermark on the cutoff: a key leaves the
state, once and for ever, when a later cutoff has been seen. So it needs a closing row after the last event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def idempotent(feed: DataFrame, slot: list[str], payload: str, clock: str, delay: str = "30 days") -> DataFrame:
    """Each (slot, content) once; replays within the delay are no-ops."""
    d = feed.withColumn("hash", F.sha2(F.col(payload).cast("string"), 256)).withWatermark(clock, delay)
    return d.dropDuplicatesWithinWatermark([*slot, "hash"])


def frozen(feed: DataFrame, keys: list[str], clock: str, cutoff: str, values: list[str], delay: str = "0 seconds") -> DataFrame:
    """Per key one row: its newest version known by the cutoff, written when the watermark passes the cutoff.

    Rows may come out of order by as much as ``delay`` of cutoffs; what comes later than that is dropped by the stream, so
    that a frozen row never changes. Spark counts it as numRowsDroppedByWatermark."""
    known = feed.withWatermark(cutoff, delay).filter(F.col(clock) <= F.col(cutoff))
    top = known.groupBy(*keys, cutoff).agg(F.max(F.struct(clock, *values)).alias("v"))
    return top.select(*keys, cutoff, *[F.col(f"v.{c}").alias(c) for c in (clock, *values)])


def late(feed: DataFrame, clock: str, cutoff: str) -> DataFrame:
    """Versions published after their cutoff: kept in the log, never in the frozen row."""
    return feed.filter(F.col(clock) > F.col(cutoff))


def missed(events: DataFrame, captures: DataFrame, keys: list[str], start: str, now) -> DataFrame:
    """What became of monitored events whose start has passed."""
    c = captures.select(*keys).distinct().withColumn("captured", F.lit(True))
    return events.filter(F.col(start) <= now).join(c, keys, "left").select(*keys, F.when(F.col("captured"), "closed").otherwise("missed").alias("status"))


def rescheduled(schedules: DataFrame, keys: list[str], start: str, version: str) -> DataFrame:
    """Events whose newest schedule has another start than the first one seen."""
    g = schedules.groupBy(*keys).agg(F.min_by(start, version).alias("first"), F.max_by(start, version).alias("last"))
    return g.filter("first <> last").select(*keys, F.lit("schedule_changed_review_required").alias("status"))


def phase(events: DataFrame, qualifying: str, captured: str, start: str, now, window: str) -> DataFrame:
    """An event's phase at a time."""
    status = F.when(F.col(captured) <= now, "captured").when(F.col(start) <= now, "missed").when(F.col(start) - F.expr(f"INTERVAL {window}") <= now, "pre_race_window")
    return events.withColumn("phase", status.when(F.col(qualifying) <= now, "waiting_for_results").otherwise("waiting_for_qualifying"))


def fallback(rows: DataFrame, first: str, second: str, scheduled: str, start: str, now, wait: str = "2 HOUR") -> DataFrame:
    """The second provider stands in while the first is empty and the wait after the session has passed."""
    open_ = (F.col(scheduled) + F.expr(f"INTERVAL {wait}") <= now) & (now < F.col(start))
    value = F.coalesce(F.col(first), F.when(open_, F.col(second)))
    status = F.when(F.col(first).isNotNull(), "final").when(value.isNotNull(), "provisional").when(F.col(start) <= now, "missed").otherwise("waiting")
    return rows.withColumn("value", value).withColumn("status", status)
