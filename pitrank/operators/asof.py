"""Point-in-time selection: what was known at a cutoff, and which version of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def known_by(clock: str, cutoff: str, strict: bool = False) -> Column:
    """A fact counts if its clock is at the cutoff or before it (``strict``: before it)."""
    return F.col(clock) < F.col(cutoff) if strict else F.col(clock) <= F.col(cutoff)


def latest(versions: DataFrame, keys: list[str], clock: str, values: list[str], cutoff: str | None = None, strict: bool = False) -> DataFrame:
    """The newest version of each key known by the row's cutoff, and whether several share its clock.

    An ambiguous key keeps its row, with null values."""
    known = versions if cutoff is None else versions.filter(known_by(clock, cutoff, strict))
    top = known.groupBy(*keys).agg(F.max(F.struct(clock, *values)).alias("top"), F.max(clock).alias(clock))
    count = known.groupBy(*keys, clock).agg(F.countDistinct(F.struct(*values)).alias("ties"))
    out = top.join(count, [*keys, clock])
    return out.select(*keys, clock, (F.col("ties") > 1).alias("ambiguous"), *[F.when(F.col("ties") == 1, F.col(f"top.{v}")).alias(v) for v in values])


def two_clocks(versions: DataFrame, keys: list[str], values: list[str], captured: str, captured_by: str, available: str, available_by: str) -> DataFrame:
    """Newest by (available, captured) of what was captured and available in time."""
    known = versions.filter(known_by(captured, captured_by) & known_by(available, available_by))
    top = known.groupBy(*keys).agg(F.max(F.struct(available, captured, *values)).alias("top"))
    return top.select(*keys, *[F.col(f"top.{c}") for c in (available, captured, *values)])


def not_recalled(versions: DataFrame, keys: list[str], order: list[str], recalled: str = "recalled") -> DataFrame:
    """The highest version of each key, and nothing if that one is recalled: ranked first, filtered then."""
    top = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return versions.withColumn("rank", F.row_number().over(top)).filter((F.col("rank") == 1) & ~F.col(recalled)).drop("rank")


def earlier_events(targets: DataFrame, events: DataFrame, keys: list[str], ordinal: str, cutoff: str, label: str, keep: list[str]) -> DataFrame:
    """The earlier events of each target whose labels were all known before its cutoff; one row per event pair.

    Both sides have one row per event, so the triangular join stays small; entrant rows join afterwards."""
    t = targets.select(*keys, F.col(ordinal), F.col(cutoff).alias("target_cutoff"))
    p = events.select(*keys, F.col(ordinal).alias("prior"), label, *keep)
    return t.join(p, keys).filter((F.col("prior") < F.col(ordinal)) & (F.col(label) < F.col("target_cutoff")))


def gated(value: str, clock: str, cutoff: str) -> list[Column]:
    """The value if its own clock is in time, else null, and the reason."""
    late = F.col(clock) > F.col(cutoff)
    kept = F.when(F.col(clock).isNotNull() & ~late, F.col(value))
    reason = F.when(F.col(clock).isNull() | F.col(value).isNull(), "weekend_source_absent").when(late, "published_after_cutoff")
    return [kept.alias(value), reason.alias(f"{value}_reason")]


def arbitrated(sessions: DataFrame, event: list[str], entrant: str, provider: str, tier: str, clock: str, cutoff: str, best: str, tolerance: float = 0.02) -> DataFrame:
    """Per event the provider chosen by (tier, name) of those known by the cutoff, and whether providers disagree:
    any shared entrant's best differs by more than ``tolerance`` of the smaller."""
    known = sessions.filter(known_by(clock, cutoff))
    chosen = known.groupBy(*event).agg(F.min(F.struct(tier, provider)).alias("c"))
    spread = known.groupBy(*event, entrant).agg(((F.max(best) - F.min(best)) / F.min(best)).alias("gap"), F.countDistinct(provider).alias("k"))
    flag = spread.groupBy(*event).agg(F.coalesce(F.max(F.when(F.col("k") > 1, F.col("gap") > tolerance)), F.lit(False)).alias("disagrees"))
    return chosen.join(flag, event).select(*event, F.col(f"c.{provider}").alias("provider"), "disagrees")


def certified_only(sessions: DataFrame, event: list[str], tier: str, clock: str, cutoff: str, most: int, disagreements: DataFrame) -> DataFrame:
    """Newest version per event first; it is dropped if its tier is too weak or the event is quarantined."""
    known = sessions.filter(known_by(clock, cutoff))
    newest = known.withColumn("r", F.rank().over(Window.partitionBy(*event).orderBy(F.desc(clock)))).filter("r = 1").drop("r")
    return newest.filter(F.col(tier) <= most).join(disagreements.filter("disagrees").select(*event), event, "left_anti")


def in_hour(targets: DataFrame, hourly: DataFrame, start: str, valid: str, keys: list[str], values: list[str]) -> DataFrame:
    """The forecast hour that holds the start; several candidates are ambiguous and give null.

    The range becomes an equality of hours, so no cross product arises."""
    t = targets.select(*keys, start, F.date_trunc("hour", F.col(start)).alias("hour"))
    h = hourly.select(F.date_trunc("hour", F.col(valid)).alias("hour"), valid, *values)
    j = t.join(h, "hour", "left").filter(F.col(valid).isNull() | ((F.col(valid) >= F.col(start) - F.expr("INTERVAL 1 HOUR")) & (F.col(valid) <= F.col(start))))
    return j.groupBy(*keys).agg(F.count(valid).alias("candidates"), *[F.when(F.count(valid) == 1, F.max(v)).alias(v) for v in values])


def provenance(versions: DataFrame, keys: list[str], ordinal: str, ident: str) -> DataFrame:
    """Ids of the earlier versions in order, up to the first gap in the ordinals."""
    got = versions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(ordinal, ident))).alias("v"))
    unbroken = F.expr(f"filter(v, (x, i) -> x.{ordinal} = i + 1)")
    return got.select(*keys, F.array_join(F.transform(unbroken, lambda x: x[ident].cast("string")), ",").alias("proof"))


def lagged(events: DataFrame, keys: list[str], ordinal: str, most: int) -> DataFrame:
    """Each event as a cutoff with the events 0..most later in its key, to be featured as of the first."""
    a = events.select(*keys, F.col(ordinal).alias("cutoff_event"), F.explode(F.expr(f"sequence(0L, {most}L)")).alias("lag"))
    b = events.select(*keys, F.col(ordinal).alias("target_event"))
    return a.withColumn("target_event", F.col("cutoff_event") + F.col("lag")).join(b, [*keys, "target_event"])
