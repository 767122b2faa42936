"""A bitemporal points ledger: rules, versions, standings before a cutoff, countback and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_for(events: DataFrame, rules: DataFrame, season: str, ordinal: str, values: list[str]) -> DataFrame:
    """The rule whose range holds the event; beyond all ranges the season's latest earlier one continues.

    Rules are a small dimension. Several matches are an error and give null."""
    r = rules.select(season, "first_round", "last_round", *values)
    j = events.join(F.broadcast(r), (events[season] == r[season]) & (r["first_round"] <= events[ordinal]), "left").drop(r[season])
    inside = F.col("last_round") >= F.col(ordinal)
    picked = j.groupBy(*events.columns).agg(F.count_if(inside).alias("matches"), F.max_by(F.struct(*values), F.struct(F.coalesce(inside, F.lit(False)), "last_round")).alias("v"))
    return picked.select(*events.columns, *[F.when(F.col("matches") <= 1, F.col(f"v.{c}")).alias(c) for c in values], (F.col("matches") == 0).alias("continued"))


def known_versions(points: DataFrame, keys: list[str], ident: str, at: DataFrame, clock: str, values: list[str]) -> DataFrame:
    """At every publication instant of an event, the as-of state of every entrant."""
    j = at.join(points, keys).filter(F.col(clock) <= F.col("instant"))
    top = j.groupBy(*keys, "instant", ident).agg(F.max(F.struct(clock, *values)).alias("v"))
    return top.select(*keys, "instant", ident, *[F.col(f"v.{c}").alias(c) for c in values])


def versions_before(points: DataFrame, targets: DataFrame, league: list[str], ordinal: str, target: list[str], cutoff: str) -> DataFrame:
    """For each target the newest version of each earlier ordinal completed and effective before the cutoff.

    Ranked on one row per (event, version); entrant rows join after."""
    v = points.select(*league, ordinal, "version", "completed_at", "effective_at", "status").distinct()
    j = targets.select(*target, *league, F.col(ordinal).alias("own"), cutoff).join(v, league).filter((F.col(ordinal) < F.col("own")) & (F.col("completed_at") < F.col(cutoff)) & (F.col("effective_at") < F.col(cutoff)))
    return j.groupBy(*target, *league, "own", ordinal).agg(F.max_by(F.struct("version", "status"), "effective_at").alias("v")).select(*target, *league, "own", ordinal, "v.version", "v.status")


def open_ledgers(chosen: DataFrame, target: list[str]) -> DataFrame:
    """Targets for which every earlier ordinal has a version, with how many are disputed."""
    n = chosen.groupBy(*target, "own").agg(F.count("*").alias("rounds"), F.count_if(F.col("status") == "disputed").alias("disputed"))
    return n.filter(F.col("rounds") == F.col("own") - 1).select(*target, "rounds", "disputed")


def countback(totals: DataFrame, keys: list[str], points: str, places: str) -> Column:
    """Rank by points, equal points by counts of first, second and further places; null for a full tie."""
    w = Window.partitionBy(*keys).orderBy(F.desc(points), F.desc(places))
    same = F.count("*").over(Window.partitionBy(*keys, points, places))
    return F.when(same == 1, F.rank().over(w))


def standings(points: DataFrame, targets: DataFrame, roster: DataFrame, league: list[str], ordinal: str, target: list[str], cutoff: str, entrant: str, most_places: int = 20) -> DataFrame:
    """Totals, gap to the leader and countback position of every roster entrant before the cutoff.

    Without a complete version of every earlier ordinal all fields are null, with the reason."""
    chosen = versions_before(points, targets, league, ordinal, target, cutoff)
    gate = open_ledgers(chosen, target)
    rows = chosen.join(points.select(*league, ordinal, "version", entrant, "points", "position"), [*league, ordinal, "version"])
    counts = F.array(*[F.count_if(F.col("position") == i) for i in range(1, most_places + 1)])
    sums = rows.groupBy(*target, entrant).agg(F.sum("points").alias("total"), counts.alias("places"))
    sums = sums.withColumn("standing", countback(sums, target, "total", "places")).withColumn("gap", F.max("total").over(Window.partitionBy(*target)) - F.col("total"))
    out = roster.select(*target, entrant).join(gate, target, "left").join(sums, [*target, entrant], "left")
    first = targets.select(*target, (F.col(ordinal) == 1).alias("first"))
    out = out.join(first, target)
    open_ = F.col("rounds").isNotNull()
    return out.select(*target, entrant, F.when(open_, F.coalesce("total", F.lit(0.0))).alias("points_before"), F.when(open_, F.col("standing")).cast("long").alias("standing"), F.when(open_, F.col("gap")).alias("gap"), F.when(~open_ & ~F.col("first"), "audited_prior_event_missing_or_uncertain").alias("reason"))


def points_in_last(per_event: DataFrame, keys: list[str], ordinal: str, window: int) -> DataFrame:
    """Points over the ``window`` ordinals before each; null if fewer exist."""
    w = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-window, -1)
    return per_event.withColumn("last_points", F.when(F.col(ordinal) > window, F.coalesce(F.sum("points").over(w), F.lit(0.0))))


def award(places: DataFrame, rules: DataFrame, keys: list[str], place: str, eligible: Column) -> DataFrame:
    """Points by place, 0 beyond the table; ineligible entrants get 0 and nobody moves up."""
    j = places.join(F.broadcast(rules), [*keys, place], "left")
    return j.withColumn("points", F.when(eligible, F.coalesce("points", F.lit(0.0))).otherwise(0.0))


def reconciled(points: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Cells where the sum of entrant points differs from the independent matrix, or one side is absent."""
    own = points.groupBy(*keys).agg(F.sum("points").alias("summed"))
    j = own.join(matrix.select(*keys, F.col("points").alias("stated")), keys, "full")
    return j.filter(~F.col("summed").eqNullSafe(F.col("stated")))


def change_points(values: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Versions at which a value changes, and the first version from which the final value holds."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = values.withColumn("before", F.lag(value).over(w)).withColumn("n", F.row_number().over(w))
    changed = d.filter((F.col("n") == 1) | ~F.col(value).eqNullSafe(F.col("before")))
    return changed.groupBy(*keys).agg(F.count("*").alias("changes"), F.max(order).alias("stable_from"), F.max_by(value, order).alias("final"))


def final_order(totals: DataFrame, keys: list[str], points: str, ident: str) -> DataFrame:
    """Order by points and id, with a mark where points are tied."""
    w = Window.partitionBy(*keys).orderBy(F.desc(points), ident)
    return totals.withColumn("place", F.row_number().over(w).cast("long")).withColumn("tied_on_points", F.count("*").over(Window.partitionBy(*keys, points)) > 1)


def awards(events: DataFrame, rules: DataFrame, season: str, ordinal: str) -> DataFrame:
    """``events`` with place and points by the rule range that holds their ordinal; the season's last range goes on."""
    last = rules.groupBy(season).agg(F.max("last_round").alias("_last"))
    r = F.broadcast(rules.join(last, season))  # a few ranges of places for each season
    fits = (F.col(ordinal) >= F.col("first_round")) & ((F.col(ordinal) <= F.col("last_round")) | (F.col("last_round") == F.col("_last")))
    return events.join(r, season).filter(fits).select(*events.columns, "place", "points")
