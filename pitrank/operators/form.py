"""History and form features over what was known before a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contiguous_gate(events: DataFrame, keys: list[str], ordinal: str, cutoff: str, label: str, window: int) -> DataFrame:
    """Whether the ``window`` ordinals before each event all exist and were labelled before its cutoff."""
    w = Window.partitionBy(*keys).orderBy(ordinal).rangeBetween(-window, -1)
    full = (F.count("*").over(w) == window) & (F.max(label).over(w) < F.col(cutoff))
    return events.select(*keys, ordinal, F.coalesce(full, F.lit(False)).alias("complete"))


def contiguous_window(rows: DataFrame, events: DataFrame, keys: list[str], entrant: str, ordinal: str, cutoff: str, label: str, window: int, position: str = "label_position", dnf: str = "label_dnf") -> DataFrame:
    """Mean finish, retirement rate and count of an entrant over the ordinals r-w..r-1, only if the gate is open.

    The rate is null unless every label in the window is known."""
    gate = contiguous_gate(events, keys, ordinal, cutoff, label, window)
    w = Window.partitionBy(*keys, entrant).orderBy(ordinal).rangeBetween(-window, -1)
    seen = rows.select(*keys, entrant, ordinal, F.avg(position).over(w).alias("mean"), F.count("*").over(w).alias("k"), F.count(dnf).over(w).alias("known"), F.avg(F.col(dnf).cast("int")).over(w).alias("rate"))
    j = seen.join(gate, [*keys, ordinal])
    open_ = F.col("complete")
    return j.select(
        *keys, entrant, ordinal, "complete",
        F.when(open_, F.round("mean", 6)).alias("finish_mean"),
        F.when(open_ & (F.col("k") > 0) & (F.col("k") == F.col("known")), F.round("rate", 6)).alias("dnf_rate"),
        F.when(open_, F.col("k")).otherwise(0).cast("long").alias("history_count"),
    )


def team_window(rows: DataFrame, events: DataFrame, keys: list[str], team: str, ordinal: str, cutoff: str, label: str, window: int) -> DataFrame:
    """A team's mean finish and retirement rate (known labels only) over a complete window."""
    gate = contiguous_gate(events, keys, ordinal, cutoff, label, window)
    per = rows.groupBy(*keys, team, ordinal).agg(F.sum("label_position").alias("s"), F.count("label_position").alias("c"), F.sum(F.col("label_dnf").cast("int")).alias("d"), F.count("label_dnf").alias("k"))
    w = Window.partitionBy(*keys, team).orderBy(ordinal).rangeBetween(-window, -1)
    got = per.select(*keys, team, ordinal, (F.sum("s").over(w) / F.sum("c").over(w)).alias("mean"), (F.sum("d").over(w) / F.sum("k").over(w)).alias("rate"))
    j = got.join(gate.filter("complete"), [*keys, ordinal], "left")
    return j.select(*keys, team, ordinal, F.when(F.col("complete"), F.round("mean", 6)).alias("team_finish"), F.when(F.col("complete"), F.round("rate", 6)).alias("team_dnf"))


def mate_delta(rows: DataFrame, event: list[str], team: str, value: str) -> Column:
    """Own value minus the mean of the team mates' known ones, from one window's sums."""
    w = Window.partitionBy(*event, team)
    others = F.count(value).over(w) - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    return F.col(value) - (F.sum(value).over(w) - F.col(value)) / F.when(others > 0, others)


def best_mate(rows: DataFrame, event: list[str], team: str, entrant: str, value: str) -> DataFrame:
    """Each row with the smallest value of the others of its team in the event, from the two smallest of the team."""
    two = F.array_sort(F.collect_list(F.struct(value, entrant)).over(Window.partitionBy(*event, team)))
    known = F.filter(two, lambda x: x[value].isNotNull() & (x[entrant] != F.col(entrant)))
    return rows.withColumn("mate", F.get(known, F.lit(0))[value])


def elo_step(rows: DataFrame, event: list[str], entrant: str, team: str, position: str, rating: str, k: float = 24.0, scale: float = 400.0, mate_weight: float = 2.0) -> DataFrame:
    """One event's update from given ratings: weighted mean surprise over all pairs of classified entrants."""
    a = rows.filter(F.col(position).isNotNull()).select(*event, F.col(entrant).alias("a"), F.col(team).alias("ta"), F.col(position).alias("pa"), F.col(rating).alias("ra"))
    b = a.select(*event, F.col("a").alias("b"), F.col("ta").alias("tb"), F.col("pa").alias("pb"), F.col("ra").alias("rb"))
    pair = a.join(b, event).filter("a <> b")
    expected = 1 / (1 + F.pow(F.lit(10.0), (F.col("rb") - F.col("ra")) / scale))
    weight = F.when(F.col("ta") == F.col("tb"), mate_weight).otherwise(1.0)
    won = F.when(F.col("pa") < F.col("pb"), 1.0).otherwise(0.0)
    return pair.groupBy(*event, F.col("a").alias(entrant)).agg(F.round(k * F.sum(weight * (won - expected)) / F.sum(weight), 6).alias("delta"))


def similar(profiles: DataFrame, ident: str, values: list[str], bandwidth: float, count: int) -> DataFrame:
    """The most similar others by a Gaussian kernel on standardised profiles (population deviation).

    Profiles are a small dimension (one row per venue), joined with itself."""
    all_ = Window.partitionBy(F.lit(0))
    z = [((F.col(v) - F.avg(v).over(all_)) / F.when(F.stddev_pop(v).over(all_) == 0, 1.0).otherwise(F.stddev_pop(v).over(all_))).alias(v) for v in values]
    p = profiles.select(ident, *z)
    q = p.select(F.col(ident).alias("other"), *[F.col(v).alias(f"_{v}") for v in values])
    distance = sum(((F.col(v) - F.col(f"_{v}")) ** 2 for v in values), F.lit(0.0))
    j = p.join(q, F.col(ident) != F.col("other")).withColumn("weight", F.round(F.exp(-distance / (2 * bandwidth**2)), 9))
    rank = Window.partitionBy(ident).orderBy(F.desc("weight"), "other")
    return j.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= count).select(ident, "other", "k", F.round("weight", 6).alias("weight"))


def practice(rows: DataFrame, event: list[str], team: str, best: str) -> DataFrame:
    """C14: position, relative gap to the fastest, difference to the team mates, and rank over field size less one."""
    w = Window.partitionBy(*event)
    place = F.rank().over(w.orderBy(best))
    return rows.select(
        "*", place.cast("long").alias("place"),
        F.round(F.col(best) / F.min(best).over(w) - 1, 6).alias("gap"),
        F.round(mate_delta(rows, event, team, best), 6).alias("mate_gap"),
        F.round((place - 1) / F.when(F.count("*").over(w) > 1, F.count("*").over(w) - 1), 6).alias("share"),
    )


def places_lost(grid: str, qualifying: str, pit_lane: Column, field: str) -> Column:
    """Grid places lost since qualifying; from the pit lane one counts as behind the whole field."""
    return F.when(pit_lane, F.col(field) + 1).otherwise(F.col(grid)) - F.col(qualifying)


def retired(category: str) -> Column:
    """Three-valued retirement: unknown, not started and disqualified stay null."""
    c = F.col(category)
    return F.when(c == "retired", True).when(c.isin("finished", "lapped"), False)
